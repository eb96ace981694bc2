"""Set and bag operations on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame, bag: bool = False) -> DataFrame:
    """Rows of a that aren't in b; with bag, repeats stay."""
    if not bag:
        return a.subtract(b)
    c = b.toDF(*[f"__{x}" for x in b.columns]).distinct()
    same = [F.col(x).eqNullSafe(F.col(f"__{y}")) for x, y in zip(a.columns, b.columns, strict=True)]
    return a.join(c, same, "left_anti")


def remove_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """a without one occurrence for each row of b."""
    return a.exceptAll(b)


def remove_all_folded(a: DataFrame, b: DataFrame, value: str, order: str) -> DataFrame:
    """a without one row, the first by `order`, for each row of b with the same value but for capitals. Nulls are equal."""
    w = Window.partitionBy("__v").orderBy(order)
    gone = b.groupBy(F.lower(value).alias("__x")).agg(F.count("*").alias("__n"))
    at = a.withColumn("__v", F.lower(value)).withColumn("__r", F.row_number().over(w))
    return at.join(gone, F.col("__v").eqNullSafe(F.col("__x")), "left").where(F.col("__r") > F.coalesce("__n", F.lit(0))).drop("__v", "__r", "__x", "__n")


def unique_ordered(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, first): distinct values with the position where each is first seen; nulls and blanks pruned."""
    return df.where(F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != "")).groupBy(value).agg(F.min(order).alias("first"))


def equivalent(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (subset, equivalent) on the distinct rows of a and b."""
    x = a.subtract(b).agg(F.count("*").alias("x"))
    y = b.subtract(a).agg(F.count("*").alias("y"))
    return x.crossJoin(F.broadcast(y)).select((F.col("x") == 0).alias("subset"), ((F.col("x") == 0) & (F.col("y") == 0)).alias("equivalent"))  # one row each
