"""Sinks for text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, append: bool = False, delim: str = "\t") -> None:
    """Every row as one line, columns joined by the delimiter."""
    line = F.concat_ws(delim, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    df.select(line.alias("value")).write.mode("append" if append else "overwrite").text(path)


def write_by_name(df: DataFrame, name: str, path: str) -> None:
    """A folder per value of the column `name` with the other columns, joined by blanks, as lines."""
    rest = [c for c in df.columns if c != name]
    df.select(F.concat_ws(" ", *rest).alias("value"), name).write.mode("overwrite").partitionBy(name).text(path)


def write_rows(df: DataFrame, name: str, path: str, files: int | None = None) -> DataFrame:
    """(name, content) blocks of every row's other columns joined by blanks, written as one named record a row, so that
    millions of rows don't become millions of files; read_rows gives them back by name."""
    rest = [c for c in df.columns if c != name]
    out = df.select(F.col(name).cast("string").alias("name"), F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in rest]).alias("content"))
    (out.repartitionByRange(files, "name") if files else out.repartitionByRange("name")).sortWithinPartitions("name").write.mode("overwrite").parquet(path)
    return out


def save_model(model, path: str) -> None:
    """Keeps a fitted pipeline; load_model reads it."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def write_table(df: DataFrame, path: str, key: str | None = None) -> None:
    """Parquet, clustered by the key where given, so that lookups skip files."""
    (df.repartitionByRange(key) if key else df).write.mode("overwrite").parquet(path)
