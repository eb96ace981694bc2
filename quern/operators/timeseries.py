"""Time series: codes and timestamps per key, gap filling, cross-correlation and features from them."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def sequences(rows: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, series array<struct<ts, value>>) in time order, ties in order of value; rows without a value are dropped."""
    kept = rows.where(F.col(value).isNotNull())
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).cast("long").alias("ts"), F.col(value).alias("value")))).alias("series"))


def split_stamped(text: Column) -> Column:
    """struct<value, ts> of `value@date`; a value that is no number makes it null."""
    from quern.functions.scalars import is_numeric, parse_timestamp

    parts = F.split(text, "@", 2)
    return F.when(is_numeric(F.get(parts, F.lit(0))), F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("value"), parse_timestamp(F.get(parts, F.lit(1))).alias("ts")))


def prune_after(rows: DataFrame, key: str, ts: Column, cutoffs: DataFrame, cutoff: str) -> DataFrame:
    """Rows up to their key's cutoff; a key without one keeps nothing."""
    c = cutoffs.select(F.col(key).alias("__k"), F.col(cutoff).alias("__c"))
    return rows.join(c, F.col(key) == F.col("__k")).where(ts <= F.col("__c")).drop("__k", "__c")


def resample(series: DataFrame, key: str, step: int = DAY, initial: float = 0.0) -> DataFrame:
    """(key, t, value): a grid from the first to the last event in steps; each point has the last value at or before it."""
    span = series.groupBy(key).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select(key, F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("t"))
    at = series.groupBy(key, "ts").agg(F.max("value").alias("value"))
    both = grid.select(key, F.col("t"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("g")).union(at.select(key, "ts", "value", F.lit(0)))
    w = Window.partitionBy(key).orderBy("t", "g").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("v", F.coalesce(F.last("value", ignorenulls=True).over(w), F.lit(initial)))
    return filled.where("g = 1").select(key, "t", F.col("v").alias("value"))


def align(a: DataFrame, b: DataFrame, key: str, step: int = DAY, shared: bool = False, initial: float = 0.0) -> DataFrame:
    """(key, a, b): the values of two series (key, ts, value) on grids of the same step. With shared both run from the
    earlier first event to the later last one; else each over its own span. Keys found in one only get an empty array."""

    def packed(s: DataFrame, name: str) -> DataFrame:
        return resample(s, key, step, initial).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias(name))

    if shared:
        both = a.select(key, "ts").union(b.select(key, "ts")).groupBy(key).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        ends = both.select(key, F.explode(F.array("lo", "hi")).alias("ts")).distinct()

        def extended(s: DataFrame) -> DataFrame:
            own = s.select(key, "ts", F.col("value").cast("double").alias("value"))
            missing = ends.join(s.select(key).distinct(), key, "left_semi").join(own, [key, "ts"], "left_anti")
            w = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
            rows = own.union(missing.select(key, "ts", F.lit(None).cast("double")))
            return rows.withColumn("value", F.coalesce(F.last("value", ignorenulls=True).over(w), F.lit(initial)))

        a, b = extended(a), extended(b)
    empty = F.array().cast("array<double>")
    return packed(a, "a").join(packed(b, "b"), key, "full").select(key, F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))


def three_sequence_table(cases: DataFrame, centroids: DataFrame, key: str, names: tuple[str, str, str] = ("D", "P", "C"), lag: int = 100) -> DataFrame:
    """key and, for each of three kinds of sequence and each centroid c1, c2 ..., the mean cross-correlation of the
    case's sequence with the centroid's, as columns `DvD1c`, `DvD2c` ... cases(key, label, values), centroids(label,
    centroid, values) with labels out of `names` and centroids numbered from 1."""
    numbers = sorted(r[0] for r in centroids.select(F.col("centroid").cast("int")).distinct().toLocalIterator())  # chosen, a few
    c = centroids.select(F.col("label").alias("__l"), F.col("centroid").cast("int").alias("__c"), F.col("values").alias("__v"))
    pairs = cases.join(c, F.col("label") == F.col("__l"))
    found = correlation_features(pairs, [key, "label", "__c"], "values", "__v", lag)
    columns = [f"{n}v{n}{k}c" for n in names for k in numbers]
    return found.withColumn("f", F.concat("label", F.lit("v"), "label", F.col("__c").cast("string"), F.lit("c"))).groupBy(key).pivot("f", columns).agg(F.first("ccf"))


def resample_reference(series: DataFrame, key: str, step: int = DAY, initial: float = 0.0) -> DataFrame:
    """(key, values): the same grid, where every point uses up exactly one event, so bursts lag behind and events left
    over at the end are lost. A fold over the sorted series."""
    packed = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("s"))
    grid = F.sequence(F.array_min(F.transform("s", lambda x: x["ts"])), F.array_max(F.transform("s", lambda x: x["ts"])), F.lit(step).cast("long"))

    def walk(a: Column, t: Column) -> Column:
        due = (a["i"] < F.size("s")) & (F.coalesce(F.get("s", a["i"])["ts"], F.lit(1 << 62)) <= t)
        value = F.when(due, F.get("s", a["i"])["value"]).otherwise(a["last"])
        return F.struct((a["i"] + F.when(due, 1).otherwise(0)).alias("i"), value.alias("last"), F.array_append(a["out"], value).alias("out"))

    start = F.struct(F.lit(0).alias("i"), F.lit(initial).alias("last"), F.array().cast("array<double>").alias("out"))
    return packed.select(key, F.aggregate(grid, start, walk, lambda a: a["out"]).alias("values"))


def cross_correlation(a: np.ndarray, b: np.ndarray, lag: int = 100, normalize: bool = True) -> np.ndarray:
    """Correlations of a and b at lags -lag..lag around the centre: of mean-centred values over the product of the
    deviations and the length, or, not normalised, of the values where both overlap wholly."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    if not len(a) or not len(b):
        return np.zeros(0)
    if not normalize:
        return np.correlate(a, b)
    full = np.correlate(a - a.mean(), b - b.mean(), mode="full")
    scale = a.std() * b.std() * len(b)
    full = full / scale if scale else full
    centre = (len(a) + len(b) - 2) // 2
    return full[max(0, centre - lag) : centre + lag + 1]


def correlation_features(pairs: DataFrame, key: list[str], a: str, b: str, lag: int = 100, missing: float = -123.0) -> DataFrame:
    """key and ccf: the mean cross-correlation of two value arrays, `missing` where one is empty. Arrow batches of whole
    rows, since a convolution is no expression."""

    @F.pandas_udf("double")
    def mean_ccf(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float(np.mean(cross_correlation(p, q, lag))) if len(p) and len(q) else missing for p, q in zip(x, y, strict=True)])

    empty = F.array().cast("array<double>")
    return pairs.select(*key, (F.round(mean_ccf(F.coalesce(a, empty), F.coalesce(b, empty)), 6) + 0.0).alias("ccf"))


def feature_table(cases: DataFrame, centroids: DataFrame, key: str, label: str, values: str, labels: list[str], lag: int = 100, beside: DataFrame | None = None) -> DataFrame:
    """key, the other columns of `beside` (a class, auxiliary values; null where a key has none) and one column
    label_centroid for each pair: mean cross-correlation of a case's sequence with each centroid of the same label.
    centroids(label, centroid, values) is a chosen, small table; beside has a row a key."""
    c = centroids.select(F.col(label).alias("__l"), F.col("centroid"), F.col(values).alias("__v"))
    pairs = cases.join(c, F.col(label) == F.col("__l"))  # broadcast by the engine where its statistics say it is small
    found = correlation_features(pairs, [key, label, "centroid"], values, "__v", lag)
    wide = found.withColumn("f", F.concat_ws("_", label, "centroid")).groupBy(key).pivot("f", labels).agg(F.first("ccf"))
    if beside is None:
        return wide
    return wide.join(beside, key, "left").select(key, *[c for c in beside.columns if c != key], *labels)


def enumerate_codes(rows: DataFrame, key: str, order: list[str], code: str) -> DataFrame:
    """(key, code, last): the last position (from 0) of each code in the key's sequence."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__p", F.row_number().over(w) - 1).groupBy(key, code).agg(F.max("__p").alias("last"))


def code_indicators(rows: DataFrame, key: str, code: str, codes: list[str]) -> DataFrame:
    """key, a 0/1 column for each code, and n, how many of them the key has."""
    flags = [F.max((F.col(code) == c).cast("int")).alias(f"has_{c}") for c in codes]
    out = rows.groupBy(key).agg(*flags)
    return out.withColumn("n", sum((F.col(f"has_{c}") for c in codes), F.lit(0)))


def top_codes(rows: DataFrame, code: str, n: int) -> DataFrame:
    return rows.groupBy(code).agg(F.count("*").alias("n")).orderBy(F.desc("n"), code).limit(n)


def indicator_sequences(rows: DataFrame, key: str, order: list[str], code: str, codes: list[str]) -> DataFrame:
    """(key, code, flags): for every key and chosen code whether each element of the key's sequence, in order, is that
    code, as 0 and 1, and as a last element how many are."""
    packed = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(code).alias("__c")))), lambda x: x["__c"]).alias("s"))
    each = packed.select(key, F.explode(F.array(*map(F.lit, codes))).alias("code"), "s")
    flags = F.transform("s", lambda x: F.coalesce((x == F.col("code")).cast("int"), F.lit(0)))
    return each.select(key, "code", F.array_append(flags, F.aggregate(flags, F.lit(0), lambda a, x: a + x)).alias("flags"))


def stamped_until(texts: Column, cutoff: Column) -> Column:
    """array<struct<value, ts>> of an array of `value@date`, up to the first whose date lies after the cutoff; entries that
    don't read as a number and a date are dropped. A null cutoff ends nothing."""
    each = F.transform(texts, split_stamped)
    late = F.array_min(F.transform(F.filter(F.transform(each, lambda x, i: F.struct(x["ts"].alias("ts"), i.alias("i"))), lambda x: x["ts"] > cutoff), lambda x: x["i"]))
    return F.filter(F.slice(each, F.lit(1), F.coalesce(late, F.size(each))), lambda x: x["ts"].isNotNull())


def pair_delta_stats(rows: DataFrame, key: str, ts: Column) -> DataFrame:
    """key, n, mean_delta, sd_delta of the times between any two events of a key, the later less the earlier: worked out
    from sums over the sorted events, not from the pairs."""
    w = Window.partitionBy(key).orderBy("__t")
    each = rows.where(ts.isNotNull()).select(key, ts.cast("double").alias("__t"))
    low = each.groupBy(key).agg(F.min("__t").alias("__low"))  # small numbers keep the squares exact
    at = each.withColumn("i", F.row_number().over(w)).join(low, key).withColumn("__t", F.col("__t") - F.col("__low"))
    sums = at.groupBy(key).agg(F.count("*").alias("k"), F.sum("__t").alias("s"), F.sum(F.col("__t") * F.col("__t")).alias("q"), F.sum(F.col("__t") * F.col("i")).alias("r"))
    n, mean = F.col("k") * (F.col("k") - 1) / 2, (2 * F.col("r") - (F.col("k") + 1) * F.col("s")) / (F.col("k") * (F.col("k") - 1) / 2)
    square = (F.col("k") * F.col("q") - F.col("s") * F.col("s")) / n
    return sums.where("k > 1").select(key, n.cast("long").alias("n"), F.round(mean, 4).alias("mean_delta"), F.round(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), 4).alias("sd_delta"))


def delta_stats(rows: DataFrame, key: str, ts: Column) -> DataFrame:
    """key, n, mean_delta, sd_delta of the times between consecutive events."""
    w = Window.partitionBy(key).orderBy("__t")
    at = rows.select(key, ts.alias("__t")).withColumn("d", F.col("__t") - F.lag("__t").over(w))
    return at.groupBy(key).agg(F.count("d").alias("n"), F.round(F.avg("d"), 6).alias("mean_delta"), F.round(F.stddev_pop("d"), 6).alias("sd_delta"))


def common_keys(tables: list[DataFrame], key: str, every: bool = True) -> DataFrame:
    """Keys found in every table, or in any."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.intersect(t.select(key)) if every else out.union(t.select(key)).distinct()
    return out


#: Python functions of this module travel with the plan, so workers need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
