"""Relational tools: cutting, filtering, looking up, merging, transposing, relating, sampling, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def field_numbers(spec: str) -> list[int]:
    """`7,9 11-13` -> [7, 9, 11, 12, 13]; ranges include both ends."""
    out = []
    for part in spec.replace(",", " ").split():
        a, _, b = part.partition("-")
        out += range(int(a), int(b or a) + 1)
    return out


def cut_fields(rows: Column, numbers: list[int], delim: str = "\t") -> Column:
    """The numbered fields (from 1) of an array, joined; order and repeats as given, missing ones empty."""
    return F.concat_ws(delim, *[F.coalesce(F.get(rows, F.lit(n - 1)), F.lit("")) for n in numbers])


def convert_delimiter(line: Column, old: str, new: str = "\t") -> Column:
    return F.replace(line, F.lit(old), F.lit(new))


def matching_lines(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(F.col(column).rlike(pattern))


def extract_matches(df: DataFrame, column: str, pattern: str, groups: int = 1) -> DataFrame:
    """m1..mn of the rows that match; a pattern without a group stands for itself."""
    pattern = pattern if "(" in pattern else f"({pattern})"
    return df.where(F.col(column).rlike(pattern)).select("*", *[F.regexp_extract(column, pattern, k).alias(f"m{k}") for k in range(1, groups + 1)])


def match_place(text: Column, pattern: str) -> Column:
    """struct<start, end> of the first match, from 0 and behind its last character; null without a match."""
    pattern = f"({pattern})"
    start = F.regexp_instr(text, F.lit(pattern)) - 1
    return F.when(text.rlike(pattern), F.struct(start.alias("start"), (start + F.length(F.regexp_extract(text, pattern, 1))).alias("end")))


def filter_rows(df: DataFrame, key: Column, cases: DataFrame, case: str, exclude: bool = False) -> DataFrame:
    """Rows whose key is (or with exclude: isn't) among the cases. A null key is kept only with exclude. The cases are
    joined as they are; the engine broadcasts them where statistics say they are small."""
    keys = cases.select(F.col(case).alias("__case")).distinct()
    return df.withColumn("__key", key).join(keys, F.col("__key") == F.col("__case"), "left_anti" if exclude else "left_semi").drop("__key")


def insert_field(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, name: str, at: int = -1) -> DataFrame:
    """The table's value for the key as a new column, empty where there is none, before column number `at` (from 1; -1:
    last)."""
    side = table.select(F.col(table_key).alias("__k"), F.col(value).alias("__v")).groupBy("__k").agg(F.max("__v").alias("__v"))
    joined = df.join(side, F.col(key) == F.col("__k"), "left")
    columns = [F.col(c) for c in df.columns]
    columns.insert(len(columns) if at < 0 else at - 1, F.coalesce(F.col("__v").cast("string"), F.lit("")).alias(name))
    return joined.select(*columns)


def merge_lists(a: DataFrame, b: DataFrame, key: str, values: str, how: str = "full") -> DataFrame:
    """Lists of equal keys one after the other; with how='left' only keys of a."""
    b = b.select(F.col(key).alias("__k"), F.col(values).alias("__v"))
    none = F.array().cast(dict(a.dtypes)[values])
    joined = a.join(b, F.col(key) == F.col("__k"), how)
    return joined.select(F.coalesce(key, "__k").alias(key), F.concat(F.coalesce(values, none), F.coalesce("__v", none)).alias(values))


def with_features(df: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Left join on the key, missing features 0."""
    names = [c for c in features.columns if c != key]
    return df.join(features, key, "left").fillna(0, names).fillna("0", names)


def first_row_for(df: DataFrame, column: str, order: str) -> DataFrame:
    """The first row by `order` of each value."""
    row = F.min_by(F.struct(*df.columns), F.col(order)).alias("__row")
    return df.groupBy(F.col(column).alias("__k")).agg(row).select("__row.*")


def transposed_cells(df: DataFrame, order: str, columns: list[str], missing: str = "n/a") -> DataFrame:
    """(position, name, row, value): the transposed table as cells, row being the order column's value; for tables of any
    length, written in blocks of rows by the caller."""
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value")) for i, c in enumerate(columns)])
    return df.select(F.col(order).alias("row"), F.explode(cells).alias("x")).select("x.position", "x.name", "row", "x.value")


def transpose(df: DataFrame, order: str, columns: list[str], missing: str = "n/a") -> DataFrame:
    """(position, name, values): a row per column with its values in row order, joined by tabs; a line of the result
    holds a whole column, so this is for tables whose columns fit into a row (else transposed_cells)."""
    cells = transposed_cells(df, order, columns, missing)
    grouped = cells.groupBy("position", "name").agg(F.array_sort(F.collect_list(F.struct(F.col("row").alias("o"), F.col("value").alias("v")))).alias("s"))
    return grouped.select("position", "name", F.array_join(F.transform("s", lambda x: x["v"]), "\t").alias("values"))


def unpivot(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """ids, name, value: a row per column."""
    text = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot(ids, columns, "name", "value")


def elide_repeats(df: DataFrame, column: str, partition: list[str], order: list[str], mark: str = ".") -> DataFrame:
    """A value equal to the one of the row before becomes the mark."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(column, F.when(F.col(column) == F.lag(column).over(w), F.lit(mark)).otherwise(F.col(column)))


def relative_table(df: DataFrame, label: str, category: str, value: str, reference: str) -> DataFrame:
    """Adds reference (value of the row whose label names the reference category), diff (relative difference to three
    places, null for a missing or zero reference) and shown: `v (diff)`, `v (*)` for reference rows, `v (n/a)`."""
    ref = df.select(F.col(label).alias("__l"), F.col(value).alias("__r"))
    wanted = F.replace(F.col(label), F.col(category), F.lit(reference))
    joined = df.join(ref, wanted == F.col("__l"), "left")
    diff = F.when(F.col("__r") != 0, F.round((F.col(value) - F.col("__r")) / F.col("__r"), 3))
    note = F.when(F.col(category) == reference, F.lit("*")).otherwise(F.coalesce(F.format_string("%.3f", diff), F.lit("n/a")))
    out = joined.withColumn("diff", diff).withColumn("shown", F.concat(F.format_string("%.3f", F.col(value)), F.lit(" ("), F.when(diff.isNull() & (F.col(category) != reference), F.lit("n/a")).otherwise(note), F.lit(")")))
    return out.withColumnRenamed("__r", "reference").drop("__l")


def hash_sample(df: DataFrame, key: str, percent: int, seed: str = "s") -> DataFrame:
    """A repeatable sample: rows whose hashed key falls under the percentage."""
    return df.where(F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(100)) < percent)


def bernoulli_sample(df: DataFrame, ratio: float, seed: int | None = None) -> DataFrame:
    return df.sample(False, ratio, seed)


def shuffle_rows(df: DataFrame, seed: int) -> DataFrame:
    """All rows in random order; sorted by range partition, not in one task."""
    return df.orderBy(F.rand(seed))


def split_round_robin(df: DataFrame, number: str, n: int) -> DataFrame:
    """Adds split: row i (from 0, dense column `number`) goes to split i mod n."""
    return df.withColumn("split", F.pmod(F.col(number), F.lit(n)))


def fold_of(df: DataFrame, key: str, k: int) -> DataFrame:
    """Adds fold: a repeatable fold from the hashed key."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def row_range(df: DataFrame, order: list[str], start: int, count: int) -> DataFrame:
    """Rows start.. (from 0) of the ordered table."""
    return df.orderBy(*order).offset(start).limit(count)


def top_weighted(df: DataFrame, weight: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(weight), F.asc(tie)).limit(n)


def normalize(df: DataFrame, value: str, partition: list[str]) -> DataFrame:
    """Adds share: value over the sum of its partition, by an aggregate joined back."""
    sums = df.groupBy(*partition).agg(F.sum(value).alias("__sum"))
    joined = df.join(sums, partition) if partition else df.crossJoin(F.broadcast(sums))  # one row
    return joined.withColumn("share", F.col(value) / F.col("__sum")).drop("__sum")


def is_sorted(df: DataFrame, column: str, partition: list[str], order: list[str]) -> DataFrame:
    """partition, sorted: whether the column never falls."""
    w = Window.partitionBy(*partition).orderBy(*order)
    falls = df.select(*partition, (F.lag(column).over(w) > F.col(column)).alias("f"))
    return falls.groupBy(*partition).agg((F.count_if("f") == 0).alias("sorted"))


def feature_codes(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, code): values numbered from 0 in the order they are first seen."""
    first = df.groupBy(value).agg(F.min(order).alias("__at"))
    # Ranges of the order column are numbered one by one; a range's offset is how many values come before it.
    bounds = sorted(set(first.select(F.percentile_approx("__at", [x / 256 for x in range(1, 256)], 4096)).first()[0] or []))
    part = F.aggregate(F.array(*[F.lit(x) for x in bounds]), F.lit(0), lambda a, x: a + F.when(F.col("__at") > x, 1).otherwise(0)) if bounds else F.lit(0)
    ranged = first.withColumn("__p", part)
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    offsets = ranged.groupBy("__p").agg(F.count("*").alias("n")).select("__p", before.alias("__b"))
    at = F.row_number().over(Window.partitionBy("__p").orderBy("__at", value))
    return ranged.join(F.broadcast(offsets), "__p").select(value, (F.col("__b") + at - 1).cast("long").alias("code"))  # at most 256 rows


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, distinct, low, high) in one pass over the table."""
    parts = []
    for c in columns:
        parts += [F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.count_distinct(c).alias(f"d_{c}"), F.min(F.col(c).cast("string")).alias(f"l_{c}"), F.max(F.col(c).cast("string")).alias(f"h_{c}")]
    one = df.agg(*parts)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.col(f"d_{c}").alias("distinct"), F.col(f"l_{c}").alias("low"), F.col(f"h_{c}").alias("high")) for c in columns])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def select_existing(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that there are, in the given order; other names are ignored."""
    return df.select(*[c for c in names if c in df.columns])


def remap_ids(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """df with ids of mapping(old, new) replaced; ids without an entry stay."""
    m = mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    joined = df.join(m, F.col(column) == F.col("__old"), "left")
    return joined.withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def summary(df: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, population deviation, low and high."""
    c = F.col(column)
    return df.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("sd"), F.min(c).alias("low"), F.max(c).alias("high"))


def random_keys(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k distinct keys in a seeded order of their hashes, so that the choice doesn't depend on how rows are dealt."""
    return df.select(key).distinct().orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(k)


def frequency_listing(df: DataFrame, item: str, n: int) -> DataFrame:
    """(line): `item<tab>count` of the n most frequent items."""
    top = top_weighted(df.groupBy(item).agg(F.count("*").alias("n")), "n", item, n)
    return top.select(F.concat_ws("\t", F.col(item).cast("string"), F.col("n").cast("string")).alias("line"))


def coded_features(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and, for each text column, a double: numbers as they are; other values, zeros included, numbered from 0 in
    the order they are first seen by key; `null` is null."""
    from quern.functions.scalars import is_numeric

    out = df.select(key, *columns)
    for c in columns:
        symbolic = (F.col(c) != "null") & (~is_numeric(F.col(c)) | (F.col(c).try_cast("double") == 0))
        codes = feature_codes(df.where(symbolic).select(key, c), c, key).select(F.col(c).alias("__v"), F.col("code").alias("__c"))
        out = out.join(codes, F.col(c) == F.col("__v"), "left")
        out = out.withColumn(c, F.when(F.col(c) == "null", None).otherwise(F.coalesce(F.col("__c").cast("double"), F.col(c).try_cast("double")))).drop("__v", "__c")
    return out
