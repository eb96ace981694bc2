"""Readers for line-oriented and delimited files. All of them give typed DataFrames and read in parallel; line numbers
are dense per file and taken from the order of the file's splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(lines: DataFrame) -> DataFrame:
    """Adds line_num, 1-based and dense, in the order of the input.

    Only per-partition counts meet in one place: numbers are offsets of partitions plus ranks within them.
    """
    at = lines.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    counts = at.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return at.join(F.broadcast(offsets), "__part").withColumn("line_num", F.col("__before") + within + 1).drop("__id", "__part", "__before")


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8", whole: bool = False) -> DataFrame:
    """(value) lines, or with whole one row per file; other encodings are decoded on the way."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        return spark.read.text(path, wholetext=whole)
    raw = spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("value"))
    return raw if whole else raw.select(F.explode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("value"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Directory listing of a glob: path, size, modified."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_delimited(spark: SparkSession, path: str, delim: str = "\t", header: bool = True, comment: str | None = None, strict: bool = False) -> DataFrame:
    """All-text columns; quoted fields may hold delimiters. With strict, malformed rows are dropped."""
    reader = spark.read.option("sep", delim).option("quote", '"').option("header", header).option("mode", "DROPMALFORMED" if strict else "PERMISSIVE")
    return (reader.option("comment", comment) if comment else reader).csv(path)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """A sheet by way of pandas, where an Excel engine is installed."""
    return spark.createDataFrame(pd.read_excel(path, dtype=str))


def fields(line: Column, delim: str = "\t") -> Column:
    """The fields of a line, empty ones kept."""
    return F.split(line, "\\Q" + delim + "\\E", -1)


def key_values(lines: DataFrame, delim: str = "\t", retain_case: bool = False, skip_header: bool = False) -> DataFrame:
    """(key, value) of lines(value[, line_num]) split at the first delimiter; lines without one are dropped, the last of
    equal keys counts. Lower-cased unless retain_case."""
    lines = lines if "line_num" in lines.columns else numbered(lines)
    text = F.col("value") if retain_case else F.lower("value")
    at = F.instr(text, delim)
    kept = lines.where(F.col("line_num") > 1) if skip_header else lines
    rows = kept.select("line_num", text.alias("t"), at.alias("at")).where("at > 0")
    pairs = rows.select("line_num", F.expr("left(t, at - 1)").alias("key"), F.expr(f"substring(t, at + {len(delim)})").alias("value"))
    return pairs.groupBy("key").agg(F.max_by("value", "line_num").alias("value"))


def two_fields(lines: DataFrame, delim: str = "\t") -> DataFrame:
    """(key, value) of the lines that have exactly two fields."""
    f = fields(F.col("value"), delim)
    return lines.where(F.size(f) == 2).select(F.get(f, F.lit(0)).alias("key"), F.get(f, F.lit(1)).alias("value"))


def unique_keys(pairs: DataFrame) -> DataFrame:
    """pairs(key, value); evaluating the result raises if a key occurs twice."""
    counted = pairs.groupBy("key").agg(F.first("value").alias("value"), F.count("*").alias("n"))
    return counted.select("key", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), "key"))).otherwise(F.col("value")).alias("value"))


def indicators(lines: DataFrame) -> DataFrame:
    """(key): distinct trimmed, lower-cased lines."""
    return lines.select(F.lower(F.trim("value")).alias("key")).where("key <> ''").distinct()


def multimap(lines: DataFrame, delim: str = "\t") -> DataFrame:
    """(key, values) in line order of lines with a key and at least one value."""
    lines = lines if "line_num" in lines.columns else numbered(lines)
    f = fields(F.col("value"), delim)
    rows = lines.where(F.size(f) > 1).select(F.get(f, F.lit(0)).alias("key"), "line_num", F.slice(f, F.lit(2), F.size(f) - 1).alias("v"))
    return rows.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "v"))), lambda x: x["v"])).alias("values"))


def phrases(lines: DataFrame, most_words: int = 25) -> DataFrame:
    """(phrase, words, n, value) of `phrase[<tab>value]` lines; longer phrases are dropped."""
    words = F.split(F.trim(F.regexp_extract("value", r"^([^\t]*)", 1)), r"\s+")
    value = F.coalesce(F.nullif(F.regexp_extract("value", r"\t(.*)$", 1), F.lit("")), F.lit("True"))
    rows = lines.select(F.array_join(words, " ").alias("phrase"), words.alias("words"), F.size(words).alias("n"), value.alias("value"))
    return rows.where((F.col("phrase") != "") & (F.col("n") <= most_words))


def rewrite_rules(lines: DataFrame) -> DataFrame:
    """(source, targets) of `source => target, target` lines."""
    parts = F.split("value", r"\s*=>\s*")
    return lines.where(F.contains("value", F.lit("=>"))).select(F.trim(F.get(parts, F.lit(0))).alias("source"), F.split(F.trim(F.get(parts, F.lit(1))), r"\s*,\s*").alias("targets"))


def frequencies(lines: DataFrame, delim: str = "\t") -> DataFrame:
    """(term, freq[, tag]) of two- or three-field lines; # lines are comments, the first of equal terms counts."""
    lines = lines if "line_num" in lines.columns else numbered(lines)
    f = fields(F.col("value"), delim)
    rows = lines.where(~F.col("value").rlike(r"^\s*(#|$)")).where(F.size(f).isin(2, 3))
    rows = rows.select("line_num", F.lower(F.get(f, F.lit(0))).alias("term"), F.element_at(f, -1).try_cast("double").alias("freq"), F.when(F.size(f) == 3, F.get(f, F.lit(1))).alias("tag"))
    return rows.groupBy("term").agg(F.min_by("freq", "line_num").alias("freq"), F.min_by("tag", "line_num").alias("tag"))


def labelled_texts(lines: DataFrame) -> DataFrame:
    """(label, text) of `label<tab>text` lines of exactly two fields; labels lower-cased."""
    pairs = two_fields(lines)
    return pairs.select(F.lower("key").alias("label"), F.col("value").alias("text"))


def examples(table: DataFrame, layout: str) -> DataFrame:
    """(guid, text_a, text_b, label) of a table of unnamed columns _c0.. in the layout of a public benchmark."""
    #: Column numbers of text_a, text_b and label.
    columns = {"cola": (3, None, 1), "mrpc": (3, 4, 0), "mnli": (8, 9, -1), "xnli": (6, 7, 1), "multi": (3, None, 1)}
    a, b, label = columns[layout]
    names = table.columns
    pick = lambda k: F.col(names[k]) if k is not None else F.lit(None).cast("string")
    return table.select(F.col(names[0]).alias("guid"), pick(a).alias("text_a"), pick(b).alias("text_b"), pick(label).alias("label"))


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, tokens) of an XML dump, template pages left out."""
    pages = spark.read.format("xml").option("rowTag", "page").load(path)
    text = F.col("revision.text._VALUE") if "_VALUE" in str(pages.schema) else F.col("revision.text")
    tokens = F.array_join(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), " ")
    return pages.where(~F.startswith(F.lower("title"), F.lit("template:"))).select("title", tokens.alias("tokens"))


def without_comments(lines: DataFrame) -> DataFrame:
    """lines without blank ones and those that begin with # or ;."""
    return lines.where(~F.col("value").rlike(r"^\s*([#;]|$)"))


def timed_codes(lines: DataFrame) -> DataFrame:
    """(key, ts, code) of `key,date,code` lines; lines of other shapes and blank codes are dropped, keys lower-cased."""
    from quern.functions.scalars import parse_timestamp

    f = F.split("value", ",", -1)
    rows = lines.where((F.size(f) == 3) & (F.trim(F.get(f, F.lit(2))) != ""))
    return rows.select(F.lower(F.trim(F.get(f, F.lit(0)))).alias("key"), parse_timestamp(F.trim(F.get(f, F.lit(1)))).alias("ts"), F.trim(F.get(f, F.lit(2))).alias("code"))


def spaced_fields(lines: DataFrame) -> DataFrame:
    """(fields) of lines split at white space, without rulers of dashes."""
    return lines.where(~F.col("value").rlike(r"^\s*-{3,}")).select(F.split(F.trim("value"), r"\s+").alias("fields"))


def fetched(urls: DataFrame, fetch, column: str = "url") -> DataFrame:
    """urls with body: what the given function returns for each address, null where it fails. Fetching runs in Arrow
    batches on the executors; the function decides on caching and retries."""
    @F.pandas_udf("string")
    def get(u: pd.Series) -> pd.Series:
        def one(x):
            try:
                return fetch(x)
            except OSError:
                return None

        return u.map(one)

    return urls.withColumn("body", get(F.col(column)))


def extracted_texts(spark: SparkSession, path: str, extract) -> DataFrame:
    """(path, text) of binary documents by a function bytes -> str, in Arrow batches."""
    @F.pandas_udf("string")
    def text(b: pd.Series) -> pd.Series:
        return b.map(extract)

    return spark.read.format("binaryFile").load(path).select("path", text("content").alias("text"))


def read_rows(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(name, content) of what writers.write_rows has written, or of the named records only, for which the files that may
    hold them are read."""
    rows = spark.read.parquet(path)
    return rows if names is None else rows.where(F.col("name").isin(*names))
