"""Phrase tables and prefix lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.automaton import COMPILED_BYTES, load_trie, spot


def prefixes(entries: DataFrame, words: str) -> DataFrame:
    """(prefix): the distinct word prefixes of the entries, the nodes of a trie without its root."""
    return entries.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("prefix")).distinct()


def find_prefix(entries: DataFrame, key: str, prefix: str) -> DataFrame:
    return entries.where(F.startswith(F.col(key), F.lit(prefix)))


def delete(entries: DataFrame, key: str, value: str, k=None, v=None, prefix: str | None = None) -> DataFrame:
    """Entries but those with the key, the value, both if both are given, or the prefix."""
    bad = F.lit(True)
    for test in ([F.col(key) == k] if k is not None else []) + ([F.col(value) == v] if v is not None else []) + ([F.startswith(F.col(key), F.lit(prefix))] if prefix is not None else []):
        bad = bad & test
    return entries.where(~F.coalesce(bad, F.lit(False)))


def entities(docs: DataFrame, doc: str, words: Column, gazetteer: DataFrame) -> DataFrame:
    """(doc, start, n, entity): `TYPE:text` of the longest gazetteer(phrase, value) phrases, the value being the type."""
    return spot_phrases(docs, doc, words, gazetteer).select(doc, "start", "n", F.concat("value", F.lit(":"), "phrase").alias("entity"))


def spot_phrases(docs: DataFrame, doc: str, words: Column, phrases: DataFrame, most: int | None = None, compiled: int = COMPILED_BYTES) -> DataFrame:
    """(doc, start, n, phrase, value): the longest table phrase at each place, from left to right, skipping what it spans.

    A table of up to `compiled` bytes becomes a trie that travels to the texts. Of a larger one, n-grams of the lengths
    it has meet it in a hash join; what starts where is then settled per document by a fold over its candidates. Phrases
    of every length the table has are matched (with `most`, up to that).
    """
    table = phrases.select("phrase", "value").where(F.size(F.split("phrase", " ")) <= most) if most else phrases.select("phrase", "value")
    trie = load_trie(table, compiled)
    return spot(docs, doc, words, trie) if trie else _spot_by_join(docs, doc, words, table)


def _spot_by_join(docs: DataFrame, doc: str, words: Column, phrases: DataFrame) -> DataFrame:
    table = phrases.where("phrase <> ''").groupBy("phrase").agg(F.min("value").alias("value"))
    table = table.withColumn("n", F.size(F.split("phrase", " ")))
    sizes = sorted(r["n"] for r in table.select("n").distinct().collect())  # a row a length
    base = docs.select(doc, words.alias("w"))
    places = base.where(F.size("w") > 0).select(doc, "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    lens = F.array(*[F.lit(n) for n in sizes])
    grams = F.transform(F.filter(lens, lambda n: F.col("i") + n - 1 <= F.size("w")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("w", F.col("i"), n), " ").alias("phrase")))
    each = places.select(doc, (F.col("i") - 1).alias("start"), F.explode(grams).alias("g")).select(doc, "start", "g.phrase")
    hits = each.join(table, "phrase")
    longest = hits.groupBy(doc, "start").agg(F.max_by(F.struct("n", "phrase", "value"), "n").alias("x"))  # a later fold needs one a place
    sorted_ = longest.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", "x"))).alias("c"))
    # The fold keeps ends only, a number a place, so it stays linear: a place counts if no phrase before it covers it.
    ends = F.aggregate(
        "c",
        F.struct(F.lit(0).alias("end"), F.lit("").alias("taken")),
        lambda a, x: F.struct(F.when(x["start"] >= a["end"], x["start"] + x["x"]["n"]).otherwise(a["end"]).alias("end"), F.concat(a["taken"], F.when(x["start"] >= a["end"], F.lit("1")).otherwise(F.lit("0"))).alias("taken")),
        lambda a: a["taken"],
    )
    kept = sorted_.withColumn("t", ends).select(doc, F.explode(F.filter("c", lambda x, i: F.substr("t", i + 1, F.lit(1)) == "1")).alias("y"))
    return kept.select(doc, "y.start", F.col("y.x.n").alias("n"), F.col("y.x.phrase").alias("phrase"), F.col("y.x.value").alias("value"))
