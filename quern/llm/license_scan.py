"""Licence scan with a positional index of rare words: each file's licence words of highest IDF are looked up, their template
positions are intersected by relative position, and a template counts once its mandatory key phrases are found too. IDF is
taken over the files themselves. Built from DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import alnum_words, Scratch
from quern.llm.license_texts import TEMPLATES

#: Phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
Templates = dict[str, tuple[str, tuple[str, ...]]]


def template_words(text: str) -> list[str]:
    """The words of a template, taken like those of a file."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def document_frequencies(docs: DataFrame, templates: Templates) -> dict[str, int]:
    """In how many files each word of the templates stands; as many rows as the templates have words."""
    vocabulary = sorted({w for text, _ in templates.values() for w in template_words(text)})
    if not vocabulary:
        return {}
    known = F.array_intersect(alnum_words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(known).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return {r["word"]: r["df"] for r in rows.toLocalIterator()}


def rarest_first(templates: Templates, df: dict[str, int]) -> dict[str, list[str]]:
    """label -> the template's words that some file has, by falling IDF; ties go to the word that comes first."""
    out = {}
    for label, (text, _) in templates.items():
        words = list(dict.fromkeys(template_words(text)))
        out[label] = sorted((w for w in words if df.get(w)), key=lambda w: (df[w], words.index(w)))
    return out


def _contains(text: Column, phrase: str) -> Column:
    return F.contains(text, F.lit(f" {phrase} "))


def _places(words: Column, count: Column, joined: Column, phrase: str) -> Column:
    """0-based starts of the phrase; positions are only looked for in texts that hold it."""
    parts = phrase.split()
    same = lambda i: F.slice(words, i + 1, len(parts)) == F.array(*map(F.lit, parts))
    every = F.filter(F.sequence(F.lit(0), count - len(parts)), same)
    return F.when((count >= len(parts)) & _contains(joined, phrase), every).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, templates: Templates | None = None, min_share: float = 0.75, rare: int = 8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, template_labels for every row of docs.

    Of each template whose key phrases stand in a file, the `rare` words of highest IDF among those that the file has are
    looked up. Its share is the part of their IDF that is found at one offset between file and template, give or take a
    tenth of the template's length, so that words put in don't break it; a file with less than half of a template's words
    (or `rare` of them) has none. From min_share on the label is given. score is the highest such share, or 1 where a
    base phrase stands. Null and empty texts have no words; rows equal in id and text get the same result, null ids are
    ids like others; labels of equal shares all stand; an empty table has no IDF and gives no rows; other columns aren't
    looked at.
    """
    templates = TEMPLATES if templates is None else templates
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    df, n_docs = document_frequencies(docs, templates), docs.count()
    ranked = rarest_first(templates, df)
    weight = {w: math.floor(1000 * math.log((n_docs + 1) / d)) + 1 for w, d in df.items()}
    weights = F.create_map(*[F.lit(x) for w, v in weight.items() for x in (w, v)]) if weight else F.create_map().cast("map<string,int>")
    vocabulary = sorted(set(weight) | {p.split()[0] for p in BASE})
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), alnum_words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    known = F.arrays_overlap(F.col("w"), F.array(*map(F.lit, vocabulary)))
    base = base.withColumn("joined", F.when(known, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))).otherwise(F.lit("")))
    labelled = lambda label: lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))
    places = F.concat(*[F.transform(_places(F.col("w"), F.col("n"), F.col("joined"), p), labelled(BASE[p])) for p in BASE])

    def looked_up(label: str) -> Column:
        """The label and the words to be looked up, where all key phrases stand."""
        stands = F.lit(bool(ranked[label]))
        for p in templates[label][1]:
            stands = stands & _contains(F.col("joined"), p)
        own = F.slice(F.array_intersect(F.array(*map(F.lit, ranked[label] or [""])), F.col("w")), 1, rare)
        return F.when(stands, F.struct(F.lit(label).alias("label"), own.alias("words")))

    kind = "array<struct<label:string,words:array<string>>>"
    allowed = F.array_compact(F.array(*map(looked_up, sorted(templates)))) if templates else F.array().cast(kind)
    base = base.withColumn("places", F.when(F.col("joined") != "", places)).withColumn("allowed", F.when(F.col("joined") != "", allowed))
    wanted = F.array_distinct(F.flatten(F.transform("allowed", lambda x: x["words"])))
    found = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains(F.col("wanted"), x["word"]))
    files = base.withColumn("wanted", F.when(F.size("allowed") > 0, wanted)).select(
        "doc_id",
        "th",
        F.col("n").cast("long").alias("n_words"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda x: x["at"])).cast("long").alias("last_word"),
        F.coalesce(F.array_distinct(F.transform("places", lambda x: x["label"])), F.array().cast("array<string>")).alias("base"),
        "allowed",
        F.when(F.col("wanted").isNotNull(), found).alias("found"),
    )
    files = scratch.table(files, "files")  # a few numbers a file; words only where all key phrases of a template stand
    rows = []
    for label, (text, _) in templates.items():
        words = template_words(text)
        rows += [(label, w, i, max(1, len(words) // 10), min(rare, (len(set(words)) + 1) // 2)) for i, w in enumerate(words) if w in weight]
    postings = spark.createDataFrame(rows or [("", "", 0, 1, 1)], "label string, word string, pos int, slack int, least int")
    told = files.where(F.size("found") > 0).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", F.explode("allowed").alias("a"), "found")
    total = F.aggregate("a.words", F.lit(0), lambda x, w: x + F.element_at(weights, w))
    hits = told.select("doc_id", "th", "a.label", F.size("a.words").alias("k"), total.alias("total"), F.explode(F.filter("found", lambda x: F.array_contains(F.col("a.words"), x["word"]))).alias("hit"))
    at = hits.select("doc_id", "th", "label", "k", "total", "hit.word", "hit.at", F.element_at(weights, F.col("hit.word")).alias("weight")).join(F.broadcast(postings), ["label", "word"]).where("k >= least")  # the templates' words
    step = F.floor((F.col("at") - F.col("pos")) / F.col("slack"))
    each = at.select("doc_id", "th", "label", "total", "word", "weight", F.explode(F.array(step, step - 1)).alias("step"))
    once = each.groupBy("doc_id", "th", "label", "total", "step", "word").agg(F.max("weight").alias("weight"))
    at_offset = once.groupBy("doc_id", "th", "label", "step").agg((F.sum("weight") / F.max("total")).alias("share"))
    told = at_offset.groupBy("doc_id", "th").agg(F.collect_set(F.when(F.col("share") >= min_share, F.col("label"))).alias("found"), F.max("share").alias("share"))
    told = told.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.array_sort("found").alias("labels_found"), "share")
    rows = files.drop("found").join(told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    rows = rows.withColumn("labels_found", F.coalesce("labels_found", F.array().cast("array<string>")))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "labels_found")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.array_join("labels_found", ",").alias("template_labels"),
    )
