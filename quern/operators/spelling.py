"""Spelling: unknown words, suggestions by edit distance, replacements by frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vocabulary(index: DataFrame, min_df: int = 1) -> DataFrame:
    """(term, df) of a postings table."""
    return index.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)


def unknown_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct words that aren't in the vocabulary."""
    return words.select("word").distinct().join(vocabulary.select(F.col("term").alias("word")), "word", "left_anti")


def suggest(words: DataFrame, vocabulary: DataFrame, accuracy: float = 0.75, k: int = 5, shortest: int = 4) -> DataFrame:
    """(word, term, df, distance, similarity, rank): the k nearest vocabulary terms of each word, with similarity
    1 - distance / longer length of at least `accuracy`.

    Words of fewer than `shortest` characters or with a leading digit are skipped. For each length m of a term, which says
    how many edits d are allowed, a word is cut into d + 1 parts, of which a term within distance d has one: candidates
    meet on (m, part, place) instead of all with all. Of the first parts that together have no more edits than parts
    before the last of them, the last is untouched: part i, from 0, has i edits at most before it and d - i after it,
    which bounds how far it is shifted.
    """
    checked = words.select("word").distinct().where((F.length("word") >= shortest) & ~F.col("word").rlike("^[0-9]"))
    sized = checked.select("word", F.length("word").alias("n"))
    w = sized.select("word", "n", F.explode(F.sequence(F.greatest(F.lit(2), F.floor(accuracy * F.col("n")).cast("int") - 1), F.ceil(F.col("n") / accuracy).cast("int") + 1)).alias("m"))
    w = w.withColumn("d", F.floor((1 - accuracy) * F.greatest("n", "m")).cast("int")).where(F.abs(F.col("m") - F.col("n")) <= F.col("d"))
    w = w.withColumn("size", F.floor(F.col("n") / (F.col("d") + 1)).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("i"))
    cut = w.select("word", "m", "i", (F.col("m") - F.col("n")).alias("longer"), (F.col("d") - F.col("i")).alias("after"), (F.col("i") * F.col("size")).alias("own"), F.when(F.col("i") < F.col("d"), F.col("size")).otherwise(F.col("n") - F.col("d") * F.col("size")).alias("len"))
    first, last = F.greatest(-F.col("i"), F.col("longer") - F.col("after")), F.least(F.col("i"), F.col("longer") + F.col("after"))
    part = F.substr("word", F.col("own") + 1, F.col("len")).alias("part")
    shifted = cut.where(first <= last).select("word", "m", "len", part, "own", F.explode(F.sequence(first, last)).alias("by")).select("word", "m", "len", "part", (F.col("own") + F.col("by")).alias("at")).where(F.col("at") >= 0)
    grams = _grams(vocabulary.where(F.length("term") >= 2), shifted.select("m", "len", "at").distinct())
    met = shifted.select("word", "m", "part", "at").join(grams, ["m", "part", "at"]).select("word", "term", "df").distinct().where("word <> term")
    scored = met.withColumn("distance", F.levenshtein("word", "term")).withColumn("similarity", F.round(1 - F.col("distance") / F.greatest(F.length("word"), F.length("term")), 6))
    good = scored.where(F.col("distance") <= (1 - accuracy) * F.greatest(F.length("word"), F.length("term")))
    order = Window.partitionBy("word").orderBy(F.desc("similarity"), F.desc("df"), "term")
    return good.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _grams(v: DataFrame, places: DataFrame) -> DataFrame:
    """(term, df, m, part, at): the substrings of `len` characters at place `at` of the terms of m characters, for each row
    (m, len, at) of places, which lengths of words bound."""
    at = v.join(F.broadcast(places), F.length("term") == F.col("m"))
    return at.select("term", "df", "m", F.substr("term", F.col("at") + 1, F.col("len")).alias("part"), "at")


def variants(pairs: DataFrame, a: str, b: str, derived: DataFrame | None = None, rewrites: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """pairs with variant: whether two words are forms of one another: by a plural or possessive s, by the table
    derived(word, form) in either direction, by rewrite rules (source, targets) as readers.rewrite_rules gives them, or
    by a common root in roots(word, root)."""
    plain = (F.col(a) == F.concat(F.col(b), F.lit("s"))) | (F.col(b) == F.concat(F.col(a), F.lit("s")))
    plain = plain | (F.col(a) == F.concat(F.col(b), F.lit("'s"))) | (F.col(b) == F.concat(F.col(a), F.lit("'s")))
    out = pairs.withColumn("variant", plain)
    links = []
    if derived is not None:
        links.append(derived.select(F.col("word").alias("__x"), F.col("form").alias("__y")))
    if rewrites is not None:
        links.append(rewrites.select(F.col("source").alias("__x"), F.explode("targets").alias("__y")))
    if links:
        both = links[0] if len(links) == 1 else links[0].union(links[1])
        both = both.union(both.select(F.col("__y").alias("__x"), F.col("__x").alias("__y"))).distinct().withColumn("__v", F.lit(True))
        out = out.join(both, (F.col(a) == F.col("__x")) & (F.col(b) == F.col("__y")), "left").withColumn("variant", F.col("variant") | F.coalesce("__v", F.lit(False))).drop("__x", "__y", "__v")
    if roots is not None:
        one = roots.groupBy("word").agg(F.min("root").alias("root"))
        x, y = one.select(F.col("word").alias("__x"), F.col("root").alias("__rx")), one.select(F.col("word").alias("__y"), F.col("root").alias("__ry"))
        out = out.join(x, F.col(a) == F.col("__x"), "left").join(y, F.col(b) == F.col("__y"), "left")
        out = out.withColumn("variant", F.col("variant") | F.coalesce(F.col("__rx") == F.col("__ry"), F.lit(False))).drop("__x", "__y", "__rx", "__ry")
    return out


def replacement(suggestions: DataFrame, freqs: DataFrame, min_gain: float = 3.0, most_df: int = 10) -> DataFrame:
    """(word, replacement, gain): the suggestion of highest document frequency, if the word itself is rare (df at most
    most_df) and the suggestion min_gain times as frequent. Plural and possessive variants are no replacements."""
    variant = (F.col("term") == F.concat("word", F.lit("s"))) | (F.col("word") == F.concat("term", F.lit("s")))
    best = suggestions.where(~variant).groupBy("word").agg(F.max_by("term", F.struct("df", "term")).alias("replacement"), F.max("df").alias("df"))
    own = freqs.select(F.col("term").alias("word"), F.col("df").alias("own"))
    joined = best.join(own, "word", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    gain = F.round(F.col("df") / F.greatest(F.col("own"), F.lit(1)), 6)
    return joined.where(F.col("own") <= most_df).withColumn("gain", gain).where(F.col("gain") >= min_gain).select("word", "replacement", "gain")
