"""TF-IDF over n-grams with weighting schemes, and pruning of terms that other terms subsume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import ngrams
from quern.functions.text import words

TF = {
    "basic": lambda: F.col("tf") / F.col("len"),
    "freq": lambda: F.col("tf").cast("double"),
    "binary": lambda: F.lit(1.0),
    "log": lambda: 1 + F.log("tf"),
    "norm_50": lambda: 0.5 + 0.5 * F.col("tf") / F.col("max_tf"),
}
IDF = {
    "basic": lambda: F.log(F.col("n") / F.col("df")),
    "freq": lambda: F.col("df").cast("double"),
    "smooth": lambda: F.log(1 + F.col("n") / F.col("df")),
    "max": lambda: F.log(F.col("max_df") / (1 + F.col("df"))),
    "prob": lambda: F.when(F.col("n") > F.col("df"), F.log((F.col("n") - F.col("df")) / F.col("df"))),
}


def ngram_counts(docs: DataFrame, doc: str, text: Column, low: int = 1, high: int = 1) -> DataFrame:
    """(doc, term, tf, len, max_tf, df, n, max_df) of the n-grams of low..high words."""
    tf = docs.select(doc, F.explode(ngrams(words(text), low, high)).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf"))
    by_doc = tf.groupBy(doc).agg(F.sum("tf").alias("len"), F.max("tf").alias("max_tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    most = df.agg(F.max("df").alias("max_df"))
    return tf.join(by_doc, doc).join(df, "term").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(most))  # one row each


def weighted(counts: DataFrame, tf: str = "basic", idf: str = "basic") -> DataFrame:
    """counts with w, to six places."""
    return counts.withColumn("w", F.round(TF[tf]() * IDF[idf](), 6))


def ranked(df: DataFrame, doc: str, weight: str = "w") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc(weight), "term")))


def _against_higher(top: DataFrame, doc: str, bad: Column) -> DataFrame:
    """Ranked terms none of whose higher-ranked terms makes `bad` true. The higher terms travel as an array of the
    document's top terms, so documents don't join with themselves."""
    w = Window.partitionBy(doc).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return top.withColumn("__higher", F.collect_list("term").over(w)).where(~F.exists("__higher", lambda o: bad(F.col("term"), o))).drop("__higher")


def prune_subsumed(top: DataFrame, doc: str) -> DataFrame:
    """Without terms that are part of a higher-ranked term of the document, as plain text."""
    return _against_higher(top, doc, lambda t, o: F.contains(o, t))


def prune_overlapping(top: DataFrame, doc: str) -> DataFrame:
    """Without blank and numeric terms and those that hold or are held by a higher-ranked term, word by word."""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    held = lambda t, o: F.contains(pad(o), pad(t)) | F.contains(pad(t), pad(o))
    return _against_higher(top, doc, held).where(~F.col("term").rlike(r"^[0-9\s]*$"))
