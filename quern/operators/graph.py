"""Reachability in graphs given as edge tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one set, or on a local master a temporary one."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="quern-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def transitive_closure(edges: DataFrame, x: str = "x", y: str = "y", rounds: int = 64) -> DataFrame:
    """(x, y): all pairs with a path. Lengths double each round, so a graph of diameter d takes log2(d) rounds; cycles
    end too. Of the pairs known, those whose shortest path is as long as any are led on by all known ones: a pair of up to
    twice that length is met at the one or few places where its shortest paths reach that length, not at each of their
    nodes. Every round is checkpointed in the folder of spark.checkpoint.dir; where none is set, on a local master only,
    in a temporary one."""
    checkpoint_dir(edges.sparkSession)
    reach = edges.select(F.col(x).alias("x"), F.col(y).alias("y")).distinct().withColumn("d", F.lit(1)).checkpoint()
    for k in range(rounds):
        longest = reach.where(F.col("d") == 1 << k)
        step = longest.select("x", F.col("y").alias("via")).join(reach.select(F.col("x").alias("via"), "y", "d"), "via").select("x", "y", (F.col("d") + (1 << k)).alias("d"))
        grown = reach.union(step).groupBy("x", "y").agg(F.min("d").alias("d")).checkpoint()
        reach = grown
        if reach.where(F.col("d") > 1 << k).isEmpty():
            break
    return reach.select(F.col("x").alias(x), F.col("y").alias(y))


def synonyms(senses: DataFrame, word: str = "word", synset: str = "synset") -> DataFrame:
    """(word, synonym): words that share a synset in senses(word, synset). Synsets are short by nature; a word is joined
    with the members of its own."""
    a, b = senses.select(F.col(word).alias("word"), F.col(synset).alias("s")), senses.select(F.col(word).alias("synonym"), F.col(synset).alias("s"))
    return a.join(b, "s").where("word <> synonym").select("word", "synonym").distinct()


def first_sense(words: DataFrame, senses: DataFrame, word: str = "word") -> DataFrame:
    """words with synset, the sense of least rank in senses(word, synset, rank), null for a word without one."""
    best = senses.groupBy(F.col("word").alias("__w")).agg(F.min_by("synset", F.struct("rank", "synset")).alias("synset"))
    return words.join(best, F.col(word) == F.col("__w"), "left").drop("__w")


def roots(words: DataFrame, exceptions: DataFrame, rules: list[tuple[str, str]], known: DataFrame, word: str = "word") -> DataFrame:
    """words with root: the table exceptions(word, root) first, else the first rule (ending, replacement) whose result is
    among known(word), else the word itself."""
    table = exceptions.groupBy(F.col("word").alias("__w")).agg(F.min("root").alias("__r"))
    out = words.join(table, F.col(word) == F.col("__w"), "left").drop("__w")
    forms = F.array(*[F.when(F.endswith(F.col(word), F.lit(a)) & (F.length(word) > len(a)), F.struct(F.lit(k).alias("k"), F.concat(F.expr(f"left(`{word}`, length(`{word}`) - {len(a)})"), F.lit(b)).alias("form"))) for k, (a, b) in enumerate([("", ""), *rules])])
    tried = out.select(word).distinct().select(word, F.explode(F.array_compact(forms)).alias("x")).select(F.col(word).alias("__w"), "x.k", "x.form")
    found = tried.join(known.select(F.col("word").alias("form")).distinct(), "form", "left_semi").groupBy("__w").agg(F.min_by("form", "k").alias("__f"))
    return out.join(found, F.col(word) == F.col("__w"), "left").withColumn("root", F.coalesce("__r", "__f", F.col(word))).drop("__w", "__r", "__f")


def ancestors(edges: DataFrame, child: str, parent: str, most: int) -> DataFrame:
    """(node, ancestor, distance) up to a distance, the shortest of each pair."""
    step = edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).distinct()
    found = level = step.select(F.col("c").alias("node"), F.col("p").alias("ancestor"), F.lit(1).alias("distance"))
    for d in range(2, most + 1):
        level = level.join(step, F.col("ancestor") == F.col("c")).select("node", F.col("p").alias("ancestor"), F.lit(d).alias("distance")).distinct()
        found = found.union(level)
    return found.groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
