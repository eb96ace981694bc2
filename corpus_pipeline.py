"""A corpus pipeline out of the operators of quern.llm: (name, function) stages, each written as Parquet and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, language_id, line_dedup, mixing, ngram_join
from quern.llm._common import Scratch, crc_mod, fresh


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay. Rejected are null texts, texts without a letter, and those with hardly any
    known n-gram. Ties go to the alphabetically first language, which rejects nothing; null ids, null labels and
    repeated rows are told like others; an empty table stays empty."""
    pred, score = fresh(docs, 2)
    model = language_id.learn(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    found = language_id.identify(docs, model, pred, score)
    return found.where((F.col(pred) != "und") & (F.col(score) >= 0.2)).drop(pred, score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates, short ones too, are cut out; documents that consist of nothing else go. Null and
    empty texts stay; repeated rows are cut alike; n_chars is that of what is left, and null stays null with the text."""
    kept = line_dedup.dedup_lines(docs, min_tokens=1, drop_empty=True)
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by four fifths of their five-word shingles, stays: the one of smallest
    id, a null id coming last. Of repeated rows one stays; texts without words are copies of nothing but themselves."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null and empty texts have none; repeated rows go or stay together;
    without benchmark words all stay."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token budget is spread over domains, languages and sources; rows carry mix_domain, mix_tokens, mix_epoch, in
    place of columns of these names. Documents without tokens are never chosen; null sources and languages are leaves
    like others; repeated rows count one by one, in a fixed order."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: The n-gram filters of the first stage and the seeded order of the last are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            scratch.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
