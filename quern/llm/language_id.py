"""Language identification with one bit-sliced Bloom filter whose slots are bitmasks of languages.

For each learned language the most widespread byte n-grams of a bounded sample of labelled documents enter the
filter: slot i holds a mask with one bit per language. Looking an n-gram up means AND-ing the masks of its slots,
which gives all the languages that contain it at once. A text's per-language popcounts, less the hits that the filter's
false-positive rate explains, decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import byte_blocks, crc_mod, fresh, lean, mix, shipped_by_value

GRAM = 4
PROBES = 3
#: A letter as the engine sees it: any Unicode letter.
LETTER = r"\p{L}"


def _fold_table() -> np.ndarray:
    """Byte -> folded byte: A-Z to a-z, other ASCII that is no letter to a blank, bytes above ASCII unchanged."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts, each text framed by blanks, and the index of the text each belongs to.

    N-grams are 4 folded bytes as one integer; those with two blanks in a row are left out.
    """
    table = _fold_table()
    buf = np.frombuffer(b"\n" + b"\n\n".join(texts) + b"\n   ", dtype=np.uint8)  # no n-gram spans two texts
    folded = table[buf].astype(np.uint32)
    n = len(folded) - GRAM + 1
    grams = folded[:n] << 24 | folded[1 : n + 1] << 16 | folded[2 : n + 2] << 8 | folded[3 : n + 3]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    owner = np.concatenate([owner, np.full(max(0, n - len(owner)), max(len(texts) - 1, 0))])[:n]
    blank = folded == 32
    good = ~((blank[:n] & blank[1 : n + 1]) | (blank[1 : n + 1] & blank[2 : n + 2]) | (blank[2 : n + 2] & blank[3 : n + 3]))
    return grams[good], owner[good]


def slots_of(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter's slots of each n-gram, one array per probe."""
    h = mix(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return [((h >> np.uint64(20 * k)) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(PROBES)]


class BloomModel:
    """Learned languages (sorted), slot masks of shape (slots, words of 64 languages) and false-positive rates."""

    def __init__(self, grams: dict[str, np.ndarray], bits: int = 18):
        self.bits, self.languages = bits, sorted(grams)
        words = max(1, -(-len(self.languages) // 64))
        self.masks = np.zeros((1 << bits if grams else 0, words), dtype=np.uint64)
        self.false = np.zeros(len(self.languages))
        for k, name in enumerate(self.languages):
            one = np.uint64(1 << (k % 64))
            for s in slots_of(np.asarray(grams[name], dtype=np.uint32), bits):
                self.masks[s, k // 64] |= one
            fill = float(np.mean((self.masks[:, k // 64] & one) != 0))
            self.false[k] = min(fill**PROBES, 0.5)

    def predict(self, texts: list[bytes]) -> tuple[list[str | None], list[float]]:
        """The language with the most hits beyond chance and its share of the text's n-grams; None without languages."""
        if not self.languages:
            return [None] * len(texts), [0.0] * len(texts)
        grams, owner = grams_of(texts)
        slots = slots_of(grams, self.bits)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        best, name = np.full(len(texts), -1.0), np.zeros(len(texts), dtype=int)
        for w in range(self.masks.shape[1]):
            column = self.masks[:, w]
            found = column[slots[0]]
            for s in slots[1:]:
                found &= column[s]
            for k in range(64 * w, min(len(self.languages), 64 * w + 64)):
                hit = (found >> np.uint64(k % 64)) & np.uint64(1)
                count = np.bincount(owner, weights=hit.astype(float), minlength=len(texts))
                fair = np.clip((count - self.false[k] * total) / (1 - self.false[k]), 0, None) / np.maximum(total, 1)
                better = fair > best
                best[better], name[better] = fair[better], k
        return [self.languages[k] for k in name], np.clip(best, 0, 1).tolist()


def learn(labelled: DataFrame, sample_docs: int = 2000, grams_per_language: int = 12000, bits: int = 18) -> BloomModel:
    """Learns from labelled(doc_id, text, lang). Per language the sample_docs documents of least hash of id and text are
    read as a whole (the documented bound of the sample; repeated rows are one); the grams_per_language n-grams found in
    most of them enter the filter. Rows with null text or lang teach nothing; every other lang value is learned."""
    rows = labelled.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"), "doc_id")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}  # a row a language
    if not counts:
        return BloomModel({}, bits)

    def under(limits: dict[str, int]) -> DataFrame:
        limit = F.create_map(*[F.lit(x) for k, v in sorted(limits.items()) for x in (k, v)])
        return rows.where(F.col("h") <= F.element_at(limit, F.col("lang")))

    # Hashes are spread evenly, so those of four times the sample lie under this share of them; where repeated rows leave
    # fewer different ones than the sample, the share grows fourfold until there are enough or all rows are in.
    share = {k: min(1.0, (4 * sample_docs + 100) / n) for k, n in counts.items()}
    limits = {k: int(v * (1 << 64)) - (1 << 63) - 1 for k, v in share.items()}
    unsure = {k: v for k, v in limits.items() if share[k] < 1}
    while unsure:
        got = {r["lang"]: r["n"] for r in under(unsure).groupBy("lang").agg(F.count_distinct("h").alias("n")).toLocalIterator()}  # a row a language
        share |= {k: min(1.0, 4 * share[k]) for k in unsure if got.get(k, 0) < sample_docs}
        limits |= {k: int(share[k] * (1 << 64)) - (1 << 63) - 1 for k in unsure}
        unsure = {k: limits[k] for k in unsure if got.get(k, 0) < sample_docs and share[k] < 1}
    w = Window.partitionBy("lang").orderBy("h")  # numbers only, some times the sample
    last = under(limits).select("lang", "h").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") == sample_docs)
    limits |= {r["lang"]: r["h"] for r in last.toLocalIterator()}  # a row a language
    chosen = under(limits).dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches):
        for b in batches:
            langs = b.column(0).to_pylist()
            for i, texts in byte_blocks(b.column(1), 1 << 19):
                own = langs[i : i + len(texts)]
                for name in sorted(set(own)):
                    grams, owner = grams_of([t for t, x in zip(texts, own, strict=True) if x == name])
                    pairs = np.unique(grams.astype(np.uint64) | owner.astype(np.uint64) << np.uint64(32))
                    g, c = np.unique((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g), pa.array(c)], ["lang", "gram", "docs"])

    counts = chosen.mapInArrow(lean(count), "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    top = Window.partitionBy("lang").orderBy(F.desc("docs"), "gram")
    kept = counts.withColumn("r", F.row_number().over(top)).where(F.col("r") <= grams_per_language)
    found: dict[str, list[int]] = {}
    for row in kept.groupBy("lang").agg(F.collect_list("gram").alias("grams")).toLocalIterator():  # bounded by the parameters
        found[row["lang"]] = row["grams"]
    return BloomModel({k: np.array(v, dtype=np.uint32) for k, v in found.items()}, bits)


def identify(docs: DataFrame, model: BloomModel, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds pred (a learned language, or `und` for a null text, one without a letter, or without learned languages)
    and score (0 to 1) to the rows; every other column is passed through, but those of these two names are replaced. Ties go
    to the alphabetically first. Repeated rows and rows with null ids are told like others."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.__dict__)  # bounded: 2 ** bits slots
    docs = docs.drop(pred, score)
    names = docs.columns
    (flag,) = fresh(docs, 1)
    framed = docs.withColumn(flag, F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))
    at, has = names.index("text"), len(names)

    def predict(batches):
        m = BloomModel({})
        m.__dict__.update(shared.value)
        for b in batches:
            letters = b.column(has).to_pylist()
            pred_, score_ = [], []
            for _, texts in byte_blocks(b.column(at), 1 << 18):
                p, s = m.predict(texts)
                pred_ += p
                score_ += s
            pred_ = [p if x and p is not None else "und" for p, x in zip(pred_, letters, strict=True)]
            score_ = [s if p != "und" else 0.0 for p, s in zip(pred_, score_, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:has], pa.array(pred_, pa.string()), pa.array(score_, pa.float64())], names=[*names, pred, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return framed.mapInArrow(lean(predict), schema)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, learning only from those that aren't held out.

    Nulls, repeated rows and extra columns are fine: each row gets its own prediction; a null id is never held out. Ties go
    to the alphabetically first language; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", "lang")
    model = learn(rows.where(crc_mod(F.col("doc_id"), 4) != 2))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


shipped_by_value(__name__)
