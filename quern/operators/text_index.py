"""A stored inverted index of named fields that grows by segments, and queries that read the blocks they need.

A segment is written once: `docs` (a row a document), `terms` (a row a term of a field) and `postings`, rows of up to
BLOCK postings of one term, the highest frequencies first, with the highest and the least frequency of each block. The
manifest names the segments of every version; append adds a segment and a version, merge makes one segment of all.
"""

from __future__ import annotations

import atexit
import sys
import uuid
from dataclasses import dataclass, replace
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quern.functions.scalars import ngrams
from quern.functions.text import words
from quern.operators.graph import checkpoint_dir
from quern.operators.search import postings as term_postings

#: Postings of a block.
BLOCK = 128
#: The field of a field's shingles.
SHINGLES = "{}.shingles"


def _postings(docs: DataFrame, doc: str, fields: dict[str, Column], shingles: tuple[int, int] | None) -> DataFrame:
    """(doc, field, term, tf, positions); with shingles also those n-grams of words, in fields of their own."""
    parts = []
    for name, text in fields.items():
        parts.append(term_postings(docs, doc, text, positions=True).withColumn("field", F.lit(name)))
        for n in range(shingles[0], shingles[1] + 1) if shingles else ():
            at = docs.select(doc, F.posexplode(ngrams(words(text), n, n)).alias("pos", "term")).groupBy(doc, "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
            parts.append(at.withColumn("field", F.lit(SHINGLES.format(name))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col(doc).alias("doc"), "field", "term", "tf", "positions")


def _blocks(postings: DataFrame) -> DataFrame:
    """Blocks of the postings, made where the rows lie once they are sorted by ranges: a term's postings may fill many
    tasks, no task holds more than a block of them."""
    schema = StructType([StructField("field", StringType()), StructField("term", StringType()), StructField("best", LongType()), StructField("least", LongType()), StructField("docs", ArrayType(postings.schema["doc"].dataType)), StructField("tfs", ArrayType(LongType())), StructField("positions", ArrayType(ArrayType(IntegerType())))])
    ordered = postings.withColumn("__down", -F.col("tf")).repartitionByRange("field", "term", "__down", "doc").sortWithinPartitions("field", "term", "__down", "doc").drop("__down")

    kind = postings.select("doc").limit(0).toArrow().schema.field(0).type
    return ordered.mapInArrow(_block_batches(kind), schema)


def _block_batches(kind: pa.DataType):
    """A function on batches (field, term, doc, tf, positions), in the order of blocks, that gives the blocks as columns,
    cut out of the batches without a Python object for a posting."""

    def blocks(batches):
        held = None  # the rows of the last block, which may go on
        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(["field", "term", "doc", "tf", "positions"])
            rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
            if not rows.num_rows:
                continue
            field, term = rows["field"].combine_chunks(), rows["term"].combine_chunks()
            new = np.ones(rows.num_rows, bool)
            new[1:] = pc.or_(pc.not_equal(field[1:], field[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            place = np.arange(rows.num_rows) - np.repeat(first, np.diff(np.r_[first, rows.num_rows]))
            begins = np.flatnonzero(place % BLOCK == 0)
            held = rows.slice(begins[-1])
            if len(begins) > 1:
                yield _batch(rows.slice(0, begins[-1]), begins)
        if held is not None:
            yield _batch(held.combine_chunks(), np.array([0, held.num_rows]))

    def _batch(rows, begins):
        column = lambda c: rows[c].combine_chunks()
        listed = lambda c, kind: pa.ListArray.from_arrays(pa.array(begins, pa.int32()), column(c).cast(kind))
        first, last, tf = pa.array(begins[:-1]), pa.array(begins[1:] - 1), column("tf")
        whole = [column("field").take(first), column("term").take(first), tf.take(first), tf.take(last)]
        return pa.RecordBatch.from_arrays([*whole, listed("doc", kind), listed("tf", pa.int64()), listed("positions", pa.list_(pa.int32()))], names=["field", "term", "best", "least", "docs", "tfs", "positions"])

    return blocks


@dataclass(frozen=True)
class TextIndex:
    """An index at a path. `row_group` is the size of a unit of reading; small ones leave out more of the other terms. A
    snapshot is pinned to a version, so that all parts of a query see the same segments."""

    spark: SparkSession
    path: str
    row_group: int = 8 << 20
    pinned: tuple[int, list[tuple[str, int]]] | None = None

    # --- segments ---------------------------------------------------------------------------------

    def versions(self) -> DataFrame:
        """(version, segment, n_docs): the manifest."""
        return self.spark.read.parquet(f"{self.path}/manifest")

    def segments(self) -> list[str]:
        """Names of the segments of the newest version, or of the pinned one."""
        return sorted(name for name, _ in self._newest()[1])

    def snapshot(self) -> TextIndex:
        return self if self.pinned else replace(self, pinned=self._newest())

    def _commit(self, version: int, rows: list[tuple[str, int]]) -> None:
        """A version is a folder that must not be there yet, so that of two writers one fails."""
        self.spark.createDataFrame(rows, "segment string, n_docs long").coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/version={version}")

    def _write(self, postings: DataFrame, docs: DataFrame) -> tuple[str, int]:
        name = uuid.uuid4().hex
        where = f"{self.path}/segments/{name}"
        docs.write.parquet(f"{where}/docs")
        _blocks(postings).write.option("parquet.block.size", self.row_group).parquet(f"{where}/postings")
        blocks = self.spark.read.parquet(f"{where}/postings")
        terms = blocks.groupBy("field", "term").agg(F.sum(F.size("docs")).alias("df"), F.max("best").alias("best"))
        terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{where}/terms")
        return name, self.spark.read.parquet(f"{where}/docs").count()

    def build(self, docs: DataFrame, doc: str, fields: dict[str, Column], title: Column | None = None, shingles: tuple[int, int] | None = None) -> TextIndex:
        """The first segment: every field's lower-cased words, with shingles also its n-grams of those sizes. Null texts
        have no words; documents are told apart by `doc` alone."""
        stored = docs.select(F.col(doc).alias("doc"), (title if title is not None else F.lit(None)).cast("string").alias("title"))
        self._commit(1, [self._write(_postings(docs, doc, fields, shingles), stored)])
        return self

    def append(self, docs: DataFrame, doc: str, fields: dict[str, Column], title: Column | None = None, shingles: tuple[int, int] | None = None) -> TextIndex:
        """A further segment, in a new version; readers of the former one aren't disturbed."""
        stored = docs.select(F.col(doc).alias("doc"), (title if title is not None else F.lit(None)).cast("string").alias("title"))
        new = self._write(_postings(docs, doc, fields, shingles), stored)
        now = self._newest()
        self._commit(now[0] + 1, [*now[1], new])
        return self

    def _newest(self) -> tuple[int, list[tuple[str, int]]]:
        if self.pinned:
            return self.pinned
        rows = self.versions().collect()  # a row a segment and version
        last = max(r["version"] for r in rows)
        return last, [(r["segment"], r["n_docs"]) for r in rows if r["version"] == last]

    def merge(self) -> TextIndex:
        """One segment out of all, in a new version."""
        version, rows = self._newest()
        if len(rows) > 1:
            each = self._read("postings").select("field", "term", F.explode(F.arrays_zip("docs", "tfs", "positions")).alias("x"))
            one = each.select(F.col("x.docs").alias("doc"), "field", "term", F.col("x.tfs").alias("tf"), F.col("x.positions").alias("positions"))
            self._commit(version + 1, [self._write(one, self._read("docs"))])
        return self

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/segments/{s}/{kind}" for s in self.segments()])

    # --- reading ----------------------------------------------------------------------------------

    def docs(self) -> DataFrame:
        return self._read("docs")

    def terms(self) -> DataFrame:
        """(field, term, df, best) over all segments."""
        return self._read("terms").groupBy("field", "term").agg(F.sum("df").alias("df"), F.max("best").alias("best"))

    def blocks(self) -> DataFrame:
        return self._read("postings")

    def n_docs(self) -> int:
        return sum(n for _, n in self._newest()[1])

    def postings(self, where: Column) -> DataFrame:
        """(field, term, doc, tf, positions) of the blocks that meet a condition on field, term and best."""
        each = self.blocks().where(where).select("field", "term", F.explode(F.arrays_zip("docs", "tfs", "positions")).alias("x"))
        return each.select("field", "term", F.col("x.docs").alias("doc"), F.col("x.tfs").alias("tf"), F.col("x.positions").alias("positions"))

    def needed(self, asked: dict[str, float], field: str, k: int) -> dict[str, int]:
        """term -> the least `best` of the blocks that can hold one of the k highest sums of weight times frequency.

        asked: terms with their weights. Blocks that together hold k documents, each giving `least` at least, prove a
        threshold. A document of a block that stays below it, even with the best of all other terms, is none of the k.
        """
        meta = self.blocks().where((F.col("field") == field) & F.col("term").isin(*asked)).select("term", "best", "least", F.size("docs").alias("n"))
        steps = meta.groupBy("term", "best", "least").agg(F.sum("n").alias("n")).collect()  # a row a pair of frequencies
        most = {t: max((r["best"] for r in steps if r["term"] == t), default=0) for t in asked}
        threshold = 0.0
        for t, w in asked.items():
            seen = 0
            for r in sorted((r for r in steps if r["term"] == t), key=lambda r: (-r["least"], -r["best"])):
                seen += r["n"]
                if seen >= k:
                    threshold = max(threshold, w * r["least"])
                    break
        total = sum(asked[t] * most[t] for t in asked)
        least = {}
        for t, w in asked.items():
            rest = total - w * most[t]
            enough = [r["best"] for r in steps if r["term"] == t and w * r["best"] + rest >= threshold - 1e-6]
            if enough:
                least[t] = min(enough)
        return least

    def top(self, asked: list[str], field: str, k: int = 50) -> DataFrame:
        """(doc, score, rank): the k documents of highest TF-IDF sum over the terms, ties by document; blocks that can't
        hold one aren't read."""
        n = self.n_docs()
        df = dict(self.terms().where((F.col("field") == field) & F.col("term").isin(*asked)).select("term", "df").collect())
        weights = {t: log(n / d) for t, d in df.items()}
        least = self.needed(weights, field, k)
        where = F.lit(False)
        for t, b in least.items():
            where = where | ((F.col("term") == t) & (F.col("best") >= b))
        weight = F.element_at(F.create_map(*[F.lit(x) for t, w in weights.items() for x in (t, w)]), F.col("term")) if weights else F.lit(0.0)
        scored = self.postings((F.col("field") == field) & where).groupBy("doc").agg(F.round(F.sum(F.col("tf") * weight), 6).alias("score"))
        best = scored.orderBy(F.desc("score"), "doc").limit(k)  # k rows
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc")))


_TEMPORARY: list[TextIndex] = []


def temporary_index(spark: SparkSession) -> TextIndex:
    """An index in the folder for checkpoints, removed when the driver ends."""
    if not _TEMPORARY:
        atexit.register(_remove_temporary)
    _TEMPORARY.append(TextIndex(spark, f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"))
    return _TEMPORARY[-1]


def _remove_temporary() -> None:
    for index in _TEMPORARY:
        try:
            path = index.spark._jvm.org.apache.hadoop.fs.Path(index.path)
            path.getFileSystem(index.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended already
            return


cloudpickle.register_pickle_by_value(sys.modules[__name__])
