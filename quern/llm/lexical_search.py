"""Ranked lexical search: for each term a tree of maxima over document ranges; a best-first descent opens the ranges whose
summed bounds can still reach the best k.

The tree has three levels below a term: shards of SHARD documents, ranges of RANGE documents within them, and documents.
A node holds the largest share that the term gives to any document below it, so that the sum over a query's terms is a
bound of every score there. Shards are rows of a written table and are searched where they are read; what goes between
shards is a bound and k results a query.
"""

from __future__ import annotations

import heapq
import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quern.llm._common import Scratch, alnum_words, byte_blocks, lean, shipped_by_value

#: Documents of a shard and of a range; postings of a shard; ranges opened at once.
SHARD, RANGE, POSTINGS, OPENED = 4096, 32, 1 << 20, 4
#: Bytes of queries that are searched in one go, since their terms travel to every task.
QUERY_BYTES = 1 << 20
#: Shards a query is searched in first.
FIRST = 2
#: Texts above so many bytes are read match by match.
LONG = 1 << 23
TERM = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _postings(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """Shards of documents (ids, n, at, terms, tf as flat arrays of numbers) with the postings of the terms, and each
    shard's document frequencies. Documents without a term of their own aren't among them."""
    kinds = "ids array<long>, n binary, at binary, terms binary, tf binary, total long, df_terms array<int>, df array<long>"

    def shard(ids, ns, at, found, tfs):
        places = np.concatenate(found) if found else np.empty(0, np.int32)
        df = np.bincount(places, minlength=1)
        held = np.flatnonzero(df)
        values = [ids], [np.asarray(ns, "<i8").tobytes()], [np.asarray(at, "<i4").tobytes()], [places.astype("<i4").tobytes()], [np.concatenate(tfs).astype("<i8").tobytes() if tfs else b""], [sum(ns)], [held], [df[held]]
        types = pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in kinds.split(", ")])

    def rows(batches):
        match = re.compile(TERM)
        ids, ns, at, found, tfs = [], [], [0], [], []
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, texts in byte_blocks(batch.column(1)):
                for key, text in zip(keys[i : i + len(texts)], texts, strict=True):
                    if len(text) < LONG:
                        words = match.findall(text.lower())
                        n = len(words)
                        own = [x for x in map(terms.get, words) if x is not None]
                    else:
                        n, own = 0, []
                        for m in match.finditer(text):
                            n += 1
                            if (x := terms.get(m[0].lower())) is not None:
                                own.append(x)
                    if not n:
                        continue
                    places, tf = np.unique(np.asarray(own, np.int32), return_counts=True)
                    ids.append(key)
                    ns.append(n)
                    found.append(places)
                    tfs.append(tf)
                    at.append(at[-1] + len(places))
                    if len(ids) == SHARD or at[-1] >= POSTINGS:
                        yield shard(ids, ns, at, found, tfs)
                        ids, ns, at, found, tfs = [], [], [0], [], []
        if ids:
            yield shard(ids, ns, at, found, tfs)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(lean(rows), kinds)


#: The columns of a tree and their types: `of` says which term stands at each root entry; down_* leads from an entry to
#: the entries of the level below it.
TREE = "shard long, ids array<long>, of binary, root binary, down_root binary, ranges binary, top binary, down_top binary, docs binary, share binary"


def _trees(postings: DataFrame, n_docs: int, total: int) -> DataFrame:
    """Each shard's trees: entries sorted by term and place, the maxima of each level, and where the level below starts."""

    def tree(row):
        n, at = np.frombuffer(row["n"], "<i8"), np.frombuffer(row["at"], "<i4")
        terms, tf = np.frombuffer(row["terms"], "<i4"), np.frombuffer(row["tf"], "<i8")
        doc = np.repeat(np.arange(len(n), dtype=np.int64), np.diff(at))
        length = 75 + (25 * n * n_docs) // max(total, 1)
        share = (1_000_000_000 * tf) // (1000 * tf + 12 * length[doc])
        order = np.argsort(terms, kind="stable")  # places are in order already
        terms, doc, share = terms[order].astype(np.int64), doc[order], share[order]
        key = terms * (SHARD // RANGE) + doc // RANGE
        low = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        top = np.maximum.reduceat(share, low) if len(key) else share
        owner = terms[low]
        high = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(low) else np.empty(0, np.int64)
        root = np.maximum.reduceat(top, high) if len(low) else top
        parts = owner[high], root, np.r_[high, len(low)], key[low] % (SHARD // RANGE), top, np.r_[low, len(key)], doc, share
        kinds = "<i4", "<i4", "<i4", "<i2", "<i4", "<i4", "<i2", "<i4"
        return [p.astype(k).tobytes() for p, k in zip(parts, kinds, strict=True)]

    def rows(batches):
        names = [c.split()[0] for c in TREE.split(", ")]
        for row in _each(batches):
            values = [row["shard"], row["ids"], *tree(row)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 8], strict=True)], names=names)

    return postings.select("shard", "ids", "n", "at", "terms", "tf").mapInArrow(lean(rows), TREE)


class Shard:
    """A shard's trees, searched for one query after the other."""

    def __init__(self, row: dict):
        kinds = {"of": "<i4", "root": "<i4", "down_root": "<i4", "ranges": "<i2", "top": "<i4", "down_top": "<i4", "docs": "<i2", "share": "<i4"}
        self.__dict__.update({k: np.frombuffer(row[k], t).astype(np.int64) for k, t in kinds.items() if k in row})
        self.ids, self.n_opened = row.get("ids"), 0

    def roots(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Root entries of the terms that the shard has, and their weights."""
        if not len(self.of):
            return terms[:0], weights[:0]
        at = np.minimum(np.searchsorted(self.of, terms), len(self.of) - 1)
        has = self.of[at] == terms
        return at[has], weights[has]

    def bound(self, terms: np.ndarray, weights: np.ndarray) -> int:
        at, w = self.roots(terms, weights)
        return int((self.root[at] * w).sum())

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """(score, place) of the k best documents with a score of `least` or more, equal scores by id.

        A heap gives the range of highest bound; it is opened while its bound reaches the k-th score so far, also where
        it only equals it, since a smaller id may be in there.
        """
        at, w = self.roots(terms, weights)
        entries, w = _spans(self.down_root[at], self.down_root[at + 1], w)
        bounds = np.zeros(SHARD // RANGE, np.int64)
        np.add.at(bounds, self.ranges[entries], self.top[entries] * w)
        by_range = np.argsort(self.ranges[entries], kind="stable")
        entries, w = entries[by_range], w[by_range]
        ends = np.searchsorted(self.ranges[entries], np.arange(SHARD // RANGE + 1))
        heap = [(-b, r) for r, b in enumerate(bounds.tolist()) if b >= least]
        heapq.heapify(heap)
        found: list[tuple[int, int]] = []
        while heap and -heap[0][0] >= least:
            opened = []
            while heap and len(opened) < OPENED and -heap[0][0] >= least:
                opened.append(heapq.heappop(heap)[1])
            self.n_opened += len(opened)
            own = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in opened])
            posts, v = _spans(self.down_top[entries[own]], self.down_top[entries[own] + 1], w[own])
            scores = np.zeros(len(self.ids), np.int64)
            np.add.at(scores, self.docs[posts], self.share[posts] * v)
            places = np.flatnonzero(scores >= least)
            found += zip(scores[places].tolist(), places.tolist(), strict=True)
            if len(found) > k:
                found = heapq.nsmallest(k, found, key=lambda x: (-x[0], *_id_order(self.ids[x[1]]), x[1]))
            if len(found) == k:
                least = max(least, min(s for s, _ in found))
        return found


def _id_order(key: int | None) -> tuple[bool, int]:
    """Ascending ids, a null id last."""
    return key is None, key or 0


def _spans(start: np.ndarray, end: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """All numbers of the ranges start..end, and each range's values for each of its numbers."""
    n = end - start
    first = np.cumsum(n) - n
    return np.repeat(start - first, n) + np.arange(n.sum()), *(np.repeat(v, n) for v in values)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items(item_id, text) the k documents of highest score above 0, equal
    scores by ascending doc_id, a null id last.

    Null and empty texts have no terms: such items find nothing, such documents don't count in N. Every row of items is
    a query of its own and every row of docs a document of its own, whatever their ids; equal rows have equal scores and
    ranks of their own. An empty table on either side gives no row. Queries go in blocks of QUERY_BYTES, each of which
    reads the documents once.
    """
    queries = items.select("item_id", alnum_words("text").alias("words")).where(F.size("words") > 0)
    size = int(queries.select(F.coalesce(F.sum(F.octet_length(F.array_join("words", " ")) + 64), F.lit(0))).first()[0])
    blocks = -(-size // QUERY_BYTES) or 1
    keyed = queries.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    return reduce(DataFrame.unionByName, [_rank_block(docs, keyed.where(F.col("block") == b).drop("block"), k) for b in range(blocks)])


def _rank_block(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    asked = queries.collect()  # about QUERY_BYTES
    terms = {t: i for i, t in enumerate(sorted({w for q in asked for w in q["words"]}))}
    postings = scratch.table(_postings(docs, {t.encode(): i for t, i in terms.items()}), "postings")
    n_docs, total = postings.select(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    df = postings.select(F.explode(F.arrays_zip("df_terms", "df")).alias("x")).groupBy("x.df_terms").agg(F.sum("x.df")).collect()  # a row a term
    weight = {i: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for i, d in df}
    asks = []
    for q in asked:
        own, n = np.unique([terms[w] for w in q["words"]], return_counts=True)
        w = np.asarray([weight.get(t, 0) for t in own.tolist()], np.int64) * n
        asks.append((own[w > 0], w[w > 0]))
    trees = scratch.table(_trees(postings.withColumn("shard", F.monotonically_increasing_id()), n_docs, total), "trees")
    scratch.drop("postings")
    # The shards of highest bound are searched first; the k-th score there is what a range elsewhere has to reach.
    w = Window.partitionBy("query").orderBy(F.desc("bound"), "shard")
    high = _bounds(trees, asks).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= FIRST)
    wanted: dict[int, list[int]] = {}
    for q, shard in high.select("query", "shard").collect():  # FIRST rows a query
        wanted.setdefault(shard, []).append(q)
    first = spark.createDataFrame([(s,) for s in wanted], "shard long")
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    seen = _search(trees.join(F.broadcast(first), "shard", "left_semi"), asks, k, [1] * len(asks), wanted)
    kth = dict(seen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where(F.col("rank") == k).select("query", "score").collect())
    found = _search(trees, asks, k, [max(1, kth.get(q, 1)) for q in range(len(asks))])
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, q["item_id"]) for i, q in enumerate(asked)], StructType([StructField("query", IntegerType()), StructField("item_id", queries.schema["item_id"].dataType)]))
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # a row a query


def _bounds(trees: DataFrame, asks: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(query, shard, bound) wherever a shard can hold a result."""

    def rows(batches):
        for row in _each(batches):
            shard = Shard(row)
            each = [(q, b) for q, (t, w) in enumerate(asks) if (b := shard.bound(t, w)) > 0]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in each], pa.int32()), pa.array([row["shard"]] * len(each), pa.int64()), pa.array([b for _, b in each], pa.int64())], names=["query", "shard", "bound"])

    return trees.select("shard", "of", "root").mapInArrow(lean(rows), "query int, shard long, bound long")


def _search(trees: DataFrame, asks: list[tuple[np.ndarray, np.ndarray]], k: int, least: list[int], wanted: dict[int, list[int]] | None = None) -> DataFrame:
    """(query, doc_id, score) of the k best of each shard with a score of least[query] or more; wanted: the queries of
    each shard, otherwise all."""

    def rows(batches):
        for row in _each(batches):
            shard, out = Shard(row), []
            for q in range(len(asks)) if wanted is None else wanted[row["shard"]]:
                if shard.bound(*asks[q]) >= least[q]:
                    out += [(q, shard.ids[place], score) for score, place in shard.best(*asks[q], k, least[q])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["query", "doc_id", "score"])

    return trees.mapInArrow(lean(rows), "query int, doc_id long, score long")


def _each(batches):
    """The rows of batches, one in memory at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


shipped_by_value(__name__)
