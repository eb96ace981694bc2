"""A compiled trie of word sequences: found, counted and spotted without a join while it is small enough to travel.

The trie is held level by level. An edge is one number, parent * words + word; each level's edges are sorted, and a
node's number is the place of its edge, so that a level is walked for all places of a batch at once by binary search.
Phrases are in the order of their nodes: what lies below a node is a slice of them.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of phrases up to which a table is compiled and sent to every task.
COMPILED_BYTES = 32 << 20


@dataclass
class PhraseTrie:
    """edges[n]: sorted edges to the nodes of depth n + 1; ends[n]: for each such node the phrase that ends there, or -1;
    below[n]: where the phrases under each node start and end. phrases and values: in the order of the trie."""

    vocabulary: dict[str, int]
    edges: list[np.ndarray]
    ends: list[np.ndarray]
    below: list[tuple[np.ndarray, np.ndarray]]
    phrases: list[str]
    values: list[str | None]

    @property
    def n_nodes(self) -> int:
        """Nodes with the root."""
        return 1 + sum(map(len, self.edges))

    def _step(self, depth: int, nodes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The nodes that the words lead to, -1 where none."""
        edges = self.edges[depth]
        keys = nodes * max(len(self.vocabulary), 1) + words
        at = np.minimum(np.searchsorted(edges, keys), len(edges) - 1)
        return np.where((words >= 0) & (edges[at] == keys), at, -1)

    def node(self, phrase: str) -> tuple[int, int] | None:
        """(depth, node) of a sequence of words that some phrase begins with; None otherwise. The root is (0, 0)."""
        at = np.zeros(1, np.int64)
        words = phrase.split(" ") if phrase else []
        if len(words) > len(self.edges):
            return None
        for depth, w in enumerate(words):
            at = self._step(depth, at, np.asarray([self.vocabulary.get(w, -1)]))
            if at[0] < 0:
                return None
        return len(words), int(at[0])

    def find(self, phrase: str) -> str | None:
        """The value of a phrase."""
        found = self.node(phrase)
        end = self.ends[found[0] - 1][found[1]] if found and found[0] else -1
        return self.values[end] if end >= 0 else None

    def under(self, prefix: str) -> list[tuple[str, str | None]]:
        """(phrase, value) of all phrases that begin with the words of the prefix, in the order of their words' numbers."""
        found = self.node(prefix)
        if found is None:
            return []
        depth, node = found
        a, b = (int(x[node]) for x in self.below[depth - 1]) if depth else (0, len(self.phrases))
        return list(zip(self.phrases[a:b], self.values[a:b], strict=True))

    def longest(self, words: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, phrase) of the longest phrase at every place where one begins. words: numbers or -1;
        room: how many words are left from each place to its text's end."""
        place, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        length, phrase = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        for depth in range(len(self.edges)):
            inside = room[place] > depth
            place, node = place[inside], node[inside]
            node = self._step(depth, node, words[place + depth])
            place, node = place[node >= 0], node[node >= 0]
            if not len(place):
                break
            end = self.ends[depth][node]
            length[place[end >= 0]], phrase[place[end >= 0]] = depth + 1, end[end >= 0]
        found = np.flatnonzero(length)
        return found, length[found], phrase[found]


def compile_trie(phrases: list[str], values: list[str | None]) -> PhraseTrie:
    """The trie of distinct phrases, their words separated by single spaces."""
    split = [p.split(" ") for p in phrases]
    vocabulary = {w: i for i, w in enumerate(sorted({w for p in split for w in p}))}
    order = sorted(range(len(phrases)), key=lambda i: [vocabulary[w] for w in split[i]])
    flat = np.asarray([vocabulary[w] for i in order for w in split[i]], np.int64)
    sizes = np.asarray([len(split[i]) for i in order], np.int64)
    starts = np.cumsum(sizes) - sizes
    edges, ends, below = [], [], []
    at, node = np.arange(len(phrases)), np.zeros(len(phrases), np.int64)
    for depth in range(int(sizes.max(initial=0))):
        deep = sizes[at] > depth
        at, node = at[deep], node[deep]
        level, first, node = np.unique(node * len(vocabulary) + flat[starts[at] + depth], return_index=True, return_inverse=True)
        end = np.full(len(level), -1, np.int64)
        stops = sizes[at] == depth + 1
        end[node[stops]] = at[stops]
        edges.append(level)
        ends.append(end)
        below.append((at[first], at[np.r_[first[1:], len(at)] - 1] + 1))
    return PhraseTrie(vocabulary, edges, ends, below, [phrases[i] for i in order], [values[i] for i in order])


def load_trie(phrases: DataFrame, most: int = COMPILED_BYTES) -> PhraseTrie | None:
    """The trie of phrases(phrase, value), the least value where a phrase has several; None where the table is larger than
    `most` bytes, by a sum over it. Null phrases and those without a word are left out."""
    table = phrases.where("phrase <> ''").groupBy("phrase").agg(F.min("value").alias("value"))
    size = table.agg(F.coalesce(F.sum(F.octet_length("phrase") + F.coalesce(F.octet_length("value"), F.lit(0)) + 32), F.lit(0))).first()[0]
    if size > most:
        return None
    found = table.toArrow()  # at most `most` bytes
    return compile_trie(found.column("phrase").to_pylist(), found.column("value").to_pylist())


def _leftmost(starts: list[int], sizes: list[int]) -> list[int]:
    """Which of the matches stay, from left to right, if each takes the words it spans."""
    kept, end = [], -1
    for k, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        if start >= end:
            kept.append(k)
            end = start + size
    return kept


def spot(docs: DataFrame, doc: str, words: Column, trie: PhraseTrie) -> DataFrame:
    """(doc, start, n, phrase, value): the longest phrase at each place, from left to right, skipping what it spans. One
    pass over the words of each Arrow batch; no exchange. Null word lists have none."""
    base = docs.select(doc, words.alias("w"))
    schema = base.select(doc, F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("phrase"), F.lit(None).cast("string").alias("value")).schema

    def rows(batches):
        texts, meanings = pa.array(trie.phrases, pa.string()), pa.array(trie.values, pa.string())
        for batch in batches:
            w = batch.column("w")
            sizes = np.asarray(w.value_lengths().fill_null(0))
            coded = w.flatten().dictionary_encode()
            numbers = np.asarray([trie.vocabulary.get(x, -1) for x in coded.dictionary.to_pylist()] or [-1], np.int64)
            codes = numbers[np.asarray(coded.indices.fill_null(0))] if len(coded) else np.empty(0, np.int64)
            ends = np.cumsum(sizes)
            place, length, phrase = trie.longest(codes, np.repeat(ends, sizes) - np.arange(len(codes)))
            kept = _leftmost(place.tolist(), length.tolist())  # phrases end with their text
            place, length, phrase = place[kept], length[kept], phrase[kept]
            row = np.searchsorted(ends, place, side="right")
            start = place - (ends - sizes)[row]
            yield pa.RecordBatch.from_arrays([batch.column(doc).take(pa.array(row)), pa.array(start, pa.int32()), pa.array(length, pa.int32()), texts.take(pa.array(phrase)), meanings.take(pa.array(phrase))], names=[doc, "start", "n", "phrase", "value"])

    return base.mapInArrow(rows, schema) if trie.edges else base.sparkSession.createDataFrame([], schema)


def entries_under(queries: DataFrame, key: str, prefix: str, trie: PhraseTrie) -> DataFrame:
    """queries' key with (phrase, value) for every phrase that begins with the words of its prefix; a null prefix has
    none."""
    base = queries.select(F.col(key), F.col(prefix).alias("prefix"))
    schema = base.select(key, F.lit("").alias("phrase"), F.lit(None).cast("string").alias("value")).schema

    def rows(batches):
        for batch in batches:
            found = [(i, *x) for i, p in enumerate(batch.column("prefix").to_pylist()) if p is not None for x in trie.under(p)]
            at, phrase, value = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(phrase, pa.string()), pa.array(value, pa.string())], names=[key, "phrase", "value"])

    return base.mapInArrow(rows, schema)


def trie_nodes(entries: DataFrame, key: str) -> DataFrame:
    """One row (n_entries, n_nodes): distinct strings, and the nodes of their trie by characters, the root included.

    Strings are sorted over the cluster by ranges; a string adds a node for every character beyond what it shares with
    the one before it. Ranges are joined by their first and last strings, a row a range. Nulls and empty strings add
    no node; an empty table has the root only.
    """
    strings = entries.select(F.col(key).alias("k")).where("k is not null").distinct()
    ordered = strings.repartitionByRange("k").sortWithinPartitions("k")

    def shared(a: str, b: str) -> int:
        n = 0
        for x, y in zip(a, b):  # noqa: B905  the shorter ends it
            if x != y:
                break
            n += 1
        return n

    def rows(batches):
        first = last = None
        entries_, nodes = 0, 0
        for batch in batches:
            for k in batch.column(0).to_pylist():
                nodes += len(k) - (shared(last, k) if last is not None else 0)
                entries_ += 1
                first, last = k if first is None else first, k
        if entries_:
            yield pa.RecordBatch.from_arrays([pa.array([entries_], pa.int64()), pa.array([nodes], pa.int64()), pa.array([first]), pa.array([last])], names=["n", "nodes", "first", "last"])

    ranges = ordered.mapInArrow(rows, "n long, nodes long, first string, last string").collect()  # a row a range
    ranges.sort(key=lambda r: r["first"].encode())
    twice = sum(shared(a["last"], b["first"]) for a, b in zip(ranges, ranges[1:]))  # noqa: B905  pairs
    return entries.sparkSession.createDataFrame([(sum(r["n"] for r in ranges), 1 + sum(r["nodes"] for r in ranges) - twice)], "n_entries long, n_nodes long")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
