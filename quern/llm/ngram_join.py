"""Jaccard join on word n-grams by prefix filters under several global token orders.

Under one global order two sets that link must share a token in their prefixes. Three orders are used: by document
frequency with ties by hash, and twice by logarithmic frequency class with ties by another hash each. A pair is verified
only if it passes all of them (and the length and position bounds).

1. Every text becomes its set of shingle hashes; texts with equal sets become one class, known by its smallest doc_id.
2. A consistent hash sample of the tokens, filled up to a full prefix for each class, is counted over all classes. It
   is the head of a valid global order, so a class whose prefix there holds only tokens of its own links with nothing.
3. For the others all tokens are counted, and the prefixes under the three orders are formed.
4. Each class is first compared with one pivot of the tokens it shares, which ties groups of near copies together;
   then all pairs of different components that pass the filters are compared, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import byte_blocks, fresh, lean, lean_group, mix, scatter, Scratch, shipped_by_value, text_bytes, WordHashes
from quern.llm.graph import connected_components

C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
SEEDS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
#: Share of the hash space that the counted sample of step 2 holds.
SAMPLE = 0.3
#: Tokens that would take up HOT of a part and more, by a sample of about SAMPLE_SETS sets, are not dealt by token.
HOT, SAMPLE_SETS = 1 / 8, 4000
#: As many sets of each side as meet in one cell of a token, about.
CELL = 4096


def shingles(text: bytes, hashes: WordHashes, size: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; fewer words than size make one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = hashes.of(words)
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), dtype=np.uint64)
    for k in range(min(size, len(h))):
        out = mix(out * C1 + h[k : k + n])
    return np.unique(out)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit fingerprints of a set."""
    if not len(s):
        return 0, 0
    return int(np.add.reduce(mix(s ^ C2)).astype(np.int64)), int(np.bitwise_xor.reduce(mix(s + C3)).astype(np.int64))


def misses(n: np.ndarray | int, percent: int):
    """How many tokens a set of n may lack in a set it links with: n - ceil(percent * n / 100)."""
    return n - -(-percent * n // 100)


def counted_head(s: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of s that step 2 counts, as their top 40 bits: the sample, and what the prefix needs beyond it."""
    t = np.unique(s >> np.uint64(24))
    inside = int(np.searchsorted(t, np.uint64(int(SAMPLE * (1 << 40)))))
    return t[: max(inside, misses(len(s), percent) + 1)]


def class_id(s: np.ndarray) -> tuple[int, int]:
    """(id of a set, a second fingerprint): together they tell sets apart."""
    k1, k2 = set_key(s)
    with np.errstate(over="ignore"):
        x = np.array([len(s), k1, k2], dtype=np.int64).view(np.uint64)
        return int(mix(mix(mix(x[:1] + C1) ^ x[1:2]) + x[2:3]).view(np.int64)[0]), k2


def _five(tokens: np.ndarray) -> bytes:
    """40-bit numbers in five bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unfive(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def _hashed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), n, cid and k (the set's ids), head (how many tokens step 2 counts) and tokens
    (those, once for each set in a task) for every row; cid and k are null without shingles."""
    fields = [("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("k", pa.int64()), ("head", pa.int64()), ("tokens", pa.binary())]

    def rows(batches):
        hashes, seen = WordHashes(), set()
        for b in batches:
            for i, texts in byte_blocks(b.column(2)):
                out = []
                for t in texts:
                    s = shingles(t, hashes, size)
                    if not len(s):
                        out.append((0, None, None, 0, None))
                        continue
                    key = class_id(s)
                    head = counted_head(s, percent)
                    out.append((len(s), *key, len(head), None if key in seen else _five(head)))
                    if len(seen) < 50_000:
                        seen.add(key)
                ids = [b.column(c).slice(i, len(texts)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array([x[c] for x in out], kind) for c, (_, kind) in enumerate(fields[2:]))], names=[f for f, _ in fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(lean(rows), "doc_id long, th long, n long, cid long, k long, head long, tokens binary")


def _told_apart(every: DataFrame) -> DataFrame:
    """The rows, in which sets with the same id but different second fingerprints get ids of their own."""
    keys = every.where("cid is not null").groupBy("cid").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low <> high").select(F.col("cid").alias("twice"))
    if keys.isEmpty():
        return every
    joined = every.join(keys, F.col("cid") == F.col("twice"), "left")
    return joined.withColumn("cid", F.when(F.col("twice").isNotNull(), F.xxhash64("cid", "k")).otherwise(F.col("cid"))).drop("twice")


def _flat(batches, heads: bool, block: int):
    """(cids, tokens, owner) of blocks of the sets in batches(cid, tokens binary), about `block` tokens each; owner is the
    place of a token's cid. Heads are 40-bit numbers."""
    for b in batches:
        cids = np.asarray(b.column(0)).astype(np.int64)
        for i, blobs in byte_blocks(b.column(1), block * (5 if heads else 8)):
            arrays = [_unfive(x) if heads else np.frombuffer(x, dtype="u8") for x in blobs]
            yield cids[i : i + len(blobs)], np.concatenate(arrays), np.repeat(np.arange(len(arrays), dtype=np.int32), [len(x) for x in arrays])


def _among(hot: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are hot, and the places of those in the sorted list."""
    if not len(hot):
        return np.zeros(len(tokens), dtype=bool), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
    found = hot[at] == tokens
    return found, at[found]


def _hot(sets: DataFrame, heads: bool, n_sets: int, part: int) -> np.ndarray:
    """Sorted tokens that would take up HOT of a part of `part` tokens, by a sample. Each occurs in two sets at least;
    there can't be more than parts / HOT of them."""

    def count(batches):
        for _, tokens, _ in _flat(batches, heads, 500_000):
            own, n = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["token", "n"])

    share = min(1.0, SAMPLE_SETS / max(1, n_sets))
    sample = sets.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["cid"])
    found = sample.mapInArrow(lean(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, share * part * HOT))
    return np.sort(np.array([r["token"] for r in found.select("token").toLocalIterator()], dtype=np.int64).view(np.uint64))


def _dealt(sets: DataFrame, heads: bool, bits: int, hot: np.ndarray, block: int = 500_000) -> DataFrame:
    """sets(cid, tokens binary) -> exchanged blocks (part, cids, counts, tokens): tokens that aren't hot by their top bits.
    A block holds the tokens of many sets, about `block` of them; counts say how many tokens in a row belong to each cid.
    Heads come as 40-bit numbers, of which a block holds the lower 32."""

    def rows(batches):
        for cids, tokens, owner in _flat(batches, heads, block):
            usual = ~_among(hot, tokens)[0]
            tokens, owner = tokens[usual], owner[usual]
            part = (tokens >> np.uint64((40 if heads else 64) - bits)).astype(np.int32)
            out = []
            for p, own, tok in scatter(part, 1 << bits, owner, tokens.astype(np.uint32) if heads else tokens):
                own = np.frombuffer(own, dtype=np.int32)
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                counts = np.diff(np.r_[starts, len(own)]).astype(np.uint32)
                out.append((p, cids[own[starts]].tobytes(), counts.tobytes(), tok))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "cids", "counts", "tokens"])

    return sets.mapInArrow(lean(rows), "part int, cids binary, counts binary, tokens binary")


def _hot_heads(heads: DataFrame, bits: int, hot: np.ndarray) -> DataFrame:
    """Blocks (part, cids, counts, hot) by set: how many hot tokens each has. All of them are in other sets too."""

    def rows(batches):
        for cids, tokens, owner in _flat(batches, True, 500_000):
            n = np.bincount(owner[_among(hot, tokens)[0]], minlength=len(cids))
            own, n = cids[n > 0], n[n > 0].astype(np.uint32)
            out = scatter((own.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), 1 << bits, own, n)
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))), pa.array([True] * len(out), pa.bool_())], names=["part", "cids", "counts", "hot"])

    return heads.mapInArrow(lean(rows), "part int, cids binary, counts binary, hot boolean")


def _hot_frequencies(sets: DataFrame, bits: int, hot: np.ndarray) -> DataFrame:
    """Blocks (part, cids, counts, tokens, df) by set of the hot tokens. Tasks add up first; the sums are as few as the
    hot tokens."""

    def count(batches):
        n = np.zeros(len(hot), dtype=np.int64)
        for _, tokens, _ in _flat(batches, False, 500_000):
            n += np.bincount(_among(hot, tokens)[1], minlength=len(hot))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["i", "n"])

    df = np.zeros(len(hot), dtype=np.uint32)
    for r in sets.mapInArrow(lean(count), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r["i"]] = r["n"]

    def rows(batches):
        for cids, tokens, owner in _flat(batches, False, 500_000):
            found, at = _among(hot, tokens)
            yield _by_set(cids[owner[found]], bits, tokens[found], df[at])

    return sets.mapInArrow(lean(rows), "part int, cids binary, counts binary, tokens binary, df binary")


def _by_set(cids: np.ndarray, bits: int, tokens: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    """One block for each part of sets; cids come in runs."""
    out = []
    for p, own, *rest in scatter((cids.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32), 1 << bits, cids, tokens, df):
        own = np.frombuffer(own, dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out.append((p, own[starts].tobytes(), np.diff(np.r_[starts, len(own)]).astype(np.uint32).tobytes(), *rest))
    kinds = (("part", pa.int32()), ("cids", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("df", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def _gathered(table: pa.Table, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """cids and tokens of a part's blocks, one entry each per token."""
    n = sum(len(x.as_py()) for x in table.column("tokens")) // np.dtype(dtype).itemsize
    cids, tokens, at = np.empty(n, dtype=np.int64), np.empty(n, dtype=dtype), 0
    for c, k, t in zip(*(table.column(x) for x in ("cids", "counts", "tokens")), strict=True):
        own = np.frombuffer(t.as_py(), dtype=dtype)
        tokens[at : at + len(own)] = own
        cids[at : at + len(own)] = np.repeat(np.frombuffer(c.as_py(), dtype=np.int64), np.frombuffer(k.as_py(), dtype=np.uint32))
        at += len(own)
    return cids, tokens


def _survivors(classes: DataFrame, heads: DataFrame, bits: int, percent: int, hot: np.ndarray) -> DataFrame:
    """cid, rep, n, k of the classes whose prefix under the sampled order holds a token of another class.

    A set may come from several tasks, so tokens are counted by distinct cid, and of its numbers of hot tokens, which
    are the same, one is taken. Parts answer with blocks of counts."""

    def shared(table: pa.Table) -> pa.Table:
        cids, tokens = _gathered(table, "u4")
        order = np.lexsort((cids, tokens))
        cids, tokens = cids[order], tokens[order]
        del order
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (cids[1:] != cids[:-1])]
        cids, tokens = cids[new], tokens[new]
        same = tokens[1:] == tokens[:-1]
        met = np.r_[same, False] | np.r_[False, same]
        own, n = np.unique(cids[met], return_counts=True)
        out = scatter((own.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), 1 << bits, own, n.astype(np.uint32))
        return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), "cids": pa.array([x[1] for x in out], pa.binary()), "counts": pa.array([x[2] for x in out], pa.binary()), "hot": pa.array([False] * len(out), pa.bool_())})

    def summed(table: pa.Table) -> pa.Table:
        cids = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table.column("cids").to_pylist()])
        n = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in table.column("counts").to_pylist()])
        whole = np.repeat(np.array(table.column("hot").to_pylist(), dtype=bool), [len(x) // 8 for x in table.column("cids").to_pylist()])
        own, at = np.unique(cids, return_inverse=True)
        most = np.zeros(len(own), dtype=np.int64)
        np.maximum.at(most, at[whole], n[whole])
        return pa.table({"cid": own, "c": np.bincount(at[~whole], weights=n[~whole], minlength=len(own)).astype(np.int64) + most})

    blocks = _dealt(heads, True, bits, hot).groupBy("part").applyInArrow(lean_group(shared), "part int, cids binary, counts binary, hot boolean")
    if len(hot):
        blocks = blocks.unionAll(_hot_heads(heads, bits, hot))
    met = blocks.groupBy("part").applyInArrow(lean_group(summed), "cid long, c long")
    need = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    return classes.join(met, "cid").where(F.col("head") - F.col("c") < need).select("cid", "rep", "n", "k")


def _maybe_in(ids: DataFrame, column: str, n: int) -> Callable[[Column], Column]:
    """A test that passes every id of the column and, for a Bloom filter of bounded size, few others; what passes is
    joined exactly afterwards. 16 slots an id up to 2 ** 23 in all."""
    bits = min(23, max(10, (16 * n).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    words = ids.select(F.shiftright(slot(F.col(column)), 6).cast("int").alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot(F.col(column)), F.lit(64)).cast("int")).alias("b"))
    table = [0] * ((1 << bits) // 64)
    for r in words.groupBy("i").agg(F.bit_or("b").alias("b")).toLocalIterator():
        table[r["i"]] = r["b"]
    literal = F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<bigint>")
    return lambda c: F.call_function("shiftright", F.get(literal, F.shiftright(slot(c), 6).cast("int")), F.pmod(slot(c), F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _frequencies(sets: DataFrame, bits: int, hot: np.ndarray) -> DataFrame:
    """Blocks (part, cids, counts, tokens, df): the tokens of the sets with their frequencies, dealt by set."""

    def counted(table: pa.Table) -> pa.Table:
        cids, tokens = _gathered(table, "u8")
        order = np.argsort(tokens)
        at = np.flatnonzero(np.r_[True, np.diff(tokens[order]) != 0]) if len(tokens) else np.zeros(0, dtype=np.int64)
        n = np.diff(np.r_[at, len(tokens)])
        df = np.empty(len(tokens), dtype=np.uint32)
        df[order] = np.repeat(n, n).astype(np.uint32)
        order = np.argsort(cids, kind="stable")
        cids, tokens, df = cids[order], tokens[order], df[order]
        del order, at, n
        return pa.Table.from_batches([_by_set(cids, bits, tokens, df)])

    sets = sets.select("cid", "tokens")
    out = _dealt(sets, False, bits, hot).groupBy("part").applyInArrow(lean_group(counted), "part int, cids binary, counts binary, tokens binary, df binary")
    return out.unionAll(_hot_frequencies(sets, bits, hot)) if len(hot) else out


def prefixes(tokens: np.ndarray, df: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tokens that other sets have too, their positions) of the prefix under each order."""
    need = misses(len(tokens), percent) + 1
    grade = np.floor(np.log2(df)).astype(np.int64)
    out = []
    for first, second in ((df, tokens), (grade, mix(tokens ^ SEEDS[0])), (grade, mix(tokens ^ SEEDS[1]))):
        order = np.lexsort((second, first))[:need]
        at = np.flatnonzero(df[order] > 1)
        out.append((tokens[order[at]], at))
    return out


def parity_sketch(tokens: np.ndarray) -> list[int]:
    """256 parities of how many tokens fall into each bin. Two sets differ in at least as many tokens as their
    sketches differ in bits."""
    odd = np.bincount((tokens >> np.uint64(8)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _prefix_table(counted: DataFrame, percent: int) -> DataFrame:
    """cid, n, p0, at0, p1, p2, sketch of the sets that share a token under every order."""
    names, kinds = ("cid", "n", "p0", "at0", "p1", "p2", "sketch"), (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 5)

    def rows(table: pa.Table) -> pa.Table:
        cids, tokens = _gathered(table, "u8")
        df = np.concatenate([np.frombuffer(x.as_py(), dtype="u4") for x in table.column("df")])
        order = np.argsort(cids, kind="stable")
        cids, tokens, df = cids[order], tokens[order], df[order]
        edges = np.flatnonzero(np.r_[True, cids[1:] != cids[:-1], True]).tolist()
        out = []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            found = prefixes(tokens[a:z], df[a:z], percent)
            if all(len(x[0]) for x in found):
                out.append((int(cids[a]), z - a, found[0][0].view(np.int64), found[0][1], found[1][0].view(np.int64), found[2][0].view(np.int64), parity_sketch(tokens[a:z])))
        return pa.table({n: pa.array([x[k] for x in out], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return counted.groupBy("part").applyInArrow(lean_group(rows), "cid long, n long, p0 array<long>, at0 array<long>, p1 array<long>, p2 array<long>, sketch array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets link."""
    a = sets.select(F.col("cid").alias("u"), F.col("tokens").alias("a"))
    b = sets.select(F.col("cid").alias("v"), F.col("tokens").alias("b"))

    def rows(batches):
        for x in batches:
            keep = []
            for s, t in zip(x.column(2), x.column(3), strict=True):  # one pair in memory beside the batch
                s, t = np.frombuffer(s.as_py(), dtype="u8"), np.frombuffer(t.as_py(), dtype="u8")
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append((100 + percent) * both >= percent * (len(s) + len(t)))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(lean(rows), "u long, v long")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def similar_groups(docs: DataFrame, size: int = 3, percent: int = 90, part_tokens: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    Two documents link when their shingle sets have percent % of their union in common; component_id is the smallest
    doc_id that links lead to. Texts without words link with nothing. Repeated rows are copies of each other, a null
    doc_id is never a component_id unless there is no other. Shingles are told apart by 64-bit hashes, sets by two of
    them. An empty table gives no rows.
    """
    return _groups(docs, size, percent, part_tokens).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _groups(docs: DataFrame, size: int, percent: int, part_tokens: int = 500_000) -> DataFrame:
    """doc_id, th, n, root (the group, null without words) and component_id for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    tokens = text_bytes(docs) // 6
    bits = lambda n: max(3, min(16, (int(n) // part_tokens).bit_length()))
    every = _told_apart(scratch.table(_hashed(docs, size, percent), "every"))
    none = -(1 << 63)
    classes = every.where("cid is not null").groupBy("cid").agg(F.first("n").alias("n"), F.first("head").alias("head"), F.coalesce(F.min("doc_id"), F.lit(none)).alias("rep"), F.first("k").alias("k"))
    counted = every.where("tokens is not null").select("cid", "tokens")
    part = lambda n: max(part_tokens, int(n) >> bits(n))
    hot = _hot(counted, True, counted.count(), part(SAMPLE * tokens))
    left = scratch.table(_survivors(classes, counted, bits(SAMPLE * tokens), percent, hot), "left")

    def whole(batches):
        hashes = WordHashes()
        for b in batches:
            for i, texts in byte_blocks(b.column(2)):
                sets = [shingles(t, hashes, size) for t in texts]
                keys = [class_id(s)[1] if len(s) else None for s in sets]
                same = [x == y for x, y in zip(keys, b.column(1).slice(i, len(texts)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(texts)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "tokens"]).filter(pa.array(same, pa.bool_()))

    maybe = _maybe_in(left, "rep", left.count())
    reps = docs.withColumn("rep", F.coalesce(F.col("doc_id").cast("long"), F.lit(none))).where(maybe(F.col("rep"))).join(left, "rep").select("cid", "k", "text")
    sets = reps.mapInArrow(lean(whole), "cid long, tokens binary")
    sets = scratch.table(sets.groupBy("cid").agg(F.first("tokens").alias("tokens")), "sets")
    n_sets, n_left = map(int, sets.select(F.count("*"), F.coalesce(F.sum(F.octet_length("tokens") / 8), F.lit(0))).first())
    hot = _hot(sets, False, n_sets, part(n_left))
    heads = scratch.table(_prefix_table(_frequencies(sets, bits(n_left), hot), percent), "heads")

    postings = heads.select("cid", "n", "sketch", F.explode(F.arrays_zip("p0", "at0")).alias("x")).select(F.col("x.p0").alias("token"), "cid", "n", "sketch", F.col("x.at0").alias("at"))
    # The pivot is the set with the fewest rarer tokens, so the least edited one of a group of near copies.
    pivots = postings.groupBy("token").agg(F.min_by("cid", F.struct("at", "cid")).alias("pivot"), F.count("*").alias("c")).where("c > 1").select("token", "pivot")
    stars = postings.join(pivots, "token").where("cid <> pivot").groupBy("cid", "pivot").agg(F.count("*").alias("c"))
    stars = stars.groupBy("cid").agg(F.max_by("pivot", F.struct("c", -F.col("pivot"))).alias("pivot")).select(F.col("cid").alias("u"), F.col("pivot").alias("v"))
    edges = scratch.table(_verified(stars, sets, percent), "stars")
    roots = scratch.table(connected_components(edges), "roots")

    own = postings.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("token", "cid", "n", "sketch", "at", F.coalesce("root", "cid").alias("root"))
    own = scratch.table(own, "own")
    sizes = own.groupBy("token", "root").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.count("*").alias("roots"), F.sum("c").alias("c")).where("roots > 1").select("token", "major", F.ceil(F.col("c") / CELL).cast("int").alias("cells"))
    # A token's sets are dealt over cells x cells tasks, so that each pair still meets once.
    there = own.join(mixed, "token").withColumn("cell", F.pmod(F.xxhash64("cid"), F.col("cells")).cast("int"))
    every_cell = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    a = there.where("root <> major").select("token", F.col("cell").alias("i"), every_cell.alias("j"), F.col("cid").alias("u"), F.col("n").alias("an"), F.col("at").alias("ai"), F.col("root").alias("ar"), F.col("sketch").alias("s"))
    b = there.select("token", every_cell.alias("i"), F.col("cell").alias("j"), F.col("cid").alias("v"), F.col("n").alias("bn"), F.col("at").alias("bi"), F.col("root").alias("br"), F.col("sketch").alias("t"), "major")
    most = 1 + F.least(F.col("an") - F.col("ai") - 1, F.col("bn") - F.col("bi") - 1)
    bound = (F.lit(100 + percent) * most >= F.lit(percent) * (F.col("an") + F.col("bn"))) & _sizes_fit(F.col("an"), F.col("bn"), percent)
    # Sets that link differ in at most (100 - percent) / (100 + percent) of their sizes added up.
    apart = sum((F.bit_count(F.get("s", F.lit(k)).bitwiseXOR(F.get("t", F.lit(k)))) for k in range(4)), F.lit(0))
    bound = bound & (F.lit(100 + percent) * apart <= F.lit(100 - percent) * (F.col("an") + F.col("bn")))
    once = (F.col("br") == F.col("major")) | (F.col("u") < F.col("v"))
    pairs = a.join(b, ["token", "i", "j"]).where((F.col("ar") != F.col("br")) & once & bound).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    p = heads.select("cid", "p1", "p2")
    pairs = pairs.join(p.toDF("u", "a1", "a2"), "u").join(p.toDF("v", "b1", "b2"), "v").where(F.arrays_overlap("a1", "b1") & F.arrays_overlap("a2", "b2")).select("u", "v")
    more = scratch.table(_verified(pairs, sets, percent), "more")
    # Links between whole components are few, however many pairs there are.
    up, vp = roots.toDF("u", "ur"), roots.toDF("v", "vr")
    lifted = more.join(up, "u", "left").join(vp, "v", "left").select(F.coalesce("ur", "u").alias("u"), F.coalesce("vr", "v").alias("v")).distinct()
    merged = connected_components(lifted).toDF("root", "merged")

    named = classes.select("cid", "rep").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = named.join(merged, "root", "left").withColumn("root", F.coalesce("merged", "root"))
    least = named.groupBy("root").agg(F.min(F.when(F.col("rep") != none, F.col("rep"))).alias("component"))
    lookup = named.join(least, "root").select("cid", "root", "component")
    out = every.select("doc_id", "th", "n", "cid").join(lookup, "cid", "left")
    for name in ("left", "sets", "heads", "stars", "own", "more"):
        scratch.drop(name)
    return out.select("doc_id", "th", "n", "root", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """docs with all columns, one document of each group: the one of smallest doc_id, a null one only where the group
    has no other. Of rows equal in id and text the first by all columns as JSON stays. A text without words is a group
    of its own together with its repeated rows."""
    groups = _groups(docs, size, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = groups.groupBy("component_id", "root", "th", F.col("root").isNull().alias("alone")).agg(F.count("*").alias("n"))
    least = rows.groupBy("component_id", "root", F.when(F.col("alone"), F.col("th")).alias("own")).agg(F.min(F.struct("th", "n")).alias("x"))
    id_, th, n = fresh(docs, 3)
    keep = least.select(F.col("component_id").alias(id_), F.col("x.th").alias(th), F.col("x.n").alias(n))
    kept = docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(th)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.where(F.col(n) == 1).select(*names)
    whole = F.struct(*names)
    repeated = kept.where(F.col(n) > 1).groupBy(id_, th).agg(F.min_by(whole, F.to_json(whole)).alias(n)).select(f"{n}.*")
    return once.unionAll(repeated)


shipped_by_value(__name__)
