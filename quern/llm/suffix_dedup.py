"""Removal of long repeated byte strings with suffix arrays built by the difference-cover algorithm.

A byte goes if a string of LENGTH bytes over it also starts in a document with a smaller id. The work is dealt by
content so that every suffix array fits into a task:

1. Every string of LENGTH bytes has a key: the least hash among its GRAM-byte grams. Equal strings have equal keys, so
   only strings whose key occurs in two documents can repeat; the rest, most of a corpus, is left out from here on.
2. Consecutive strings with the same key form a piece. Pieces are exchanged by key (strings of very frequent keys one by
   one, by their own hash); pieces that are equal within a task are combined before.
3. A task joins its pieces to one text and sorts its suffixes: triples at two of three positions are sorted and named,
   the names' suffixes are sorted by recursion, the remaining suffixes are merged in. Suffixes that begin a string are
   compared with their neighbours over LENGTH bytes; of each class of equal ones the smallest document keeps it.
4. What was found goes back to the documents, which drop the covered bytes.

Recursion ends once a name stands for LENGTH bytes or more, since longer agreement makes no difference.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import byte_blocks, lean, lean_group, mix, scatter, Scratch, shipped_by_value, text_bytes

LENGTH, GRAM = 50, 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Documents whose id is null come after all others.
LAST = (1 << 63) - 1
#: Keys with more documents than this, and than a share of 2 ** -20 of all, are dealt string by string.
HOT = 4096
#: Bytes of text that a suffix array is built over at once, as far as keys can be told apart.
SHARE = 256 << 10


def _joined(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> np.ndarray:
    """Hashes of size_a + size_b bytes from those of the first size_a and the size_b after them."""
    n = len(a) - size_b
    return a[:n] * np.uint64(pow(int(BASE), size_b, 1 << 64)) + b[size_a : size_a + n]


def string_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes at every position, by doubling."""
    power, table = 1, (mix(np.arange(1, 257, dtype=np.uint64) * BASE))[buf]
    done, have = None, 0
    while True:
        if size & power:
            done, have = (table, power) if done is None else (_joined(done, table, have, power), have + power)
        if have == size:
            return done[: max(0, len(buf) - size + 1)]
        table = _joined(table, table, power, power)
        power *= 2


def string_keys(buf: np.ndarray) -> np.ndarray:
    """The key of the LENGTH bytes at every position."""
    m = mix(string_hashes(buf, GRAM))
    width, have = LENGTH - GRAM + 1, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :])


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, owner, first, end, key) of the runs of strings with one key: strings start at first..end-1."""
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    if len(buf) < LENGTH:
        return buf, none, none, none, none.astype(np.uint64)
    keys = string_keys(buf)
    starts = np.cumsum(lens) - lens
    new = np.zeros(len(keys) + 1, dtype=bool)
    new[1:-1] = keys[1:] != keys[:-1]
    new[starts[starts < len(keys)]] = True
    new[0] = new[-1] = True
    at = np.flatnonzero(new)
    first, end = at[:-1], at[1:]
    owner = np.searchsorted(starts, first, side="right") - 1
    end = np.minimum(end, starts[owner] + lens[owner] - LENGTH + 1)
    good = end > first
    return buf, owner[good], first[good], end[good], keys[first[good]]


# --- the suffix array ----------------------------------------------------------------------------


def suffix_order(s: np.ndarray, covers: int = 1, length: int = LENGTH) -> np.ndarray:
    """Positions of s in the order of their suffixes, exact as far as `length` bytes of which a symbol covers `covers`.

    Symbols are positive and under 2 ** 21 at the top; names below have as many values as positions.
    """
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    x = np.concatenate([s.astype(np.uint64), np.zeros(6, dtype=np.uint64)])
    width = np.uint64(int(x.max()).bit_length())
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    if 3 * int(width) <= 64:
        triples = (x[sample] << width | x[sample + 1]) << width | x[sample + 2]
    else:
        pairs = np.unique(x[sample] << width | x[sample + 1], return_inverse=True)[1].astype(np.uint64)
        triples = pairs << width | x[sample + 2]
    names = np.unique(triples, return_inverse=True)[1]
    if names.max() + 1 < len(sample) and 3 * covers < length:
        order = suffix_order(names + 1, 3 * covers, length)
    else:
        order = np.argsort(names)
    ranks = np.zeros(n + 6, dtype=np.uint64)
    ranks[sample[order]] = np.arange(1, len(sample) + 1, dtype=np.uint64)
    bits = np.uint64(int(len(sample) + 1).bit_length())
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    rest = np.arange(0, n, 3)
    rest_key = x[rest] << bits | ranks[rest + 1]
    by = np.argsort(rest_key)
    rest, rest_key = rest[by], rest_key[by]
    # Ranks of the remaining suffixes among the sampled ones, by the residue that makes both sides comparable.
    is_one = sorted_sample % 3 == 1
    one, two = sorted_sample[is_one], sorted_sample[~is_one]
    place = np.empty(n, dtype=np.int64)
    below_one = np.searchsorted(x[one] << bits | ranks[one + 1], rest_key)
    if int(width) * 2 + int(bits) <= 64:
        pair, pair_rest = x[two] << width | x[two + 1], x[rest] << width | x[rest + 1]
    else:
        names2 = np.unique(np.concatenate([x[two] << width | x[two + 1], x[rest] << width | x[rest + 1]]), return_inverse=True)[1].astype(np.uint64)
        pair, pair_rest = names2[: len(two)], names2[len(two) :]
    below_two = np.searchsorted(pair << bits | ranks[two + 2], pair_rest << bits | ranks[rest + 2])
    place[rest] = np.arange(len(rest)) + below_one + below_two
    inserted = np.bincount(np.minimum(below_one + below_two, len(sorted_sample)), minlength=len(sorted_sample) + 1)
    place[sorted_sample] = np.arange(len(sorted_sample)) + np.cumsum(inserted)[: len(sorted_sample)]
    if (np.bincount(place, minlength=n)[:n] == 1).all():
        out = np.empty(n, dtype=np.int64)
        out[place] = np.arange(n)
        return out
    return np.argsort(place, kind="stable")  # among suffixes that agree over `length` bytes, places may coincide


def equal_strings(order: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """Class of each of the given positions, which stand in suffix order: adjacent prefixes of LENGTH bytes compared."""
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(LENGTH + 8, dtype=np.uint8)]), 8)
    differs = np.zeros(max(0, len(order) - 1), dtype=bool)
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        w = words[order + k].copy().view(np.uint64)[:, 0]
        differs |= w[1:] != w[:-1]
    return np.concatenate([[0], np.cumsum(differs)]) if len(order) else np.zeros(0, dtype=np.int64)


def repeated(blobs: list[bytes], docs: np.ndarray) -> np.ndarray:
    """Rows (index, first, end) of the runs of strings in the blobs that also stand in a blob of a smaller document.

    Equal blobs of several documents are sorted as one.
    """
    index: dict[bytes, int] = {}
    of = np.fromiter((index.setdefault(b, len(index)) for b in blobs), dtype=np.int64, count=len(blobs))
    texts = list(index)
    least = np.full(len(texts), LAST, dtype=np.int64)
    np.minimum.at(least, of, docs)
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    starts, strings = np.cumsum(lens) - lens, lens - LENGTH + 1
    owner = np.repeat(np.arange(len(texts)), lens)
    whole = np.arange(len(buf)) - starts[owner] < strings[owner]
    order = suffix_order(buf.astype(np.int64) + 1)
    order = order[whole[order]]
    classes = equal_strings(order, buf)
    lowest = np.full(int(classes[-1]) + 1 if len(classes) else 0, LAST, dtype=np.int64)
    np.minimum.at(lowest, classes, least[owner[order]])
    best = np.full(len(buf), LAST, dtype=np.int64)
    best[order] = lowest[classes]
    ends = np.stack([starts, starts + strings], axis=1).ravel()
    low, high = np.minimum.reduceat(best, ends)[::2][of], np.maximum.reduceat(best, ends)[::2][of]
    full = np.flatnonzero(high < docs)
    out = [np.stack([full, np.zeros(len(full), dtype=np.int64), strings[of[full]]], axis=1)]
    for i in np.flatnonzero((low < docs) & (high >= docs)).tolist():
        a = int(starts[of[i]])
        hit = best[a : a + int(strings[of[i]])] < docs[i]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        out.append(np.stack([np.full(len(edge) // 2, i), edge[::2], edge[1::2]], axis=1))
    return np.concatenate(out)


def repeated_in_shares(blobs: list[bytes], docs: np.ndarray) -> np.ndarray:
    """The same for blobs of any size together. Where they come to more than four shares (then they have few keys, of
    very many documents), their strings are dealt by their own hash, and each share of strings is sorted for itself."""
    size = sum(map(len, blobs))
    if size <= 4 * SHARE:
        return repeated(blobs, docs)
    shares = min(1 << 16, 1 << (size * 8 // SHARE).bit_length())
    dealt: list[list[np.ndarray]] = [[] for _ in range(shares)]
    for i, b in enumerate(blobs):
        share = (mix(string_hashes(np.frombuffer(b, dtype=np.uint8), LENGTH)) >> np.uint64(32)).astype(np.int64) & (shares - 1)
        order = np.argsort(share, kind="stable")
        edges = np.flatnonzero(np.r_[True, share[order][1:] != share[order][:-1], True])
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = order[a:z]
            dealt[int(share[at[0]])].append(np.stack([np.full(len(at), i), at], axis=1))
    out = [np.zeros((0, 3), dtype=np.int64)]
    for rows in dealt:
        if rows:
            at = np.concatenate(rows)
            found = at[repeated([blobs[i][k : k + LENGTH] for i, k in at.tolist()], docs[at[:, 0]])[:, 0]]
            out.append(np.stack([found[:, 0], found[:, 1], found[:, 1] + 1], axis=1))
    return np.concatenate(out)


# --- exchanges -----------------------------------------------------------------------------------


def _rows(values: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v[k] for v in values], t) for k, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


def _ids(column: pa.Array) -> np.ndarray:
    return np.array([LAST if v is None else v for v in column.to_pylist()], dtype=np.int64)


def _candidates(docs: DataFrame, bits: int, hot: int) -> DataFrame:
    """Blocks (part, ids, keys): keys, as uint64 of 32 + bits bits, that other documents have too, each with the document
    it is told to, dealt by document. Part -1 holds keys of very many documents.

    A task sends each of its keys once: with the document if only one has it, else with the number of documents. The
    answers for the latter need nobody else and are only passed on.
    """
    shift = np.uint64(32 - bits)
    schema = [("part", pa.int32()), ("rem", pa.binary()), ("ids", pa.binary()), ("many", pa.binary()), ("counts", pa.binary()), ("to", pa.binary()), ("keys", pa.binary())]

    def flush(keys: list[np.ndarray], owners: list[np.ndarray], ids: list[int]):
        if not keys or not sum(map(len, keys)):
            return
        assert len(ids) <= 1 << 16  # byte_blocks holds fewer rows
        own_ids = np.array(ids, dtype=np.int64)
        u = np.unique(np.concatenate(keys) >> shift << np.uint64(16) | np.concatenate(owners).astype(np.uint64))
        k, d = u >> np.uint64(16), (u & np.uint64(0xFFFF)).astype(np.int64)
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        counts = np.diff(np.r_[at, len(k)])
        one = counts == 1
        part = lambda x: (x >> np.uint64(32)).astype(np.int64)
        single, several = k[at[one]], k[at[~one]]
        rows: dict[int, list] = {}
        for p, *x in scatter(part(single), 1 << bits, single.astype(np.uint32), own_ids[d[at[one]]].astype(np.int64)):
            ids_ = np.frombuffer(x[1], dtype=np.int64)
            rows[p] = [p, x[0], ids_.astype(np.uint32).tobytes() if len(ids_) and 0 <= ids_.min() and ids_.max() < 1 << 32 else x[1], None, None, None, None]
        for p, *x in scatter(part(several), 1 << bits, several.astype(np.uint32), counts[~one].astype(np.uint32)):
            rows.setdefault(p, [p, *[None] * 6])[3:5] = x
        repeat = np.repeat(~one, counts)
        to = own_ids[d[repeat]]
        for p, *x in scatter((mix(to.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64), 1 << bits, to, k[repeat]):
            rows.setdefault(p, [p, *[None] * 6])[5:7] = x
        yield _rows(list(map(tuple, rows.values())), schema)

    def send(batches):
        keys, owners, ids, n = [], [], [], 0
        for b in batches:
            own = _ids(b.column(0)).tolist()
            for i, texts in byte_blocks(b.column(1)):
                _, owner, _, _, key = pieces(texts)
                if n + len(key) > 1_500_000 or len(ids) + len(texts) > 60_000:
                    yield from flush(keys, owners, ids)
                    keys, owners, ids, n = [], [], [], 0
                keys.append(key)
                owners.append(owner + len(ids))
                ids += own[i : i + len(texts)]
                n += len(key)
        yield from flush(keys, owners, ids)

    def meet(table: pa.Table) -> pa.Table:
        part = np.uint64(table.column("part")[0].as_py()) << np.uint64(32)
        rem, ids, many, counts, to, keys = [], [], [], [], [], []
        for r in table.select([n for n, _ in schema[1:]]).to_pylist():
            if r["rem"]:
                rem.append(np.frombuffer(r["rem"], dtype=np.uint32))
                ids.append(np.frombuffer(r["ids"], dtype=np.uint32 if len(r["ids"]) == len(r["rem"]) else np.int64).astype(np.int64))
            if r["many"]:
                many.append(np.frombuffer(r["many"], dtype=np.uint32))
                counts.append(np.frombuffer(r["counts"], dtype=np.uint32).astype(np.int64))
            if r["to"]:
                to.append(np.frombuffer(r["to"], dtype=np.int64))
                keys.append(np.frombuffer(r["keys"], dtype=np.uint64))
        nothing = np.zeros(0, dtype=np.int64)
        cat = lambda a, t: np.concatenate(a) if a else nothing.astype(t)
        rem, ids, many, counts = cat(rem, np.uint32), cat(ids, np.int64), cat(many, np.uint32), cat(counts, np.int64)
        to, keys = cat(to, np.int64), cat(keys, np.uint64)
        every, weight = np.concatenate([rem, many]), np.concatenate([np.ones(len(rem), dtype=np.int64), counts])
        hot_keys = nothing.astype(np.uint64)
        if len(every):
            order = np.argsort(every, kind="stable")
            at = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]])
            group = np.empty(len(every), dtype=np.int64)
            group[order] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(every)]))
            total = np.add.reduceat(weight[order], at)
            low = np.minimum.reduceat(np.concatenate([ids, np.full(len(many), -1 << 62)])[order], at)
            high = np.maximum.reduceat(np.concatenate([ids, np.full(len(many), LAST)])[order], at)
            reply = (low != high)[group[: len(rem)]]
            to = np.concatenate([to, ids[reply]])
            keys = np.concatenate([keys, part | rem[reply].astype(np.uint64)])
            hot_keys = part | every[order][at][total > hot].astype(np.uint64)
        rows = scatter((mix(to.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64), 1 << bits, to, keys)
        if len(hot_keys):
            rows.append((-1, b"", hot_keys.tobytes()))
        return pa.Table.from_batches([_rows(rows, [("part", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary())])])

    sent = docs.select("doc_id", "text").mapInArrow(lean(send), "part int, rem binary, ids binary, many binary, counts binary, to binary, keys binary")
    return sent.groupBy("part").applyInArrow(lean_group(meet), "part int, ids binary, keys binary")


def _key_lists(blocks: DataFrame) -> DataFrame:
    """(doc_id, keys): one row for each document that was told keys."""

    def gather(table: pa.Table) -> pa.Table:
        to = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table.column("ids").to_pylist()])
        keys = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("keys").to_pylist()])
        order = np.argsort(to, kind="stable")
        to, keys = to[order], keys[order]
        edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]).tolist()
        return pa.table({"doc_id": to[edges[:-1]], "keys": pa.array([keys[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})

    return blocks.groupBy("part").applyInArrow(lean_group(gather), "doc_id long, keys binary")


def _found(docs: DataFrame, candidates: DataFrame, hot: bytes, key_bits: int, bits: int) -> DataFrame:
    """Blocks (part, rids, ids, firsts, ends): runs of strings of a row that also start in a smaller document, dealt by
    row. docs: rid, doc_id, text."""
    spark = docs.sparkSession
    hot_keys = spark.sparkContext.broadcast(hot)  # bounded: 2 ** 20 keys
    shift = np.uint64(32 - key_bits)
    schema = [("part", pa.int32()), ("text", pa.binary()), ("lens", pa.binary()), ("subs", pa.binary()), ("ids", pa.binary()), ("rids", pa.binary()), ("firsts", pa.binary()), ("known", pa.binary())]

    def flush(met: dict[bytes, list], known: list[tuple[int, int, int, int]], route: dict[bytes, int]):
        rows: dict[int, list] = {}
        for text, (doc, places) in met.items():
            row = rows.setdefault(route[text] >> (64 - bits), [[], [], [], [], [], [], None])
            for rid, first in places:
                for k, x in enumerate((text, len(text), route[text] >> (56 - bits) & 255, doc, rid, first)):
                    row[k].append(x)
        if known:
            array = np.array(known, dtype=np.int64)
            for p, x in scatter((mix(array[:, 0].astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64), 1 << bits, array):
                rows.setdefault(p, [[], [], [], [], [], [], None])[6] = x
        out = []
        for p, (texts, lens, subs, ids, rids, firsts, x) in rows.items():
            own = np.array(ids, dtype=np.int64)
            small = len(own) and own.min() >= 0 and own.max() < 1 << 32
            text = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            out.append((p, text, np.array(lens, dtype=np.int32).tobytes(), bytes(subs), own.astype(np.uint32 if small else np.int64).tobytes(), np.array(rids, dtype=np.int64).tobytes(), np.array(firsts, dtype=np.int32).tobytes(), x))
        if out:
            yield _rows(out, schema)

    def send(batches):
        frequent = np.frombuffer(hot_keys.value, dtype=np.uint64)
        met: dict[bytes, list] = {}
        route: dict[bytes, int] = {}
        known: list[tuple[int, int, int, int]] = []
        for b in batches:
            rids, ids = b.column(0).to_pylist(), _ids(b.column(1)).tolist()
            for i, texts in byte_blocks(b.column(2)):
                j = i + len(texts)
                buf, owner, first, end, key = pieces(texts)
                short = key >> shift
                wanted = [np.frombuffer(x, dtype=np.uint64) for x in b.column(3).slice(i, j - i).to_pylist()]
                tag = np.uint64(16)
                for base in range(0, j - i, 65536):  # documents are numbered within 16 bits
                    inside = (owner >= base) & (owner < base + 65536)
                    have = np.concatenate([w << tag | np.uint64(n) for n, w in enumerate(wanted[base : base + 65536])])
                    pick = np.flatnonzero(inside)
                    pick = pick[np.isin(short[pick] << tag | (owner[pick] - base).astype(np.uint64), have)]
                    o, f, e, k = owner[pick], first[pick], end[pick], key[pick]
                    if len(frequent) and len(pick):
                        split = np.isin(short[pick], frequent)
                        if split.any():
                            n = (e - f)[split]
                            at = np.repeat(f[split], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                            strings = mix(string_hashes(buf, LENGTH)[at])
                            o, f = np.concatenate([o[~split], np.repeat(o[split], n)]), np.concatenate([f[~split], at])
                            e, k = np.concatenate([e[~split], at + 1]), np.concatenate([k[~split], strings])
                    raw = buf.tobytes()
                    offsets = np.cumsum([0, *map(len, texts)]).tolist()
                    for own, a, z, kk in zip(o.tolist(), f.tolist(), e.tolist(), k.tolist(), strict=True):
                        text, doc, rid, at_ = raw[a : z + LENGTH - 1], ids[i + own], rids[i + own], a - offsets[own]
                        entry = met.get(text)
                        if entry is None:
                            met[text] = [doc, [(rid, at_)]]
                            route[text] = kk
                        elif entry[0] == doc:
                            entry[1].append((rid, at_))
                        elif entry[0] < doc:
                            known.append((rid, doc, at_, at_ + z - a))
                        else:
                            known += [(r, entry[0], p, p + z - a) for r, p in entry[1]]
                            entry[0], entry[1] = doc, [(rid, at_)]
                if len(met) > 200_000 or len(known) > 100_000:
                    yield from flush(met, known, route)
                    met, known, route = {}, [], {}
        yield from flush(met, known, route)

    def sort(table: pa.Table) -> pa.Table:
        blobs, subs, ids, rids, firsts, known = [], [], [], [], [], []
        for r in table.select([n for n, _ in schema[1:]]).to_pylist():
            lens = np.frombuffer(r["lens"], dtype=np.int32)
            text, at = pa.decompress(r["text"], decompressed_size=int(lens.sum()), codec="zstd", asbytes=True) if len(lens) else b"", 0
            for n in lens.tolist():
                blobs.append(text[at : at + n])
                at += n
            subs.append(np.frombuffer(r["subs"], dtype=np.uint8))
            ids.append(np.frombuffer(r["ids"], dtype=np.uint32 if len(r["ids"]) == 4 * len(lens) else np.int64).astype(np.int64))
            rids.append(np.frombuffer(r["rids"], dtype=np.int64))
            firsts.append(np.frombuffer(r["firsts"], dtype=np.int32).astype(np.int64))
            if r["known"]:
                known.append(np.frombuffer(r["known"], dtype=np.int64).reshape(-1, 4))
        if blobs:
            doc, rid, first, sub = np.concatenate(ids), np.concatenate(rids), np.concatenate(firsts), np.concatenate(subs)
            # The part is sorted in up to 256 shares by further bits of the key, so a suffix array stays small.
            shares = min(256, 1 << (sum(map(len, blobs)) // SHARE).bit_length())
            share = sub.astype(np.int64) // (256 // shares)
            for k in np.unique(share).tolist():
                own = np.flatnonzero(share == k)
                runs = repeated_in_shares([blobs[i] for i in own.tolist()], doc[own])
                at = own[runs[:, 0]]
                known.append(np.stack([rid[at], doc[at], first[at] + runs[:, 1], first[at] + runs[:, 2]], axis=1))
        found = np.concatenate(known) if known else np.zeros((0, 4), dtype=np.int64)
        blocks = scatter((mix(found[:, 0].astype(np.uint64)) >> np.uint64(64 - key_bits)).astype(np.int64), 1 << key_bits, found[:, 0], found[:, 1], found[:, 2].astype(np.int32), found[:, 3].astype(np.int32))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.table({n: pa.array([x[k] for x in blocks], t) for k, (n, t) in enumerate(zip(("part", "rids", "ids", "firsts", "ends"), kinds, strict=True))})

    named = docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    sent = named.join(_key_lists(candidates), "doc_id").select("rid", "doc_id", "text", "keys")
    sent = sent.mapInArrow(lean(send), "part int, text binary, lens binary, subs binary, ids binary, rids binary, firsts binary, known binary")
    return sent.groupBy("part").applyInArrow(lean_group(sort), "part int, rids binary, ids binary, firsts binary, ends binary")


def _run_lists(blocks: DataFrame) -> DataFrame:
    """(rid, id, runs): one row for each row of the input that has runs; runs are pairs of 32-bit numbers."""

    def gather(table: pa.Table) -> pa.Table:
        column = lambda n, t: np.concatenate([np.frombuffer(x.as_py(), dtype=t) for x in table.column(n)])
        rid, doc = column("rids", np.int64), column("ids", np.int64)
        runs = np.stack([column("firsts", np.int32), column("ends", np.int32)], axis=1)
        order = np.lexsort((runs[:, 0], doc, rid))
        rid, doc, runs = rid[order], doc[order], runs[order]
        edges = np.flatnonzero(np.r_[True, (rid[1:] != rid[:-1]) | (doc[1:] != doc[:-1]), True]).tolist()
        return pa.table({"rid": rid[edges[:-1]], "id": doc[edges[:-1]], "runs": pa.array([runs[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})

    return blocks.groupBy("part").applyInArrow(lean_group(gather), "rid long, id long, runs binary")


def cut(text: bytes, runs: list[list[int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs) once the strings starting in the runs are removed."""
    spans: list[list[int]] = []
    for a, b in sorted(runs):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b + LENGTH - 1)
        else:
            spans.append([a, b + LENGTH - 1])
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    left = b"".join(kept)
    return left, len(text) - len(left), len(spans)


def dedup_substrings(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) for every row of docs(doc_id, text).

    Null and empty texts have no bytes. A null id counts as larger than all others; rows with the same id never remove
    from each other. Repeated rows get the same result. An empty table gives no rows. Other columns aren't looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    size = text_bytes(docs)
    bits = max(3, min(16, (size // (10 << 20)).bit_length()))
    hot_above = max(HOT, size // 16 >> 20)
    answers = scratch.table(_candidates(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bits, hot_above), "answers")
    hot = b"".join(r["keys"] for r in answers.where("part < 0").select("keys").toLocalIterator())
    parts = max(3, min(20, (size // (4 << 20)).bit_length()))
    found = scratch.table(_found(rows, answers.where("part >= 0"), hot, bits, parts), "found")
    runs = _run_lists(found)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(batches):
        for b in batches:
            out = []
            for i, texts in byte_blocks(b.column(1)):
                for raw, spans in zip(texts, b.column(2).slice(i, len(texts)).to_pylist(), strict=True):
                    left, removed, n = cut(raw, np.frombuffer(spans or b"", dtype=np.int32).reshape(-1, 2).tolist())
                    out.append((len(raw), removed, n, hashlib.sha256(left).hexdigest(), left if with_text else None))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 4 + with_text])]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    scratch.drop("answers")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    joined = rows.withColumn("id", own).join(runs, ["rid", "id"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(lean(finish), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


shipped_by_value(__name__)
