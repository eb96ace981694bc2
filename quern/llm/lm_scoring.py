"""Scoring with an interpolated modified Kneser-Ney n-gram model that Spark counts.

N-grams are counted by an exchange on a word that they share with the n-grams below them, so that a task settles two
orders; those around very frequent words are dealt by context or one by one instead, and their contexts' sums are put
together afterwards. The counts of lower orders are continuation counts (in how many different n-grams one order up does
this stand). Each task writes its n-grams as sorted arrays of hashes to the shared folder, and workers memory-map these
files to score texts, so the model may be larger than any memory. Probabilities are put together when a text is scored:

    p(w | context) = max(c - D(c), 0) / total(context) + gamma(context) * p(w | shorter context)

with the three discounts of each order estimated from its counts of counts, down to a uniform share for unknown words.
"""

from __future__ import annotations

import json
import math
import mmap
import os
import sys
import uuid
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import byte_blocks, crc_mod, lean, lean_group, mix, Scratch, shipped_by_value, text_bytes, WordHashes

A = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of the marks before a text and after it; the latter is a token.
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x5BD1E995E6546B64)
#: Contexts of frequent words there may be on a level, and the documents frequent words are taken from; they only say
#: how n-grams are dealt. The code of a word that isn't among the COMMON ones.
FREQUENT, SAMPLE_DOCS, COMMON, RARE = 1 << 20, 4_000, 65_535, 65_535
#: Files that a worker keeps mapped at once. Maps hold no descriptors where the language allows that.
MAPS = 16_384 if sys.version_info >= (3, 13) else 512


def token_stream(texts: list[bytes], hashes: WordHashes, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner): each text's tokens after order - 1 marks of its beginning, with its end. Marks have owner -1."""
    pad, tail = np.full(order - 1, BEGIN), np.array([END])
    parts, owners = [], []
    for i, t in enumerate(texts):
        words = hashes.of(t.lower().split())
        parts += [pad, words, tail]
        owners += [np.full(order - 1, -1, dtype=np.int32), np.full(len(words) + 1, i, dtype=np.int32)]
    return np.concatenate(parts), np.concatenate(owners)


def context_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of the tokens of a context; one token is its own hash."""
    h = columns[0]
    for c in columns[1:]:
        h = mix(h * A + c)
    return h


@dataclass
class Places:
    """Of each n-gram: its key, its context's hash, whether it is dealt alone, whether its home word decides, the hash
    whose first bits are its part, and the table of that part it is kept in."""

    key: np.ndarray
    context: np.ndarray
    alone: np.ndarray
    settled: np.ndarray
    lead: np.ndarray
    part: np.ndarray
    table: np.ndarray


@dataclass
class Deal:
    """Where n-grams go, in `1 << bits` parts.

    Levels go in pairs from the top down, as long as the upper one has three words or more. An n-gram of the upper level
    is dealt by its second word, its home, one of the lower by its first. So an n-gram, the n-gram without its first
    word and the contexts of both are in one part, which settles two levels at once. Where the home word is a frequent
    one, and on levels without a partner, the context decides instead, or the n-gram itself if its whole context is made
    of frequent words; then the lower level is settled in a round of its own, in tables of their own.
    """

    order: int
    bits: int
    ranked: bytes
    frequent: int

    def __post_init__(self):
        self.words = np.frombuffer(self.ranked, dtype=np.uint64)
        self.code = np.argsort(self.words).astype(np.uint16)
        self.sorted = self.words[self.code]
        self.most = {k: min(self.frequent, int(FREQUENT ** (1 / k) + 1e-9)) for k in range(1, self.order)}
        # Single words are few next to n-grams, so fewer parts hold them.
        self.word_bits = (2 * self.bits + 2) // 3

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Ranks of the usual words, RARE for others."""
        if not len(self.sorted):
            return np.full(len(words), RARE, dtype=np.uint16)
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.code[at], np.uint16(RARE))

    def upper(self, level: int) -> bool:
        return level >= 3 and (self.order - level) % 2 == 0

    def lower(self, level: int) -> bool:
        return level >= 2 and (self.order - level) % 2 == 1

    def place(self, columns: list[np.ndarray], codes: list[np.ndarray]) -> Places:
        """Places of n-grams by their words' hashes and codes."""
        level, n = len(columns), len(columns[0])
        no = np.zeros(n, dtype=bool)
        if level == 1:
            part = (columns[0] >> np.uint64(64 - self.word_bits)).astype(np.int64)
            return Places(columns[0], columns[0], no, no, columns[0], part, part)
        context = context_hash(columns[:-1])
        key = mix(context * A + columns[-1])
        alone = codes[0] < self.most[level - 1]
        for c in codes[1:-1]:
            alone &= c < self.most[level - 1]
        settled, lead = no, context
        if self.upper(level) or self.lower(level):
            home = 1 if self.upper(level) else 0
            settled = codes[home] >= self.most[1]
            lead = np.where(settled, columns[home], context)
        if alone.any():
            lead = np.where(alone, mix(key + A), lead)
        part = (lead >> np.uint64(64 - self.bits)).astype(np.int64)
        return Places(key, context, alone, settled, lead, part, part + (~settled << self.bits) if self.lower(level) else part)


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams that occur once to four times; 0.5, 1, 1.5 where those are missing."""
    if min(n[:4]) <= 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) for k in (1, 2, 3)]


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, dtype=np.int64)


def _summed(key: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rows with equal keys become one, in the order of the keys; values are added up."""
    if not len(key):
        return key, columns, values
    order = np.argsort(key)
    key = key[order]
    at = _runs(key)
    return key[at], [c[order[at]] for c in columns], [np.add.reduceat(v[order], at) for v in values]


def _packed(values: np.ndarray) -> bytes:
    """One byte a value, or four where some value needs it (then the length tells)."""
    return values.astype(np.uint8 if not len(values) or values.max() < 256 else np.uint32).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8 if len(data) == n else np.uint32).astype(np.int64)


def _blocks(deal: Deal, columns: list[np.ndarray], codes: list[np.ndarray], counts: np.ndarray, raw: np.ndarray) -> list[tuple]:
    """Rows (level, kinds, part, size, high, low, words, counts, raw) of n-grams, dealt to their parts. Usual words travel
    as their ranks, in compressed planes of high and low bytes; others as their hashes."""
    p = deal.place(columns, codes)
    fine = codes[0].astype(np.uint64) << np.uint64(16) | codes[-1].astype(np.uint64)
    order = np.argsort(p.lead >> np.uint64(32) << np.uint64(32) | fine)
    part = p.part[order]
    planes = [c[order].view(np.uint8).reshape(-1, 2) for c in codes]
    columns, rare, counts, raw = [c[order] for c in columns], [c[order] == RARE for c in codes], counts[order], raw[order]
    edges = np.r_[_runs(part), len(part)].tolist()
    squeeze = pa.Codec("zstd", compression_level=1).compress
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        high, low = (squeeze(b"".join(x[a:b, k].tobytes() for x in planes), asbytes=True) for k in (1, 0))
        words = b"".join(x[a:b][r[a:b]].tobytes() for x, r in zip(columns, rare, strict=True))
        c, r = _packed(counts[a:b]), _packed(raw[a:b])
        out.append((len(columns), None, int(part[a]), b - a, high, low, words, c, None if c == r else r))
    return out


BLOCK = "level int, kinds array<long>, part int, size long, high binary, low binary, words binary, counts binary, raw binary"


def _arrow(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int64(), *[pa.binary()] * 5)
    names = ("level", "kinds", "part", "size", "high", "low", "words", "counts", "raw")
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})


def _read_blocks(rows: list[dict], level: int, deal: Deal) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns of hashes, columns of codes, counts, occurrences."""
    columns, all_codes, counts, raw = [[] for _ in range(level)], [[] for _ in range(level)], [], []
    expand = pa.Codec("zstd").decompress
    for r in rows:
        n, at = r["size"], 0
        high, low = (np.frombuffer(expand(r[x], level * n), np.uint8).reshape(level, n) for x in ("high", "low"))
        for k in range(level):
            codes = high[k].astype(np.uint16) << np.uint16(8) | low[k]
            rare = codes == RARE
            m = int(rare.sum())
            words = deal.words[np.minimum(codes, len(deal.words) - 1)] if len(deal.words) else np.zeros(n, dtype=np.uint64)
            words[rare] = np.frombuffer(r["words"][at : at + 8 * m], np.uint64)
            at += 8 * m
            columns[k].append(words)
            all_codes[k].append(codes)
        counts.append(_unpacked(r["counts"], n))
        raw.append(counts[-1] if r["raw"] is None else _unpacked(r["raw"], n))
    return [np.concatenate(c) for c in columns], [np.concatenate(c) for c in all_codes], np.concatenate(counts), np.concatenate(raw)


def _buckets(name: str, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted keys as offsets by their first bits, some eight keys each, and the 32 bits that follow."""
    k = max(0, len(keys).bit_length() - 3)
    edges = np.arange(1, 1 << k, dtype=np.uint64) << np.uint64(64 - k) if k else np.zeros(0, dtype=np.uint64)
    rest = (keys >> np.uint64(32 - k)).astype(np.uint32)
    return {f"{name}_offsets": np.r_[0, np.searchsorted(keys, edges), len(keys)].astype(np.uint32), f"{name}_rest": rest}


def _found(table: dict[str, np.ndarray], name: str, keys: np.ndarray) -> np.ndarray:
    """Indices of keys among the table's, -1 for unknown ones: bisection within the bucket of each."""
    offsets, rest = table[f"{name}_offsets"], table[f"{name}_rest"]
    k = (len(offsets) - 1).bit_length() - 1
    bucket = (keys >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(keys), dtype=np.int64)
    mine = (keys >> np.uint64(32 - k)).astype(np.uint32)
    low, end = offsets[bucket].astype(np.int64), offsets[bucket + 1].astype(np.int64)
    if not len(rest):
        return np.full(len(keys), -1)
    high = end
    for _ in range(int((end - low).max(initial=0)).bit_length()):
        mid = (low + high) >> 1
        less = (rest[np.minimum(mid, len(rest) - 1)] < mine) & (low < high)
        low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
    good = (low < end) & (rest[np.minimum(low, len(rest) - 1)] == mine)
    return np.where(good, low, -1)


def _coded(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of numbers as one byte each: the place in a list of the 255 most usual rows, or 255 and the row elsewhere."""
    small = (values < 65536).all(axis=1)
    packed = np.zeros(len(values), dtype=np.uint64)
    for k in range(values.shape[1]):
        packed |= values[:, k].astype(np.uint64) << np.uint64(16 * k)
    kinds, inverse, n = np.unique(packed[small], return_inverse=True, return_counts=True)
    top = np.argsort(-n, kind="stable")[:255]
    code = np.full(len(kinds), 255, dtype=np.uint8)
    code[top] = np.arange(len(top))
    codes = np.full(len(values), 255, dtype=np.uint8)
    codes[small] = code[inverse]
    at = np.flatnonzero(codes == 255)
    usual = np.stack([(kinds[top] >> np.uint64(16 * k)) & np.uint64(65535) for k in range(values.shape[1])], axis=1).astype(np.int64)
    over = values[at]
    over = over.astype(np.uint32) if over.max(initial=0) < 1 << 32 else over
    return {f"{name}_codes": codes, f"{name}_usual": usual, f"{name}_at": at.astype(np.uint32), f"{name}_over": over}


def _values(table: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """The rows at some places."""
    codes, usual = table[f"{name}_codes"][at], table[f"{name}_usual"]
    out = usual[np.minimum(codes, max(len(usual) - 1, 0))] if len(usual) else np.zeros((len(at), usual.shape[1]), dtype=np.int64)
    rare = codes == 255
    if rare.any():
        out[rare] = table[f"{name}_over"][np.searchsorted(table[f"{name}_at"], at[rare])]
    return out


def _remote(root: str):
    """(file system, path) of a folder that the operating system doesn't see, by pyarrow; None for one it does."""
    if "://" not in root or root.startswith("file://"):
        return None
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(root)


def _local(root: str) -> str:
    return root.removeprefix("file://").removeprefix("file:")


def _save(root: str, level: int, part: int | str, arrays: dict[str, np.ndarray]) -> None:
    """The arrays in one file, after a line of JSON that lists them. It is written under another name first and then
    renamed, so that a repeated task does no harm."""
    remote = _remote(root)
    fs, base = remote or (None, _local(root))
    folder = f"{base}/level{level}"
    temporary, final = f"{folder}/.{part}-{uuid.uuid4().hex}", f"{folder}/{part}"
    fs.create_dir(folder, recursive=True) if fs else os.makedirs(folder, exist_ok=True)
    listed, at = [], 0
    for name, x in arrays.items():
        listed.append((name, x.dtype.str, x.shape, at))
        at += -(-x.nbytes // 64) * 64
    head = json.dumps(listed).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    with fs.open_output_stream(temporary) if fs else open(temporary, "wb") as out:
        out.write(head)
        for x in arrays.values():
            out.write(x.tobytes() + bytes(-x.nbytes % 64))
    fs.move(temporary, final) if fs else os.replace(temporary, final)


def _load(root: str, level: int, part: int | str) -> dict[str, np.ndarray] | None:
    """The saved arrays, memory-mapped where the operating system sees the folder, else read; None if there are none."""
    remote = _remote(root)
    if remote is None:
        path = f"{_local(root)}/level{level}/{part}"
        if not os.path.exists(path):
            return None
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
    else:
        fs, base = remote
        path = f"{base}/level{level}/{part}"
        if not fs.get_file_info(path).is_file:
            return None
        with fs.open_input_stream(path) as f:
            data = f.read()
    start = data.find(b"\n") + 1
    out = {}
    for name, kind, shape, at in json.loads(data[:start]):
        n = math.prod(shape)
        out[name] = np.frombuffer(data, kind, n, start + at).reshape(shape) if n else np.zeros(shape, kind)
    return out


@dataclass
class Model:
    """Where the arrays are, and the numbers that go with them: per level its discounts; of the lowest level the
    continuations in all, those of 1, 2 and 3 or more; tokens in all and distinct ones; frequent words by rank."""

    root: str
    order: int
    bits: int
    discounts: list[list[float]]
    total: int
    kinds: list[int]
    tokens: int
    vocabulary: int
    frequent: bytes


class Reader:
    """Memory-mapped arrays of a model, the MAPS last used files."""

    def __init__(self, model: Model):
        self.m, self.open = model, OrderedDict()
        self.deal = Deal(model.order, model.bits, model.frequent, len(model.frequent) // 8)

    def arrays(self, level: int, part: int | str) -> dict[str, np.ndarray] | None:
        key = level, part
        if key not in self.open:
            if len(self.open) >= MAPS:
                self.open.popitem(last=False)
            self.open[key] = _load(self.m.root, level, part)
        self.open.move_to_end(key)
        return self.open[key]

    def words(self, keys: np.ndarray) -> np.ndarray:
        """Continuations and occurrences of sorted distinct words; 0 where one is unknown."""
        out = np.zeros((len(keys), 2))
        part = (keys >> np.uint64(64 - self.deal.word_bits)).astype(np.int64)
        edges = np.r_[_runs(part), len(part)].tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            table = self.arrays(1, int(part[a]))
            if table is None or not len(table["keys"]):
                continue
            at = np.minimum(np.searchsorted(table["keys"], keys[a:b]), len(table["keys"]) - 1)
            good = table["keys"][at] == keys[a:b]
            out[a:b][good] = _values(table, "counts", at[good])
        return out

    def grams(self, columns: list[np.ndarray], codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of n-grams, and the sums of their contexts (in all, of 1, 2 and more); 0 where they are unknown."""
        level, n = len(columns), len(columns[0])
        p = self.deal.place(columns, codes)
        counts, stats = np.zeros(n), np.zeros((n, 4))
        order = np.argsort(p.table.astype(np.uint16 if self.m.bits < 16 else np.uint32), kind="stable")
        table_of, keys, contexts, alone = p.table[order], p.key[order], mix(p.context + A)[order], p.alone[order]
        edges = np.r_[_runs(table_of), n].tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            of, table = order[a:b], self.arrays(level, int(table_of[a]))
            if table is None:
                continue
            at = _found(table, "contexts", contexts[a:b])
            at[alone[a:b]] = -1
            seen = np.flatnonzero(at >= 0)
            stats[of[seen]] = _values(table, "stats", at[seen])
            seen = np.flatnonzero((at >= 0) | alone[a:b])  # nothing is known after an unknown context
            at = _found(table, "keys", keys[a:b][seen])
            counts[of[seen[at >= 0]]] = _values(table, "counts", at[at >= 0])[:, 0]
        alone = np.flatnonzero(p.alone)
        table = self.arrays(level, "frequent") if len(alone) else None
        if table is not None and len(table["contexts"]):
            at = np.minimum(np.searchsorted(table["contexts"], p.context[alone]), len(table["contexts"]) - 1)
            good = table["contexts"][at] == p.context[alone]
            stats[alone[good]] = table["stats"][at[good]]
        return counts, stats


def discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)], 0.0)


def score_texts(texts: list[bytes], reader: Reader, hashes: WordHashes) -> list[tuple[int, int, float, float]]:
    """n_tokens, n_known, base_score, score of each text."""
    m = reader.m
    stream, owner = token_stream(texts, hashes, m.order)
    real = np.flatnonzero(owner >= 0)
    words, inverse = np.unique(stream[real], return_inverse=True)
    found = reader.words(words)
    raw = found[:, 1][inverse]
    weights = sum(d * n for d, n in zip(m.discounts[0], m.kinds, strict=True))
    total = max(m.total, 1)
    p = (discounted(found[:, 0], m.discounts[0]) / total + (weights / total if m.total else 1.0) / (m.vocabulary + 1))[inverse]
    codes = reader.deal.codes(stream)
    for level in range(2, m.order + 1):
        counts, stats = reader.grams(*[[x[real - k] for k in range(level - 1, -1, -1)] for x in (stream, codes)])
        d, seen = m.discounts[level - 1], np.maximum(stats[:, 0], 1)
        gamma = np.where(stats[:, 0] > 0, (d[0] * stats[:, 1] + d[1] * stats[:, 2] + d[2] * stats[:, 3]) / seen, 1.0)
        p = np.where(stats[:, 0] > 0, discounted(counts, d) / seen, 0.0) + gamma * p
    base = np.log10((raw + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1)))
    n = len(texts)
    of = owner[real]
    sums = [np.bincount(of, minlength=n), np.bincount(of, weights=raw > 0, minlength=n), np.bincount(of, weights=base, minlength=n), np.bincount(of, weights=np.log10(p), minlength=n)]
    return [(int(a), int(b), float(c), float(d)) for a, b, c, d in zip(*sums, strict=True)]


def train(texts: DataFrame, order: int = 3, part_grams: int = 1_000_000, task_tokens: int = 2_000_000) -> Model:
    """Counts the n-grams of texts(text); a null text is an empty one. No n-gram is pruned.

    A task sums up task_tokens tokens before it sends their n-grams, which are dealt as Deal says. Words that would take
    up an eighth of a part and more, by a sample of about SAMPLE_DOCS texts, are the frequent ones; the COMMON most
    usual of the sample travel as short codes. The sample changes no count.
    """
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = texts.sparkSession
    scratch = Scratch(spark)
    root = scratch.path("model")
    bits = max(3, min(28, (text_bytes(texts) // 5 // part_grams).bit_length()))  # 28: 10^15 bytes
    usual, frequent = _usual_words(texts, 1 / (8 << bits))
    deal = Deal(order, bits, usual.tobytes(), frequent)

    def send(batches):
        hashes, parts, n = WordHashes(), [], 0

        def flush():
            both = [np.concatenate([p[k] for p in parts]) for k in range(2 * order)]
            key = mix(context_hash(both[: order - 1]) * A + both[order - 1])
            _, both, (counts,) = _summed(key, both, [np.ones(len(key), dtype=np.int64)])
            return _arrow(_blocks(deal, both[:order], both[order:], counts, counts)).to_batches()

        for b in batches:
            for _, block in byte_blocks(b.column(0)):
                stream, owner = token_stream(block, hashes, order)
                real = np.flatnonzero(owner >= 0)
                parts.append([x[real - k] for x in (stream, deal.codes(stream)) for k in range(order - 1, -1, -1)])
                n += len(real)
                if n >= task_tokens:
                    yield from flush()
                    parts, n = [], 0
        if parts:
            yield from flush()

    sent = texts.select("text").mapInArrow(lean(send), BLOCK)
    numbers = {level: [0] * 8 for level in range(1, order + 1)}
    tables: dict[int, DataFrame] = {}
    for level in range(order, 0, -1):
        if level < order:
            sent = tables[level + 1].where((F.col("level") == level) & F.col("kinds").isNull())
        if level + 2 in tables:
            sent = sent.union(tables[level + 2].where((F.col("level") == level) & F.col("kinds").isNull()))
        # No name for what is written, so that its exchange's files can go.
        tables[level] = done = scratch.table(sent.groupBy("part").applyInArrow(lean_group(_merger(root, level, deal)), BLOCK), f"level{level}")
        sums = [F.sum(F.get("kinds", F.lit(k))).alias(f"k{k}") for k in range(8)]
        for r in done.where("kinds is not null").groupBy("level").agg(*sums).collect():  # two rows at most
            numbers[r["level"]] = [a + b for a, b in zip(numbers[r["level"]], r[1:], strict=True)]
        if level > 1:
            _save_frequent(root, level, done.where(f"kinds is not null and words is not null and level = {level}").select("words", "counts"))
        if level + 2 in tables:
            scratch.drop(f"level{level + 2}")
    scratch.drop("level1")
    scratch.drop("level2")
    low = numbers[1]
    return Model(root, order, bits, [discounts(numbers[k][:4]) for k in range(1, order + 1)], low[5], [low[0], low[1], low[4]], low[6], low[7], usual[:frequent].tobytes())


def _usual_words(texts: DataFrame, share: float) -> tuple[np.ndarray, int]:
    """Of a bounded sample: hashes of its COMMON most usual words and marks, by rank; how many of them take up more than
    the share of its tokens."""

    def count(batches):
        hashes = WordHashes()
        for b in batches:
            for _, block in byte_blocks(b.column(0)):
                stream, _ = token_stream(block, hashes, 2)
                words, n = np.unique(stream, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    sample = texts.select("text").sample(min(1.0, SAMPLE_DOCS / max(1, texts.count())), seed=17).mapInArrow(lean(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # the sample is bounded
    top = sample.withColumn("total", total).orderBy(F.desc("n"), "word").limit(COMMON).collect()
    hashes = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    return hashes, sum(r["n"] > share * r["total"] for r in top)


def _save_frequent(root: str, level: int, partial: DataFrame) -> None:
    """Adds up what the parts say of contexts of frequent words, in Spark; there are at most FREQUENT contexts, which one
    task writes."""

    def spread(batches):
        keys, sums = np.empty(0, np.uint64), np.zeros((0, 4), np.int64)
        for b in batches:  # a task tells each context once
            rows = list(zip(b.column(0), b.column(1), strict=True))
            every = np.concatenate([keys, *(np.frombuffer(w.as_buffer(), dtype=np.uint64) for w, _ in rows)])
            counts = np.concatenate([sums, *(np.frombuffer(c.as_buffer(), dtype=np.int64).reshape(-1, 4) for _, c in rows)])
            keys, at = np.unique(every, return_inverse=True)
            sums = np.zeros((len(keys), 4), np.int64)
            np.add.at(sums, at, counts)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(np.ascontiguousarray(x)) for x in sums.T)], names=["context", "c0", "c1", "c2", "c3"])

    def save(batches):
        found = [[np.asarray(c) for c in b.columns] for b in batches]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 5
        keys = columns[0].view(np.uint64)
        order = np.argsort(keys)
        _save(root, level, "frequent", {"contexts": keys[order], "stats": np.stack([c[order] for c in columns[1:]], axis=1)})
        yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64())], names=["n"])

    sums = partial.mapInArrow(lean(spread), "context long, c0 long, c1 long, c2 long, c3 long").groupBy("context").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(4)])
    if not sums.coalesce(1).mapInArrow(lean(save), "n long").collect():  # no task without a partition
        list(save([]))


def _merger(root: str, level: int, deal: Deal):
    """Sums up a part's n-grams, saves them, and hands on the n-grams below that it can't settle itself."""

    def keep(columns: list[np.ndarray], codes: list[np.ndarray], key: np.ndarray, counts: np.ndarray, raw: np.ndarray) -> tuple:
        """Saves n-grams in the order of their keys; the row that tells what is to be added up over all parts."""
        size = len(columns)
        kinds = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts >= 3).sum()), int(counts.sum()), int(raw.sum()), len(counts)]
        p = deal.place(columns, codes)
        if size == 1:
            _save(root, 1, int(p.table[0]), {"keys": key} | _coded("counts", np.stack([counts, raw], axis=1)))
            return (1, kinds, *[None] * 7)
        owner, stats = _context_stats(mix(p.context + A)[~p.alone], counts[~p.alone])
        partial, sums = _context_stats(p.context[p.alone], counts[p.alone])
        _save(root, size, int(p.table[0]), _buckets("keys", key) | _buckets("contexts", owner) | _coded("counts", counts[:, None]) | _coded("stats", stats))
        return size, kinds, None, None, None, None, partial.tobytes() if len(partial) else None, sums.tobytes(), None

    def summed(columns: list[np.ndarray], codes: list[np.ndarray], counts: np.ndarray, raw: np.ndarray):
        """key, columns, codes, counts, occurrences of distinct n-grams, in the order of their keys."""
        n = len(columns)
        key = mix(context_hash(columns[:-1]) * A + columns[-1]) if n > 1 else columns[0]
        key, both, (counts, raw) = _summed(key, columns + codes, [counts, raw])
        return key, both[:n], both[n:], counts, raw

    def down(columns: list[np.ndarray], codes: list[np.ndarray], raw: np.ndarray):
        """The n-grams one word shorter, each counted once for every n-gram it stands in."""
        return summed(columns[1:], codes[1:], np.ones(len(raw), dtype=np.int64), raw)

    def merge(table: pa.Table) -> pa.Table:
        key, columns, codes, counts, raw = summed(*_read_blocks(table.to_pylist(), level, deal))
        out = [keep(columns, codes, key, counts, raw)]
        if level == 1:
            return _arrow(out)
        own = codes[1] >= deal.most[1] if deal.upper(level) else np.zeros(len(key), dtype=bool)
        if own.any():
            below = down([c[own] for c in columns], [c[own] for c in codes], raw[own])
            out.append(keep(below[1], below[2], below[0], *below[3:]))
            out += _blocks(deal, *down(below[1], below[2], below[4])[1:])
        if not own.all():
            out += _blocks(deal, *down([c[~own] for c in columns], [c[~own] for c in codes], raw[~own])[1:])
        return _arrow(out)

    return merge


def _context_stats(context: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted contexts, and of each the sum of its counts and how many are 1, 2 and more."""
    if not len(context):
        return context, np.zeros((0, 4), dtype=np.int64)
    order = np.argsort(context)
    c, n = context[order], counts[order]
    at = _runs(c)
    return c[at], np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (n, n == 1, n == 2, n > 2)], axis=1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of docs."""
    fields = dict(model.__dict__)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        m = Model(**fields)
        reader, hashes = Reader(m), WordHashes()
        for b in batches:
            out = []
            for _, block in byte_blocks(b.column(2), 3 << 20):
                out += score_texts(block, reader, hashes)
            n = pa.array([x[0] for x in out], pa.int64())
            perplexity = pa.array([10 ** min(-x[3] / x[0], 300) for x in out], pa.float64())
            columns = [b.column(0), b.column(1), n, pa.array([x[1] for x in out], pa.int64()), pa.array([m.tokens] * len(out), pa.int64()), pa.array([x[2] for x in out], pa.float64()), pa.array([x[3] for x in out], pa.float64()), perplexity]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    marked = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "text")
    return marked.mapInArrow(lean(rows), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score_report(docs: DataFrame, order: int = 3) -> DataFrame:
    """Trains on the documents whose crc32(doc_id) mod 5 isn't 1 and scores all of them. A null id is never held out;
    null and empty texts are one end token; repeated rows count as often as they stand there. Without training documents
    every token is unknown; an empty table gives no rows."""
    return score(docs, train(docs.where(crc_mod(F.col("doc_id"), 5) != 1), order))


shipped_by_value(__name__)
