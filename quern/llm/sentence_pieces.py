"""SentencePiece encoding and decoding for merge-type vocabularies: adjacent symbols merge in the order of a score-ordered
agenda, in Arrow batches; results can be compared with the sentencepiece library in the same way."""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from array import array
from dataclasses import dataclass, field
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import byte_blocks, lean, shipped_by_value

#: The mark that stands for a space.
SPACE = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The model type of merge vocabularies in a model file.
MERGES = 2
#: Segments up to so many characters are remembered and have a list for an agenda; twice so many are remembered at most.
SHORT, REMEMBERED = 32, 1 << 18
#: The rank of what is no piece.
NEVER = 1 << 62


def _fields(data: bytes):
    """(number, value) of the fields of a message in a model file; fixed-size values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        n = varint() if kind == 2 else 4 if kind == 5 else 8
        yield number, data[at : at + n]
        at += n


@dataclass
class Vocabulary:
    """Pieces by id, with what a merge needs: rank orders texts of pieces by score, equal scores alike."""

    texts: list[str]
    kinds: list[int]
    scores: list[float]
    dummy_prefix: bool
    unknown: str
    ids: dict[str, int] = field(default_factory=dict)
    rank: dict[str, int] = field(default_factory=dict)
    byte_ids: list[int] = field(default_factory=list)
    pairs: set[str] = field(default_factory=set)

    def __post_init__(self):
        normal = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        order = {s: r for r, s in enumerate(sorted({self.scores[i] for i in normal}, reverse=True))}
        self.ids = {self.texts[i]: i for i in normal}
        self.rank = {self.texts[i]: order[self.scores[i]] for i in normal}
        self.byte_ids = [0] * 256
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.byte_ids[int(self.texts[i][3:5], 16)] = i
        self.pairs = {a + b for i in normal for a, b in pairwise(self.texts[i])}


def load(path: str) -> Vocabulary:
    """Reads a model file. Supported are merge vocabularies with byte fallback and without normalisation, user-defined
    symbols or unused pieces; others raise ValueError, since they would be encoded wrongly."""
    texts, kinds, scores, trainer, normalizer = [], [], [], {}, {}
    for number, value in _fields(Path(path).read_bytes()):
        if number == 1:
            piece = dict(_fields(value))
            texts.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    if trainer.get(3, 1) != MERGES or not trainer.get(35, 0) or trainer.get(24, 0):
        raise ValueError("not a merge vocabulary with byte fallback and marks before words")
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or {USER, UNUSED} & set(kinds):
        raise ValueError("normalisation, user-defined symbols and unused pieces are not supported")
    if kinds.count(BYTE) != 256:
        raise ValueError("256 byte pieces are needed")
    return Vocabulary(texts, kinds, scores, bool(normalizer.get(3, 1)), trainer.get(44, b" \xe2\x81\x87 ").decode())


def merge(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """Merges neighbours until no two of them make a piece: always the pair of highest score, of those the leftmost.

    The agenda is a heap of (rank, place, right neighbour, merged text); entries whose symbols have changed since are
    passed over when they come up. n symbols make at most 3n entries.
    """
    n = len(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    agenda = [(r, i, i + 1, t) for i in range(n - 1) if (r := rank.get(t := symbols[i] + symbols[i + 1])) is not None]
    heapq.heapify(agenda)
    while agenda:
        _, i, j, text = heapq.heappop(agenda)
        if right[i] != j or len(symbols[i]) + len(symbols[j]) != len(text) or not symbols[i]:
            continue
        symbols[i], symbols[j] = text, ""
        k = right[i] = right[j]
        if k >= 0:
            left[k] = i
            if (r := rank.get(t := text + symbols[k])) is not None:
                heapq.heappush(agenda, (r, i, k, t))
        if (h := left[i]) >= 0 and (r := rank.get(t := symbols[h] + text)) is not None:
            heapq.heappush(agenda, (r, h, i, t))
    return [s for s in symbols if s]


def merge_few(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """The same for few symbols, with the pairs' ranks in a list: its first least entry is what the heap would give."""
    get = rank.get
    agenda = [get(a + b, NEVER) for a, b in pairwise(symbols)]
    while agenda and (best := min(agenda)) != NEVER:
        i = agenda.index(best)
        text = symbols[i] = symbols[i] + symbols.pop(i + 1)
        agenda.pop(i)
        if i:
            agenda[i - 1] = get(symbols[i - 1] + text, NEVER)
        if i < len(agenda):
            agenda[i] = get(text + symbols[i + 1], NEVER)
    return symbols


class Encoder(dict):
    """Segment -> its ids as 32-bit numbers. Merges never cross two characters that stand side by side in
    no piece; texts are cut there, and short segments are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.older = vocabulary, {}
        whole = any(a != SPACE and b == SPACE for a, b in vocabulary.pairs)
        self.segments = (lambda t: [t]) if whole else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def __missing__(self, segment: str) -> bytes:
        v = self.v
        if (out := self.older.get(segment)) is not None:
            self[segment] = out
            return out
        if len(segment) <= SHORT:
            symbols = merge_few(list(segment), v.rank)
        else:
            cuts = [0, *(i for i, (a, b) in enumerate(pairwise(segment), 1) if a + b not in v.pairs), len(segment)]
            symbols = chain.from_iterable((merge_few if b - a <= SHORT else merge)(list(segment[a:b]), v.rank) for a, b in pairwise(cuts))
        ids = array("i")
        for symbol in symbols:
            if (known := v.ids.get(symbol)) is not None:
                ids.append(known)
            else:
                ids.extend(v.byte_ids[x] for x in symbol.encode())
        out = ids.tobytes()
        if len(segment) <= SHORT:
            if len(self) >= REMEMBERED:  # what was met since the last time stays
                self.older = dict(self)
                self.clear()
            self[segment] = out
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        marked = text.replace(" ", SPACE)
        return b"".join(map(self.__getitem__, self.segments(SPACE + marked if self.v.dummy_prefix else marked)))


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    """Every byte that belongs to no character becomes a replacement character."""
    return "�", error.start + 1


class Decoder:
    """Ids -> text: marks become spaces, the dummy prefix goes, byte pieces are joined to characters."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        codecs.register_error("quern-bytes", _one_by_one)
        spaced = {NORMAL: lambda t: t.replace(SPACE, " ").encode(), UNKNOWN: lambda t: v.unknown.encode(), BYTE: lambda t: bytes([int(t[3:5], 16)])}
        self.bytes = [spaced.get(k, lambda t: b"")(t) for t, k in zip(v.texts, v.kinds, strict=True)]
        self.silent = {i for i, k in enumerate(v.kinds) if k == CONTROL}

    def decode(self, ids: list[int]) -> str:
        parts = [self.bytes[i] for i in ids]
        if self.v.dummy_prefix:
            for k, i in enumerate(ids):
                if i not in self.silent:
                    if self.v.kinds[i] == NORMAL and parts[k][:1] == b" ":
                        parts[k] = parts[k][1:]
                    break
        if self.silent.isdisjoint(ids):
            return b"".join(parts).decode("utf-8", "quern-bytes")
        cuts = [0, *(k for k, i in enumerate(ids) if i in self.silent), len(ids)]  # bytes on both sides make no character
        return "".join(b"".join(parts[a:b]).decode("utf-8", "quern-bytes") for a, b in pairwise(cuts))


def _with_column(df: DataFrame, name: str, kind: str, start) -> DataFrame:
    """df with a column; start(), called once a task, gives a function from a batch to (first row, array) for runs of its
    rows. A column of that name is replaced."""
    others = [c for c in df.columns if c.lower() != name.lower()]
    schema = df.select(*[F.col(f"`{c}`") for c in others], F.lit(None).cast(kind).alias(name)).schema

    def run(batches):
        rows = start()
        for batch in batches:
            for i, made in rows(batch):
                part = batch.slice(i, len(made))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), made], names=[*others, name])

    return df.mapInArrow(lean(run), schema)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of every whole text, without begin and end ids. Null and empty texts have none; repeated rows
    are encoded alike; an empty table stays empty; a column named like `out` is replaced, all others stay."""

    def start():
        encoder = Encoder(vocabulary)

        def rows(batch):
            for i, texts in byte_blocks(batch.column(text)):
                made = [encoder.encode(t.decode()) for t in texts]
                ends = np.cumsum([0, *(len(x) // 4 for x in made)], dtype=np.int32)
                ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(made))])
                yield i, pa.ListArray.from_arrays(pa.array(ends), ids)

        return rows

    return _with_column(docs, out, "array<int>", start)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the text of its ids. Null and empty lists give an empty text; control ids are silent; bytes that make
    no character become U+FFFD each; an id that the vocabulary hasn't got is an error."""

    def start():
        decoder = Decoder(vocabulary)

        def rows(batch, most: int = 1 << 18):
            column, i = batch.column(ids), 0
            ends = np.r_[0, np.cumsum(np.asarray(column.value_lengths().fill_null(0)))]
            while i < len(column):  # runs of about `most` ids
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
                own = np.asarray(column.slice(i, j - i).flatten()).tolist()
                yield i, pa.array([decoder.decode(own[a:b]) for a, b in pairwise((ends[i : j + 1] - ends[i]).tolist())], pa.string())
                i = j

        return rows

    return _with_column(encoded, out, "string", start)


def library_differences(encoded: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """(n_rows, n_ids, n_texts): rows, and those whose ids or decoded texts differ from the sentencepiece library's, which
    runs over the same Arrow batches. A null text counts as empty."""
    model = Path(path).read_bytes()

    def rows(batches):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_proto=model)
        for batch in batches:
            for i, texts in byte_blocks(batch.column(text)):
                own, decoded = batch.column(ids).slice(i, len(texts)).to_pylist(), batch.column(out).slice(i, len(texts)).to_pylist()
                theirs = library.encode([t.decode() for t in texts], num_threads=1)
                counts = len(texts), sum(x != y for x, y in zip(own, theirs, strict=True)), sum(x != y for x, y in zip(decoded, library.decode(theirs, num_threads=1), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in counts], names=["n_rows", "n_ids", "n_texts"])

    return encoded.select(text, ids, out).mapInArrow(lean(rows), "n_rows long, n_ids long, n_texts long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rows", "n_ids", "n_texts")])


def piece_report(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, from the encoded ids and from the text that they
    decode to. Null and empty texts have no token and digests of nothing; null and repeated ids are rows like others;
    there are no ties to settle; an empty table gives no row."""
    vocabulary = load(path)
    done = decode(encode(docs.select("doc_id", "text"), vocabulary).drop("text"), vocabulary)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


shipped_by_value(__name__)
