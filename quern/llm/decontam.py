"""Benchmark decontamination: windows of normalised benchmark words go into a broadcast hash set, the windows of every
training text are scanned against it, hits are verified word by word, and hit spans or documents are removed. Built
from DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import WORD_SEPARATORS, alnum_words, ascii_lower, fresh, Scratch

WINDOW = 10
#: Slots of the hash set for each window, and the most it may have in all (2 MB); each window takes two slots.
SLOTS, MOST_BITS = 32, 24
#: Bytes of windows, or of ids, up to which they are broadcast; beyond that the join is a shuffle.
BROADCAST_BYTES = 32 << 20
HITS = "array<struct<pos:int,len:int,item:string>>"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item, key, len): the windows of each item's words. key joins the words by blanks, which no word holds.
    item is item_id as text (null: empty). An item shorter than the window is one window; one without words has none."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), alnum_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("x"))
    return each.select("item", F.array_join("x", " ").alias("key"), F.size("x").alias("len")).distinct()


def _slots(h: Column, bits: int) -> tuple[Column, Column]:
    """The two slots of a hash."""
    mask = F.lit((1 << bits) - 1).cast("long")
    return h.bitwiseAND(mask).cast("int"), F.shiftright(h, 32).bitwiseAND(mask).cast("int")


def _hash_set(windows: DataFrame, bits: int) -> Column:
    """The hash set as a bit table: a literal list of 2 ** bits / 64 numbers. Bounded by bits."""
    hashed = windows.select(F.explode(F.array(*_slots(F.xxhash64(F.split("key", " ")), bits))).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot"))  # shifts go by the lowest six bits
    words = hashed.select(F.shiftright("slot", 6).alias("i"), bit.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    table = [0] * ((1 << bits) // 64)
    for r in words.toLocalIterator():
        table[r["i"]] = r["b"]
    return F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<bigint>")


def _scan(docs: DataFrame, windows: DataFrame, lens: list[int], bits: int, keys: tuple[str, ...]) -> DataFrame:
    """The key columns, n (number of words) and found array<struct<pos, len, key>>: the places whose hash is in the set."""
    table = _hash_set(windows, bits)
    bit = lambda s: F.call_function("shiftright", F.get(table, F.shiftright(s, 6)), s).bitwiseAND(F.lit(1)) == 1

    def candidates(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("w") - (size - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, size)))

        def at(h: Column, i: Column) -> Column:
            first, second = _slots(h, bits)
            return F.when(bit(first) & bit(second), i + 1)

        keyed = F.transform(F.array_compact(F.transform(hashes, at)), lambda i: F.struct(i.alias("pos"), F.lit(size).alias("len"), F.array_join(F.slice("w", i, size), " ").alias("key")))
        return F.when(F.size("w") >= size, keyed).otherwise(F.array().cast("array<struct<pos:int,len:int,key:string>>"))

    words = docs.select(*keys, alnum_words(F.col("text")).alias("w"))
    return words.select(*keys, F.size("w").cast("long").alias("n"), F.concat(*[candidates(x) for x in lens]).alias("found"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th (hash of the text), n (number of words) and hits array<struct<pos, len, item>> for every row of
    docs(doc_id, text), in any order: every occurrence (pos from 1) of a benchmark window in the whole text.

    Only places whose hash is in the broadcast set are joined with the windows, and the join compares the words
    themselves, so a hash that two windows share can't produce a hit. A null text has no words; rows equal in id and
    text have the same hits; null ids are ids like others; without benchmark words nothing is hit.
    """
    scratch = Scratch(docs.sparkSession)
    windows = scratch.table(benchmark_windows(benchmark, window), "windows")
    stats = windows.agg(F.count("*").alias("n"), F.collect_set("len").alias("lens"), F.sum(F.octet_length("key") + F.octet_length("item") + 64).alias("bytes")).first()  # at most `window` lengths
    lens, n = sorted(stats["lens"]), stats["n"]
    keys = ("doc_id", "th")
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    if not n:
        return docs.select(*keys, F.size(alnum_words(F.col("text"))).cast("long").alias("n"), F.array().cast(HITS).alias("hits"))
    bits = min(MOST_BITS, max(10, (SLOTS * n).bit_length()))
    scanned = scratch.table(_scan(docs, windows, lens, bits, keys), "scan")
    places = scanned.where(F.size("found") > 0).select(*keys, F.explode("found").alias("x")).select(*keys, F.col("x.pos").alias("pos"), F.col("x.len").alias("len"), F.col("x.key").alias("key"))
    side = windows.select("key", "item")
    joined = places.join(F.broadcast(side) if stats["bytes"] <= BROADCAST_BYTES else side, "key")
    hits = joined.groupBy(*keys).agg(F.collect_set(F.struct("pos", "len", "item")).alias("hits"))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "hits")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
    return scanned.join(hits, same, "left").select(*keys, "n", F.coalesce("hits", F.array().cast(HITS)).alias("hits"))


def covered(hits: Column) -> Column:
    """Words inside any hit: the length of the union of the intervals [pos, pos + len)."""
    spans = F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.struct(h["pos"].alias("pos"), h["len"].alias("len")))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    total = F.aggregate(
        spans,
        zero,
        lambda a, h: F.struct(
            F.greatest(a["end"], h["pos"] + h["len"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), h["pos"] + h["len"] - F.greatest(a["end"], h["pos"]))).alias("n"),
        ),
    )
    return total["n"].cast("long")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs; repeated rows are judged one
    by one, a null or empty text has no words, a row with a null id is judged like others. An empty docs gives no rows, an
    empty benchmark no hits."""
    hits = find_hits(docs.select("doc_id", "text"), benchmark, window)
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"])))
    return (
        hits.withColumn("items", items)
        .withColumn("n_hit", covered(F.col("hits")))
        .select(
            "doc_id",
            F.col("n").alias("n_words"),
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, max_share: float = 0.0) -> DataFrame:
    """The rows of docs without contamination, with all their columns, whatever these are called.

    mode "documents": drops those with more than max_share of their words hit. mode "spans": keeps every document and
    cuts each run of hit words, with the separators after its words, out of the text. Null and empty texts stay as they
    are, rows with null ids and repeated rows are treated like others.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    id_, th, marks = fresh(docs, 3)
    hits = find_hits(docs.select("doc_id", "text"), benchmark, window).where(F.size("hits") > 0)
    if mode == "documents":
        hits = hits.where(covered(F.col("hits")) > F.lit(max_share) * F.col("n"))
        extra = []
    elif mode == "spans":
        marked = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1))))
        extra = [marked.alias(marks)]
    else:
        raise ValueError(f"unknown mode {mode}")
    bad = hits.select(F.col("doc_id").alias(id_), F.col("th").alias(th), *extra).dropDuplicates([id_, th])
    bad = Scratch(docs.sparkSession).table(bad, "bad")
    size = bad.count() * 64 if not extra else bad.select(F.coalesce(F.sum(F.size(marks) * 4 + 64), F.lit(0))).first()[0]
    bad = F.broadcast(bad) if size <= BROADCAST_BYTES else bad
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(th))
    if mode == "documents":
        return docs.join(bad, same, "left_anti").select(*names)
    text = F.col("text")
    # Words of the original text with what separates them: A-Z are no separators here, since they get lower-cased.
    own = WORD_SEPARATORS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    pieces = F.regexp_extract_all(text, F.lit("[^" + own[1:-2] + "]+" + own[:-1] + "*"), F.lit(0))
    lead = F.regexp_extract(text, "^" + own[:-1] + "*", 0)
    cut = F.concat(lead, F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains(F.col(marks), i + 1)), ""))
    kept_text = F.when(F.col(marks).isNotNull(), cut).otherwise(text)
    return docs.join(bad, same, "left").select(*[kept_text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


__all__ = ["ascii_lower", "benchmark_windows", "contamination_report", "covered", "decontaminate", "find_hits"]
