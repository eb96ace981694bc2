import math
import re
from collections import Counter

import numpy as np
import pytest

from quern.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k: int = 20):
    """All scores by the formula, without an index."""
    bags = [(d, Counter(terms_of(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked, scored = Counter(terms_of(text)), []
        for d, b, n in bags:
            m = 75 + (25 * n * n_docs) // total
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t, c in asked.items() if t in b)
            if score > 0:
                scored.append((score, d))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r, d, s) for r, (s, d) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def ranked(docs, items, **args):
    return sorted(map(tuple, ls.rank_documents(docs, items, **args).collect()), key=str)


@pytest.mark.parametrize("shard, ranges, first", [(4096, 32, 2), (64, 4, 1)])
def test_whole_tables(spark, monkeypatch, shard, ranges, first):
    monkeypatch.setattr(ls, "SHARD", shard)
    monkeypatch.setattr(ls, "RANGE", ranges)
    monkeypatch.setattr(ls, "FIRST", first)
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    assert ranked(docs, items) == brute(docs.select("doc_id", "text").collect(), items.collect())


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ls, "QUERY_BYTES", 2000)
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    assert ranked(docs, items.limit(12), k=3) == brute(docs.select("doc_id", "text").collect(), items.limit(12).collect(), 3)


def test_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ls, "SHARD", 8)
    monkeypatch.setattr(ls, "RANGE", 2)
    rows = [(k, "same words here") for k in range(40, 0, -1)] + [(7, "same words here"), (None, "same words here"), (50, None), (51, ""), (52, "!?"), (53, "Ärger ärger same"), (54, "other " * 20_000 + "words")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string")
    asked = [(1, "SAME words same"), (1, "here"), (2, None), (3, ""), (None, "ärger"), (5, "nowhere"), (6, "other words")]
    items = spark.createDataFrame([(i, t, 0) for i, t in asked], "item_id long, text string, rank int")
    assert ranked(docs, items) == brute(rows, asked)
    assert ranked(docs.limit(0), items) == [] and ranked(docs, items.limit(0)) == []


def test_long_texts_are_read_match_by_match(spark, monkeypatch):
    monkeypatch.setattr(ls, "LONG", 100)
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    assert ranked(docs, items.limit(5)) == brute(docs.select("doc_id", "text").collect(), items.limit(5).collect())


def test_only_ranges_that_can_matter_are_opened(monkeypatch):
    """The descent ends at the k-th score, but opens a range whose bound equals it."""
    monkeypatch.setattr(ls, "OPENED", 1)
    top = [90, 80, 90, 70]  # four ranges of 32 documents, one term
    share = np.repeat([50, 50, 50, 50], 32)
    share[[0, 32, 64, 96]] = top
    entries = {"of": ([0], "<i4"), "root": ([90], "<i4"), "down_root": ([0, 4], "<i4"), "ranges": (range(4), "<i2"), "top": (top, "<i4"), "down_top": ([0, 32, 64, 96, 128], "<i4"), "docs": (range(128), "<i2"), "share": (share, "<i4")}
    shard = ls.Shard({"ids": list(range(128, 0, -1))} | {k: np.asarray(v).astype(t).tobytes() for k, (v, t) in entries.items()})
    best = shard.best(np.asarray([0]), np.asarray([1], np.int64), 1, 1)
    assert best == [(90, 64)] and shard.ids[64] == 64 and shard.n_opened == 2
