import glob
import math
import random
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.operators import query_language as ql
from quern.operators.text_index import TextIndex

WORDS = "river house garden window winter summer morning letter riverside houses".split()


def some_docs(n, seed):
    rnd = random.Random(seed)
    rows = [(seed * 1000 + k, " ".join(rnd.choices(WORDS, weights=range(1, 11), k=rnd.randint(1, 40)))) for k in range(n)]
    return [*rows, (seed * 1000 + n, None)]


ROWS = [some_docs(60, 1), some_docs(40, 2), some_docs(20, 3)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    frames = [spark.createDataFrame(r, "id long, body string") for r in ROWS]
    fields = {"text": F.col("body"), "first": F.substring_index("body", " ", 1)}
    out = TextIndex(spark, path, 1 << 10).build(frames[0], "id", fields, title=F.col("body"))
    return out.append(frames[1], "id", fields).append(frames[2], "id", fields)


def brute(node, docs):
    """doc -> score, straight from the grammar's meaning."""
    n = len(docs)
    if node.kind == "group":
        wanted = [(k, brute(c, docs)) for k, c in node.clauses if k != ql.NOT]
        hits = defaultdict(float)
        for _, found in wanted:
            for d, s in found.items():
                hits[d] += s
        must = [f for k, f in wanted if k == ql.MUST]
        gone = {d for k, c in node.clauses if k == ql.NOT for d in brute(c, docs)}
        return {d: s * node.boost for d, s in hits.items() if d not in gone and all(d in f for f in must)}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    tf = {}
    for d, t in docs.items():
        w = (t or "").split()
        w = w if node.field == "text" else w[:1]
        if node.kind == "word":
            c = w.count(node.words[0])
        elif node.kind == "prefix":
            c = sum(x.startswith(node.words[0]) for x in w)
        elif node.kind == "fuzzy":
            c = sum(edits(x, node.words[0]) <= node.near for x in w)
        else:
            shifted = [[p - i for p, x in enumerate(w) if x == word] for i, word in enumerate(node.words)]
            c = sum(all(any(v <= q <= v + node.near for q in s) for s in shifted) for v in {v for s in shifted for v in s})
        if c:
            tf[d] = c
    return {d: c * math.log(n / len(tf)) * node.boost for d, c in tf.items()}


LINES = ["river", "river house", "+river -house garden", "river AND (house OR garden)", "(river^2 winter)^3 NOT summer", '"river house"', '"river house"~3', '"house river garden"~5 winter', "hous*", "rivers~1", "gardne~", "first:river", "first:(river house) AND text:letter", "+(river garden) +(house -winter)", "nowhere", "-river", '"river river"', "NOT (river OR house) window"]


@pytest.mark.parametrize("line", LINES)
def test_queries(index, line):
    docs = {d: t for rows in ROWS for d, t in rows}
    expected = brute(ql.parse(line), docs)
    found = {r["doc"]: r["score"] for r in ql.search(index, line).collect()}
    assert found.keys() == expected.keys() and all(found[d] == pytest.approx(s, abs=1e-5) for d, s in expected.items())


@pytest.mark.parametrize("line", ["river", "river house letter", "nowhere"])
@pytest.mark.parametrize("k", [1, 5, 500])
def test_best_hits(index, line, k):
    docs = {d: t for rows in ROWS for d, t in rows}
    expected = sorted(((-round(s, 6), d) for d, s in brute(ql.parse(line), docs).items()))[:k]
    assert sorted((-r["score"], r["doc"]) for r in ql.search(index, line, k=k).collect()) == [(pytest.approx(s, abs=1e-5), d) for s, d in expected]


def test_grammar():
    assert ql.parse("a OR b AND -c", conjunctive=True).clauses[1][0] == ql.MUST
    node = ql.parse('title:"a b"~2^1.5 x~').clauses
    assert node[0][1] == ql.Node("phrase", "title", ("a", "b"), 2, 1.5) and node[1][1] == ql.Node("fuzzy", "text", ("x",), 2)
    for bad in ("(a", "a)", "a ^", "~", '"a'):
        with pytest.raises(ValueError):
            ql.parse(bad) if bad != "a ^" else ql.parse("^")


def test_segments_and_versions(spark, tmp_path):
    frames = [spark.createDataFrame(r, "id long, body string") for r in ROWS]
    fields = {"text": F.col("body")}
    index = TextIndex(spark, str(tmp_path / "i")).build(frames[0], "id", fields, shingles=(2, 3)).append(frames[1], "id", fields, shingles=(2, 3))
    before = [sorted(map(tuple, ql.search(index, line).collect())) for line in LINES if "first" not in line]
    assert len(index.segments()) == 2 and index.n_docs() == 102
    former = index.snapshot()
    index.merge()
    assert len(former.segments()) == 2 and ql.search(former, "river").count() == ql.search(index, "river").count()
    assert len(index.segments()) == 1 and index.n_docs() == 102 and index.versions().select("version").distinct().count() == 3
    after = [sorted(map(tuple, ql.search(index, line).collect())) for line in LINES if "first" not in line]
    assert [[d for d, _ in x] for x in before] == [[d for d, _ in x] for x in after]
    assert index.blocks().agg(F.max(F.size("docs"))).first()[0] <= 128
    with pytest.raises(Exception):
        index._commit(3, [("x", 0)])  # the version is there already


def test_a_query_reads_few_row_groups(spark, tmp_path):
    """Of many terms and of a long list of postings only what a query needs is read."""
    docs = spark.range(40_000).select("id", F.concat(F.repeat(F.lit("common "), F.when(F.col("id") % 4997 == 0, 40).otherwise(1)), F.lit("word"), F.col("id") % 3000).alias("body"))
    index = TextIndex(spark, str(tmp_path / "i"), 1 << 10).build(docs, "id", {"text": F.col("body")})
    index.append(spark.createDataFrame([(9000, "other")], "id long, body string"), "id", {"text": F.col("body")})
    groups = []
    for f in glob.glob(str(tmp_path / "i" / "segments" / "*" / "postings" / "*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.row_group(g).num_columns)}
            groups.append((stats["term"].min, stats["term"].max, stats["best"].max))
    least = index.needed({"common": 1.0}, "text", 5)
    read = [g for g in groups if g[0] <= "common" <= g[1] and g[2] >= least["common"]]
    assert len(groups) > 10 and len(read) <= len(groups) / 4
    assert [r["doc"] for r in index.top(["common"], "text", 5).orderBy("rank").collect()] == [0, 4997, 9994, 14991, 19988]


def test_blocks_are_cut_out_of_batches_as_columns():
    import random
    import tracemalloc

    import pyarrow as pa

    from quern.operators import text_index

    rnd = random.Random(2)
    rows = [("f" if t < 40 else "g", f"t{t}", d if d % 50 else None, 900 - d, [d, d + 1][: 1 + d % 2]) for t in range(80) for d in range(rnd.choice((1, 5, 127, 128, 129, 256, 700)))]
    names = ["field", "term", "doc", "tf", "positions"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    of = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)
    for size in (1, 37, 128, 5000, len(rows)):
        blocks = [r for b in text_index._block_batches(pa.int64())([of(rows[i : i + size]) for i in range(0, len(rows), size)]) for r in b.to_pylist()]
        assert [(b["field"], b["term"], *x) for b in blocks for x in zip(b["docs"], b["tfs"], b["positions"], strict=True)] == rows
        assert all(len(b["docs"]) == text_index.BLOCK for b, c in zip(blocks, blocks[1:], strict=False) if (b["field"], b["term"]) == (c["field"], c["term"]))
        assert all((b["best"], b["least"]) == (b["tfs"][0], b["tfs"][-1]) for b in blocks)
    large = [of(rows)] * 20
    tracemalloc.start()
    assert sum(b.num_rows for b in text_index._block_batches(pa.int64())(large)) >= 20
    assert tracemalloc.get_traced_memory()[1] < 50 * len(rows)
    tracemalloc.stop()
    assert list(text_index._block_batches(pa.int64())([])) == []
