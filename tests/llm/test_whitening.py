import math
from collections import defaultdict

import numpy as np
import pytest

from quern.llm import whitening as wh


def exact(rows, k=32):
    """Ids, numbers, covariance's eigenvectors and -values by a full decomposition."""
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.asarray([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(axis=0)
    scaled = n * x - s
    c = scaled.astype(float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in kept], scaled, c, values[::-1][:k], vectors[:, ::-1][:, :k], float(values.sum())


def check(report, rows, k=32, tolerance=1e-6):
    ids, scaled, c, values, vectors, trace = exact(rows, k)
    deviation = {i: int((r * r).sum()) for i, r in zip(ids, scaled, strict=True)}
    projected = {i: y for i, y in zip(ids, c @ vectors / np.sqrt(values), strict=True)}
    got = defaultdict(dict)
    errors = set()
    for r in report.collect():
        assert (r["n"], r["deviation"]) == (len(ids), deviation[r["vec_id"]])
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9)
        got[r["component"]][r["vec_id"]] = r["whitened"]
        errors.add(r["identity_error"])
    assert sorted(got) == list(range(1, len(values) + 1)) and len(errors) == 1 and errors.pop() < 1e-9
    for component, column in got.items():
        theirs = np.asarray([projected[i][component - 1] for i in ids])
        own = np.asarray([column[i] for i in ids])
        assert min(np.abs(own - theirs).max(), np.abs(own + theirs).max()) < tolerance


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(wh.whitening_report(table), [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_iteration_without_the_whole_space(spark):
    """300 dimensions with falling variances: the block never spans them, several passes are needed."""
    rng = np.random.default_rng(3)
    scale = 50 * 0.8 ** np.arange(300)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((400, 300)) * scale + 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = wh.fit(wh.blocks_of(table), 8)
    assert model.vectors.shape == (300, 8) and 1 < model.passes <= 12 and model.residual <= wh.FLOOR
    check(wh.whitening_report(table, 8), rows, 8)


def test_flat_spectrum_widens_the_block(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((300, 90)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert wh.fit(wh.blocks_of(table), 4).passes <= 6
    check(wh.whitening_report(table, 4), [(r["vec_id"], r["embedding"]) for r in table.collect()], 4)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 0.5]), (2, None), (3, [float("nan"), 1.0, 1.0]), (4, [None, 1.0, 2.0]), (5, []), (6, [float("-inf"), 0.0, 0.0]), (7, [-4.0, 0.015, 1.0]), (8, [1.0, 2.0, 0.5]), (9, [3.0, -1.0, 2.0]), (10, [0.2, 7.0, -3.0])]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, component int, N string")
    check(wh.whitening_report(table), rows, 3)
    nameless = wh.whitening_report(table.selectExpr("cast(null as long) as vec_id", "embedding"))
    assert nameless.count() == 15 and nameless.where("vec_id is not null").count() == 0
    assert wh.whitening_report(table.limit(0)).count() == 0
    assert wh.whitening_report(table.where("vec_id in (1, 8)")).count() == 0  # no variance
    assert wh.whitening_report(spark.createDataFrame([(1, [1.0, 1.0]), (2, [3.0, 3.0])], "vec_id long, embedding array<double>")).count() == 2
    with pytest.raises(ValueError):
        wh.whitening_report(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_numbers_beyond_64_bits_stay_exact(spark):
    rows = [(k, [float(2**50 + 2**20 * k), float(k % 3)]) for k in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    blocks = wh.blocks_of(table)
    model = wh.fit(blocks, 2)
    ids, scaled, *_ = exact(rows)
    squares = {i: int((r * r).sum()) for i, r in zip(ids, scaled, strict=True)}
    assert {r["vec_id"]: int(r["deviation"]) for r in wh.whiten(blocks, model).collect()} == squares
