"""Embedding whitening by matrix-free block subspace iteration: every pass over the vectors gives Xᵀ(XQ) of the centred
rows; QR and Rayleigh-Ritz go on until the residuals certify all components."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from quern.llm._common import Scratch, lean, shipped_by_value

#: Numbers in a block of vectors; columns of the iterated block beyond the components wanted.
NUMBERS, GUARD = 1 << 18, 16
#: Residuals, as shares of the largest eigenvalue: what certifies, and what is accepted once they fall no more.
CERTIFIED, FLOOR = 1e-13, 1e-11
#: When more passes than this are foreseen, the block is widened; more than LAST are an error.
PASSES, LAST = 8, 200
SHIFT, SCALE = 1_000_000, 64


@dataclass
class Fit:
    """n vectors with sums per dimension (of x less SHIFT); unit eigenvectors as columns, eigenvalues falling."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int = 0
    residual: float = 0.0
    identity_error: float = 0.0


def blocks_of(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(ids, x, dim): vectors in blocks of about NUMBERS entries, as 64-bit numbers floor(64 c). Null and empty vectors
    and those with null or non-finite entries are left out."""
    c = F.col(f"`{vector}`")
    good = F.coalesce((F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    rows = embeddings.where(good).select(F.col(f"`{key}`").alias("id"), c.cast("array<double>").alias("c"))
    schema = StructType([StructField("ids", ArrayType(rows.schema["id"].dataType)), StructField("x", rows.select(F.lit(b"")).schema[0].dataType), StructField("dim", IntegerType())])

    def run(batches):
        for batch in batches:
            dims = batch.column("c").value_lengths().to_numpy(zero_copy_only=False)
            i = 0
            while i < batch.num_rows:
                j = i + max(1, NUMBERS // int(dims[i]))
                other = np.flatnonzero(dims[i:j] != dims[i])
                j = min(batch.num_rows, j, *(i + other[:1]))
                part = batch.slice(i, j - i)
                scaled = np.floor(SCALE * part.column("c").flatten().to_numpy(zero_copy_only=False))
                if np.abs(scaled).max() >= 2.0**62:
                    raise ValueError("a vector's entry is too large for 64-bit numbers")
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_pylist()], pa.list_(batch.column("id").type)), pa.array([scaled.astype("<i8").tobytes()], pa.binary()), pa.array([int(dims[i])], pa.int32())], names=["ids", "x", "dim"])
                i = j

    return rows.mapInArrow(lean(run), schema)


def _matrices(batches):
    """(ids, matrix of 64-bit numbers) of each block."""
    for batch in batches:
        for ids, x, dim in zip(*(batch.column(c) for c in ("ids", "x", "dim")), strict=True):
            yield ids.values, np.frombuffer(x.as_buffer(), "<i8").reshape(-1, dim.as_py())


def _scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact; Python numbers where 64 bits could overflow."""
    if n * float(max(1, np.abs(x).max())) + float(max(map(abs, sums.tolist()))) < 2.0**62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _summed(blocks: DataFrame, cells, key: str = "i int, j int") -> DataFrame:
    """(i, j, v): for every cell the sum over all tasks of what cells(batches) gives as one matrix a task."""

    def run(batches):
        made = cells(batches)
        if made is not None:
            i, j = np.indices(made.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(made.ravel())], names=["i", "j", "v"])

    few = blocks.coalesce(4 * blocks.sparkSession.sparkContext.defaultParallelism)  # each task sends one matrix
    return few.mapInArrow(lean(run), f"{key}, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def _matrix(blocks: DataFrame, cells, rows: int, columns: int) -> np.ndarray:
    """The summed cells on the driver: as many numbers as the matrix has, whatever the number of vectors."""
    out = np.zeros((rows, columns))
    for i, j, v in _summed(blocks, cells).collect():
        out[i, j] = v
    return out


def _sums(blocks: DataFrame, dim: int) -> list[int]:
    """Exact sums of each dimension."""
    exact = DecimalType(38, 0)

    def run(batches):
        total = [0] * dim
        for _, x in _matrices(batches):
            own = x.sum(axis=0) if len(x) * float(np.abs(x).max()) < 2.0**62 else x.astype(object).sum(axis=0)
            total = [a + b for a, b in zip(total, own.tolist(), strict=True)]
        from decimal import Context

        whole = Context(prec=38)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([whole.create_decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    found = blocks.mapInArrow(lean(run), StructType([StructField("i", IntegerType()), StructField("s", exact)])).groupBy("i").agg(F.sum("s"))
    return [int(s) for _, s in sorted(found.collect())]  # a row a dimension


def times(blocks: DataFrame, q: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, float]:
    """Covariance times q, as Xᵀ(Xq) / n of the centred rows in one pass, and the covariance's trace."""
    dim, s = len(sums), np.asarray(sums, object)

    def cells(batches):
        total = None
        for _, x in _matrices(batches):
            c = _scaled(x, n, s).astype(float) / n
            part = np.vstack([c.T @ (c @ q), np.full((1, q.shape[1]), np.square(c).sum())])
            total = part if total is None else total + part
        return total

    out = _matrix(blocks, cells, dim + 1, q.shape[1]) / n
    return out[:dim], float(out[dim, 0])


def fit(blocks: DataFrame, k: int = 32, seed: int = 0) -> Fit | None:
    """The k leading components, or as many as have an eigenvalue above rounding; None without vectors.

    The iterated block starts with GUARD columns more than wanted. Its Ritz values tell how fast it converges; where
    that would take more than PASSES passes, it is widened to twice its size, at most to all dimensions. A component is
    certified by the norm of V u - e u.
    """
    n, dim, least = blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.max("dim"), F.min("dim")).first()
    if not n:
        return None
    if dim != least:
        raise ValueError(f"vectors of {least} and of {dim} entries")
    sums, rng = _sums(blocks, dim), np.random.default_rng(seed)
    k = min(k, dim)
    width = min(dim, k + GUARD)
    q = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    before = math.inf
    for done in range(1, LAST + 1):
        w, trace = times(blocks, q, n, sums)
        values, z = np.linalg.eigh((q.T @ w + w.T @ q) / 2)
        values, z = values[::-1], z[:, ::-1]
        u, vu = q @ z, w @ z
        top = max(values[0], 0.0)
        keep = int((values[:k] > dim * np.finfo(float).eps * top).sum()) if top > 0 else 0
        residual = float(np.linalg.norm(vu[:, :k] - u[:, :k] * values[:k], axis=0).max()) / top if top > 0 else 0.0
        if residual <= CERTIFIED or residual <= FLOOR and residual > before / 2:
            return Fit(n, sums, u[:, :keep], values[:keep], trace, done, residual)
        before, next_block = residual, vu
        ratio = min(max(values[-1], 0.0) / max(values[k - 1], 1e-300), 1 - 1e-12)
        if width < dim and math.log(residual / CERTIFIED) > -PASSES * math.log(max(ratio, 1e-300)):
            more = min(dim, 2 * width) - width
            next_block = np.hstack([vu / top, rng.standard_normal((dim, more)) / math.sqrt(dim)])
            width += more
        q = np.linalg.qr(next_block)[0]
    raise RuntimeError(f"no certificate after {LAST} passes: residual {residual:g}")


def _whitened(x: np.ndarray, model: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Rows on the components over the roots of their eigenvalues, and n x - S."""
    exact = _scaled(x, model.n, np.asarray(model.sums, object))
    return (exact.astype(float) / model.n) @ (model.vectors / np.sqrt(model.values)), exact


def identity_error(blocks: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, in one pass."""
    k = len(model.values)

    def cells(batches):
        total = None
        for _, x in _matrices(batches):
            y = _whitened(x, model)[0]
            part = np.vstack([y.T @ y, y.sum(axis=0)])
            total = part if total is None else total + part
        return total

    out = _matrix(blocks, cells, k + 1, k) / model.n
    return float(np.abs(out[:k] - np.outer(out[k], out[k]) - np.eye(k)).max())


def whiten(blocks: DataFrame, model: Fit, key: str = "vec_id") -> DataFrame:
    """(key, n, deviation, whitened): each vector's exact squared deviation and its place on all components."""
    schema = StructType([StructField(key, blocks.schema["ids"].dataType.elementType), StructField("n", LongType()), StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))])

    def run(batches):
        from decimal import Context

        whole = Context(prec=38)
        for ids, x in _matrices(batches):
            y, exact = _whitened(x, model)
            if exact.dtype != object and float(np.abs(exact).max()) ** 2 * x.shape[1] >= 2.0**62:
                exact = exact.astype(object)
            squares = (exact * exact).sum(axis=1).tolist()
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            yield pa.RecordBatch.from_arrays([ids, pa.array([model.n] * len(y), pa.int64()), pa.array([whole.create_decimal(s) for s in squares], pa.decimal128(38, 0)), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=[key, "n", "deviation", "whitened"])

    return blocks.mapInArrow(lean(run), schema)


def whitening_report(embeddings: DataFrame, components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Null and empty vectors and those with null or non-finite entries have no rows and no weight; null and repeated ids
    and equal vectors are rows like others; equal eigenvalues share a space of which some basis is taken; components
    without variance are left out, so that equal vectors alone give no row, as does an empty table. Vectors of unlike
    length are an error, and so is a deviation beyond 64 bits.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    blocks = scratch.table(blocks_of(embeddings), "blocks")
    model = fit(blocks, components)
    if model is None or not len(model.values):
        empty = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], StructType([StructField("vec_id", embeddings.schema["vec_id"].dataType), *StructType.fromDDL(empty)]))
    model.identity_error = identity_error(blocks, model)
    each = whiten(blocks, model).select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("component", "whitened"))
    share = F.element_at(F.array(*[F.lit(float(v / model.trace)) for v in model.values]), F.col("component") + 1)
    return each.select("vec_id", (F.col("component") + 1).alias("component"), "n", "deviation", "whitened", share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))


shipped_by_value(__name__)
