"""Linear discriminant analysis and Gaussian naive Bayes from sums over the rows: all folds of a cross validation are
fitted from one aggregation and scored in one pass."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Added to variances, as a share of the largest one.
STEADY = 1e-9


@dataclass
class Moments:
    """Of each fold and class: rows, sums and sums of outer products; classes in order."""

    classes: list
    n: np.ndarray
    sums: np.ndarray
    products: np.ndarray


def _whole(rows: DataFrame, vector: str, label: str, fold: str) -> DataFrame:
    return rows.where(F.forall(vector, lambda x: x.isNotNull()) & F.col(label).isNotNull() & F.col(fold).isNotNull())


def moments(rows: DataFrame, vector: str, label: str, fold: str, folds: int) -> Moments:
    """One pass over the rows. A task sends a matrix for each fold and class it has; they are added up in Spark and come
    to the driver as folds * classes * dimensions^2 numbers, whatever the number of rows. Rows with a null are left out."""
    kept = _whole(rows, vector, label, fold).select(F.col(label).alias("label"), F.col(fold).cast("int").alias("fold"), F.col(vector).cast("array<double>").alias("v"))
    classes = [r["label"] for r in kept.select("label").distinct().orderBy("label").collect()]  # a row a class
    numbers = {c: i for i, c in enumerate(classes)}

    def summed(batches):
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)
            x = np.hstack([np.ones((len(x), 1)), x])
            which = np.stack([np.asarray(batch.column("fold")), [numbers[c] for c in batch.column("label").to_pylist()]], axis=1)
            for f, c in np.unique(which, axis=0).tolist():
                own = x[(which == (f, c)).all(axis=1)]
                found[f, c] = found.get((f, c), 0) + own.T @ own
        for (f, c), m in found.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), f, np.int32)), pa.array(np.full(len(i), c, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], names=["fold", "class", "i", "j", "s"])

    cells = kept.mapInArrow(summed, "fold int, class int, i int, j int, s double").groupBy("fold", "class", "i", "j").agg(F.sum("s").alias("s")).toArrow()
    f, c, i, j, s = (cells.column(k).to_numpy() for k in ("fold", "class", "i", "j", "s"))
    size = int(i.max(initial=0)) + 1
    m = np.zeros((folds, len(classes), size, size))
    m[f, c, i, j] = s
    m[f, c, j, i] = s
    return Moments(classes, m[:, :, 0, 0], m[:, :, 0, 1:], m[:, :, 1:, 1:])


def discriminant(m: Moments, without: int | None = None, shrink: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, constants) of the linear functions of the classes, fitted to all folds but one: means of the classes,
    one pooled covariance, shares of the classes. `shrink` moves the covariance towards its diagonal's mean."""
    n, sums, products = _left(m, without)
    means = sums / np.maximum(n, 1)[:, None]
    within = products.sum(axis=0) - sum(k * np.outer(x, x) for k, x in zip(n, means, strict=True))
    pooled = within / max(n.sum() - (n > 0).sum(), 1)
    pooled = (1 - shrink) * pooled + shrink * np.eye(len(pooled)) * np.trace(pooled) / len(pooled)
    pooled += np.eye(len(pooled)) * (STEADY * max(np.trace(pooled) / len(pooled), 1e-300))
    weights = np.linalg.solve(pooled, means.T).T
    with np.errstate(divide="ignore"):
        return weights, np.log(n / n.sum()) - 0.5 * (weights * means).sum(axis=1)


def gaussian(m: Moments, without: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, variances, logarithms of shares) of the classes, every dimension by itself."""
    n, sums, products = _left(m, without)
    means = sums / np.maximum(n, 1)[:, None]
    variances = np.einsum("cii->ci", products) / np.maximum(n, 1)[:, None] - means**2
    with np.errstate(divide="ignore"):
        return means, np.maximum(variances, 0) + STEADY * max(variances.max(initial=0), 1e-300), np.log(n / n.sum())


def _left(m: Moments, without: int | None):
    take = lambda x: x.sum(axis=0) - (x[without] if without is not None else 0)
    return take(m.n), take(m.sums), take(m.products)


def scores_of(x: np.ndarray, model: tuple) -> np.ndarray:
    """(rows, classes): how well each class suits each row, for either kind of model."""
    if len(model) == 2:
        return x @ model[0].T + model[1]
    means, variances, shares = model
    return np.stack([shares[c] - 0.5 * (np.log(2 * np.pi * variances[c]) + (x - means[c]) ** 2 / variances[c]).sum(axis=1) for c in range(len(means))], axis=1)


def cross_validated(rows: DataFrame, key: str, vector: str, label: str, fold: str, folds: int = 10) -> DataFrame:
    """(key, label, fold, model, predicted): every row's class by each model fitted to the other folds, `lda` and `gnb`;
    of equally good classes the first. fold holds numbers from 0 to folds - 1."""
    m = moments(rows, vector, label, fold, folds)
    models = {name: [fit(m, f) for f in range(folds)] for name, fit in (("lda", discriminant), ("gnb", gaussian))} if m.classes else {}
    kept = _whole(rows, vector, label, fold).select(key, F.col(label).alias("label"), F.col(fold).cast("int").alias("fold"), F.col(vector).cast("array<double>").alias("v"))
    kind = kept.schema["label"]
    schema = kept.select(key, "label", "fold", F.lit("").alias("model"), F.lit(None).cast(kind.dataType).alias("predicted")).schema

    def predict(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1), np.asarray(batch.column("fold"))
            for name, fitted in models.items():
                best = np.zeros(len(x), np.int64)
                for f in np.unique(own).tolist():
                    best[own == f] = scores_of(x[own == f], fitted[f]).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("label"), batch.column("fold"), pa.array([name] * len(x)), pa.array([m.classes[i] for i in best.tolist()], batch.column("label").type)], names=[key, "label", "fold", "model", "predicted"])

    return kept.mapInArrow(predict, schema)


def accuracies(predicted: DataFrame) -> DataFrame:
    """(model, folds, mean, sd): the mean over folds of the share of rows told right, and its standard deviation."""
    each = predicted.groupBy("model", "fold").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("a"))
    return each.groupBy("model").agg(F.count("*").alias("folds"), F.round(F.avg("a"), 6).alias("mean"), F.round(F.stddev_pop("a"), 6).alias("sd"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
