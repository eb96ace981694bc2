"""Search for the best settings of a model: settings are tried over folds on a share of the rows, the better ones again on
more of them, until few are left that have seen all rows."""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares of rows are told in steps of one in so many.
STEPS = 1 << 20


def random_settings(space: dict[str, list], n: int, seed: int) -> list[dict]:
    """n different settings, or all there are, each with one of the values of every name."""
    total = 1
    for values in space.values():
        total *= len(values)
    rnd, found = random.Random(seed), {}
    while len(found) < min(n, total):
        setting = {k: rnd.choice(v) for k, v in space.items()}
        found[json.dumps(setting, sort_keys=True)] = setting
    return list(found.values())


def accuracy(predicted: DataFrame, label: str) -> float:
    return predicted.agg(F.avg((F.col(label) == F.col("prediction")).cast("double"))).first()[0] or 0.0


def halving_search(
    rows: DataFrame, key: str, label: str, fold: str, settings: list[dict], make: Callable[[dict], object], rungs: int = 3, keep: float = 0.5, seed: int = 0, parallel: int = 4, measure: Callable[[DataFrame, str], float] = accuracy
) -> DataFrame:
    """(rung, share, setting, mean, sd, rank, kept): a row for each setting tried on each rung.

    make(setting) gives an estimator of pyspark.ml. On every rung each setting left is fitted to all folds but one and
    measured on that one, for each fold; the fits run side by side, each over the whole cluster. The rows fitted are a
    share keep^(rungs - 1 - rung) of all, by a seeded hash of their key, so that each rung's are among the next one's;
    measured are all rows of a fold. The best `keep` of the settings go on, equal ones in the order given. Rows of a
    null fold are left out.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col(fold).isNotNull()).cache()
    folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]  # a row a fold
    left, out = list(range(len(settings))), []
    try:
        for rung in range(rungs):
            share = keep ** (rungs - 1 - rung)
            some = rows.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(STEPS)) < int(share * STEPS))

            def tried(job: tuple[int, object], some=some) -> float:
                model = make(settings[job[0]]).fit(some.where(F.col(fold) != job[1]))
                return measure(model.transform(rows.where(F.col(fold) == job[1])), label)

            jobs = [(i, f) for i in left for f in folds]
            with ThreadPool(parallel) as pool:
                scores = pool.map(inheritable_thread_target(spark)(tried), jobs, 1)
            each = {i: [s for (j, _), s in zip(jobs, scores, strict=True) if j == i] for i in left}
            mean = {i: sum(s) / max(len(s), 1) for i, s in each.items()}
            order = sorted(left, key=lambda i: (-mean[i], i))
            stay = set(order[: max(1, round(len(order) * keep))])
            for rank, i in enumerate(order, 1):
                sd = (sum((s - mean[i]) ** 2 for s in each[i]) / max(len(each[i]), 1)) ** 0.5
                out.append((rung, share, json.dumps(settings[i], sort_keys=True), round(mean[i], 6), round(sd, 6), rank, i in stay))
            left = [i for i in left if i in stay]
    finally:
        rows.unpersist()
    return spark.createDataFrame(out, "rung int, share double, setting string, mean double, sd double, rank int, kept boolean")
