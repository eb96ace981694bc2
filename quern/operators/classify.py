"""Classification: pipelines on pyspark.ml, evaluation as aggregates, and data preparation for sequence models."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_pipeline(kind: str = "nb", features: int = 1 << 16, ngram: int = 1, min_df: int = 1):
    """A pipeline (label STRING, text STRING) -> prediction: words, n-grams, TF-IDF and a classifier of the kind nb, lr,
    svm, sgd, tree or gbt."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
    from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, StringIndexer

    kinds = {
        "nb": lambda: NaiveBayes(),
        "lr": lambda: LogisticRegression(maxIter=50),
        "sgd": lambda: LogisticRegression(maxIter=10, regParam=0.01, elasticNetParam=0.5),
        "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=20)),
        "tree": lambda: DecisionTreeClassifier(),
        "gbt": lambda: GBTClassifier(maxIter=10),
    }
    stages = [
        StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep"),
        RegexTokenizer(inputCol="text", outputCol="w", pattern=r"[^\p{L}\p{N}_]+"),
        NGram(n=ngram, inputCol="w", outputCol="g"),
        HashingTF(inputCol="g", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features", minDocFreq=min_df),
    ]
    model = kinds[kind]().setLabelCol("label_index").setFeaturesCol("features")
    return Pipeline(stages=[*stages, model])


def tabular_pipeline(columns: list[str], symbolic: list[str], kind: str = "forest", best: int | None = None):
    """A pipeline over numeric and symbolic columns with an optional choice of the best features by an F test."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, UnivariateFeatureSelector, VectorAssembler

    coded = [StringIndexer(inputCol=c, outputCol=f"{c}_code", handleInvalid="keep") for c in symbolic]
    inputs = [c for c in columns if c not in symbolic] + [f"{c}_code" for c in symbolic]
    stages = [StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc"), *coded, VectorAssembler(inputCols=inputs, outputCol="all", handleInvalid="keep")]
    features, width = "all", len(inputs)
    if best is not None:
        stages.append(UnivariateFeatureSelector(featuresCol="all", labelCol="label_index", outputCol="best", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(best))
        features, width = "best", min(best, width)
    kinds = {
        "forest": lambda: RandomForestClassifier(numTrees=50, seed=7),
        "cart": lambda: DecisionTreeClassifier(seed=7),
        "lr": lambda: LogisticRegression(maxIter=100),
        "gnb": lambda: NaiveBayes(modelType="gaussian"),
        "svm": lambda: OneVsRest(classifier=LinearSVC()),
        "mlp": lambda: MultilayerPerceptronClassifier(layers=[width, 16, 3], seed=7),
    }
    return Pipeline(stages=[*stages, kinds[kind]().setLabelCol("label_index").setFeaturesCol(features)])


def stratified_fold(df: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """df with fold: within each label the rows are dealt round robin in the order of the hashed key (MD5), so folds have
    the labels' shares. Ranks are taken inside ranges of the hash, then over ranges, so a frequent label is no hot key."""
    h = F.md5(F.col(key).cast("string").cast("binary"))
    rows = df.withColumn("__h", h).withColumn("__r", F.substring(h, 1, 3))
    counts = rows.groupBy(label, "__r").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(label).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 4,096 ranges a label
    offsets = counts.select(F.col(label).alias("__l"), F.col("__r").alias("__q"), before.alias("__b"))
    at = F.row_number().over(Window.partitionBy(label, "__r").orderBy("__h", key)) - 1
    joined = rows.join(offsets, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__r") == F.col("__q")))
    return joined.withColumn("fold", F.pmod(F.col("__b") + at, F.lit(k)).cast("int")).drop("__h", "__r", "__l", "__q", "__b")


def cross_validated(pipeline, grid: list[dict] | None = None, folds: int = 10, metric: str = "accuracy", parallelism: int = 4):
    """A cross validator over a grid of parameters for rows with a `fold` column (0 .. folds - 1), as stratified_fold
    and tabular.fold_of make it."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    evaluator = MulticlassClassificationEvaluator(labelCol="label_index", metricName=metric)
    return CrossValidator(estimator=pipeline, estimatorParamMaps=grid or [{}], evaluator=evaluator, numFolds=folds, foldCol="fold", parallelism=parallelism, seed=7)


def nearest_neighbours(test: DataFrame, train: DataFrame, key: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """(key, label): majority label of the k nearest training rows by Euclidean distance, ties to the smaller label.
    test is a stated set that meets every training row, in blocks."""
    from quern.operators.similarity import nearest_by_distance

    near = nearest_by_distance(train, test, key, vector, k).join(train.select(key, label), key)
    votes = near.groupBy("query", label).agg(F.count("*").alias("n"))
    return votes.groupBy(F.col("query").alias(key)).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) from the confusion counts."""
    c = confusion(df, actual, predicted)
    rows = c.select(F.col(actual).alias("label"), F.col("n").alias("support"), F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("pred"))
    columns = c.select(F.col(predicted), F.lit(0), F.lit(0), F.col("n"))
    s = rows.union(columns).groupBy("label").agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("pred").alias("pred"))
    p, r = F.col("tp") / F.col("pred"), F.col("tp") / F.col("support")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    p, r = zero(F.when(F.col("pred") > 0, p)), zero(F.when(F.col("support") > 0, r))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return s.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def brier(df: DataFrame, label: str, probability: Column) -> DataFrame:
    gap = probability - F.col(label)
    return df.agg(F.round(F.avg(gap * gap), 6).alias("brier"), F.count("*").alias("n"))


def _running(df: DataFrame, order: str, sums: list[str], ranges: int = 1024) -> DataFrame:
    """df(order, sums) with run_<sum>: running totals from the highest `order` down. Rows are sorted into ranges by
    sampled bounds; totals are taken inside each range and then over ranges, so no task holds all rows. The number of a
    range is never null, else the engine would ask for it in a filter on the rows below df's own aggregation."""
    bounds = df.select(F.percentile_approx(order, [x / ranges for x in range(1, ranges)], 10 * ranges)).first()[0] or []
    ends = np.array(sorted(set(bounds)), dtype=float)

    @F.pandas_udf("int")
    def above(x: pd.Series) -> pd.Series:
        return pd.Series(len(ends) - np.searchsorted(ends, x.to_numpy(dtype=float), side="right"))

    part = F.coalesce(above(F.col(order).cast("double")), F.lit(0))
    rows = df.withColumn("__p", part)
    per = rows.groupBy("__p").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])  # a row a range
    over = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("__p"), *[F.coalesce(F.sum(f"__t_{c}").over(over), F.lit(0)).alias(f"__b_{c}") for c in sums])
    inside = Window.partitionBy("__p").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(per), "__p")  # at most `ranges` rows
    return out.select(order, *sums, *[(F.col(f"__b_{c}") + F.sum(c).over(inside)).alias(f"run_{c}") for c in sums])


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, tp, fp, tpr, fpr, precision) at every distinct score, highest first: the points of the ROC and the
    precision-recall curve. Rows are counted by score before running sums are taken in ranges of scores."""
    by = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    total = by.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    run = _running(by, score, ["p", "q"]).crossJoin(F.broadcast(total))  # one row
    tp, fp = F.col("run_p"), F.col("run_q")
    return run.select(score, tp.alias("tp"), fp.alias("fp"), F.round(tp / F.col("all_p"), 6).alias("tpr"), F.round(fp / F.col("all_q"), 6).alias("fpr"), F.round(tp / (tp + fp), 6).alias("precision"))


def curve_areas(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row (roc_auc, average_precision): the area under the ROC curve, ties counted half, and the mean precision at
    the positive rows. Null where a class is missing."""
    by = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    run = _running(by, score, ["p", "q"])
    wins = F.col("q") * (F.col("run_p") - F.col("p") / 2)
    gain = F.col("p") * F.col("run_p") / (F.col("run_p") + F.col("run_q"))
    sums = run.agg(F.sum(wins).alias("w"), F.sum(gain).alias("g"), F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    return sums.select(F.round(F.when((F.col("all_p") > 0) & (F.col("all_q") > 0), F.col("w") / (F.col("all_p") * F.col("all_q"))), 6).alias("roc_auc"), F.round(F.when(F.col("all_p") > 0, F.col("g") / F.col("all_p")), 6).alias("average_precision"))


def sequence_features(rows: DataFrame, guid: str, a: Column, b: Column | None, label: Column, most: int = 32) -> DataFrame:
    """(guid, tokens, mask, segments, label_id): [CLS] a [SEP] b [SEP], the longer of a and b cut first, padded to
    `most`. Labels are numbered in alphabetical order."""
    b = F.array().cast("array<string>") if b is None else b
    has = F.size("b") > 0
    room = F.lit(most) - F.when(has, 3).otherwise(2)
    rows = rows.select(F.col(guid).alias("guid"), a.alias("a"), b.alias("b"), label.alias("label"))
    half = F.floor(room / 2).cast("int")
    # Cutting the longer one word by word ends where both fit: the shorter keeps up to half of the room, then the rest.
    keep_a = F.when(F.size("a") + F.size("b") <= room, F.size("a")).when(F.size("b") <= half, room - F.size("b")).when(F.size("a") <= room - half, F.size("a")).otherwise(room - half)
    keep_b = F.when(F.size("a") + F.size("b") <= room, F.size("b")).otherwise(F.least(F.size("b"), room - F.least(keep_a, F.size("a"))))
    cut = rows.select("guid", "label", F.slice("a", F.lit(1), F.least(keep_a, F.size("a"))).alias("a"), F.slice("b", F.lit(1), F.greatest(keep_b, F.lit(0))).alias("b"))
    first = F.concat(F.array(F.lit("[CLS]")), F.col("a"), F.array(F.lit("[SEP]")))
    second = F.when(F.size("b") > 0, F.concat(F.col("b"), F.array(F.lit("[SEP]")))).otherwise(F.array().cast("array<string>"))
    used = F.size("t")
    pieces = cut.withColumn("t", F.concat(first, second)).withColumn("first", F.size("a") + 2)
    labels = rows.select("label").distinct().withColumn("label_id", F.row_number().over(Window.orderBy("label")) - 1)  # a row per label
    out = pieces.select(
        "guid",
        "label",
        F.concat("t", F.array_repeat(F.lit("[PAD]"), F.lit(most) - used)).alias("tokens"),
        F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(most) - used)).alias("mask"),
        F.concat(F.array_repeat(F.lit(0), F.col("first")), F.array_repeat(F.lit(1), used - F.col("first")), F.array_repeat(F.lit(0), F.lit(most) - used)).alias("segments"),
    )
    return out.join(labels, "label").drop("label")


#: Python functions of this module travel with the plan, so workers need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
