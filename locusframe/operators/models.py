"""Model-based statistics with spark.ml: cross-validated AUC, importance by permutation, regressors and calibration."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.stats import auroc, value_ranks
from locusframe.operators.windows import hash_order


def with_folds(df: DataFrame, label: str, key: str, folds: int, seed: int) -> DataFrame:
    """``df`` with ``fold``: rows of each label dealt by hash, so folds are stratified without an order of the table."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(hash_order(seed, label, key), 1, 12), 16, 10).cast("long"), F.lit(folds)).cast("int"))


def _pipeline(features: Sequence[str], label: str, model: str, seed: int) -> Pipeline:
    learner = GBTClassifier(labelCol=label, featuresCol="scaled", maxIter=20, maxDepth=3, seed=seed) if model == "gbt" else LogisticRegression(labelCol=label, featuresCol="scaled", regParam=0.01)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), learner])


def fit_classifier(df: DataFrame, features: Sequence[str], label: str, model: str = "logistic", seed: int = 0) -> PipelineModel | None:
    """A fitted pipeline that scales and classifies; none without rows. Rows with a null feature or label must go before."""
    return None if df.isEmpty() else _pipeline(features, label, model, seed).fit(df)


def _score(model: PipelineModel | None, df: DataFrame) -> DataFrame:
    if model is None:
        return df.withColumn("score", F.lit(None).cast("double"))
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def cv_auc(df: DataFrame, features: Sequence[str], label: str, key: str, model: str = "logistic", folds: int = 3, seeds: Sequence[int] = (0,)) -> DataFrame:
    """(seed, auroc, n_pos, n_neg) of out-of-fold scores; scaling and fitting see the training folds only. The AUC is null
    without both classes; an empty table has counts of null."""
    out = None
    for seed in seeds:
        dealt = with_folds(df, label, key, folds, seed).cache()
        held = None
        for k in range(folds):
            fitted = fit_classifier(dealt.where(F.col("fold") != k), features, label, model, seed)
            part = _score(fitted, dealt.where(F.col("fold") == k)).select(label, "score")
            held = part if held is None else held.unionByName(part)
        row = auroc(held, label, "score").withColumn("seed", F.lit(seed))
        out = row if out is None else out.unionByName(row)
    return out


def cv_ablation(df: DataFrame, features: Sequence[str], label: str, key: str, **options) -> DataFrame:
    """(without, auroc): out-of-fold AUC with each feature left out; null for all of them."""
    rows = [cv_auc(df, features, label, key, **options).withColumn("without", F.lit(None).cast("string"))]
    rows += [cv_auc(df, [f for f in features if f != gone], label, key, **options).withColumn("without", F.lit(gone)) for gone in features]
    return reduce(DataFrame.unionByName, rows).groupBy("without").agg(F.avg("auroc").alias("auroc"))


def cv_univariate(df: DataFrame, features: Sequence[str], label: str, key: str, **options) -> DataFrame:
    """(feature, auroc): out-of-fold AUC of each feature by itself."""
    rows = [cv_auc(df, [f], label, key, **options).withColumn("feature", F.lit(f)) for f in features]
    return reduce(DataFrame.unionByName, rows).groupBy("feature").agg(F.avg("auroc").alias("auroc"))


def cv_null(df: DataFrame, features: Sequence[str], label: str, key: str, draws: int, seed: int = 0, **options) -> DataFrame:
    """(observed, ge, p): out-of-fold AUC against that of labels dealt anew within hash cells; (1 + ge) / (draws + 1).

    Rows with a null feature or label must go before; an observed AUC of null (one class) gives no row to compare and
    p of 1 / (draws + 1).
    """
    seen = cv_auc(df, features, label, key, **options).agg(F.avg("auroc").alias("observed"))
    cells = df.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(16)))
    place = cells.withColumn("__n", F.row_number().over(Window.partitionBy("__salt").orderBy(key))).drop(label)
    each = []
    for r in range(draws):
        mixed = cells.select("__salt", label, F.row_number().over(Window.partitionBy("__salt").orderBy(hash_order(seed + 1 + r, key))).alias("__n"))
        each.append(cv_auc(place.join(mixed, ["__salt", "__n"]), features, label, key, **options).agg(F.avg("auroc").alias("a")))
    null = reduce(DataFrame.unionByName, each).crossJoin(F.broadcast(seen))
    out = null.groupBy("observed").agg(F.count_if(F.col("a") >= F.col("observed") - 1e-12).alias("ge"))
    return out.withColumn("p", (F.col("ge") + 1) / (draws + 1))


def permutation_importance(model: PipelineModel | None, df: DataFrame, features: Sequence[str], label: str, key: str, seed: int = 0) -> DataFrame:
    """(feature, drop): loss of AUC when one column is dealt anew by hash rank; null without a model or both classes."""
    base = auroc(_score(model, df), label, "score").first()[0]
    out = None
    for f in features:
        parts = df.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(16)))
        place = parts.withColumn("__n", F.row_number().over(Window.partitionBy("__salt").orderBy(key)))
        dealt = parts.select("__salt", F.col(f).alias("__v"), F.row_number().over(Window.partitionBy("__salt").orderBy(hash_order(seed, key))).alias("__n"))
        mixed = place.join(dealt, ["__salt", "__n"]).withColumn(f, F.col("__v"))
        row = auroc(_score(model, mixed), label, "score").select(F.lit(f).alias("feature"), (F.lit(base).cast("double") - F.col("auroc")).alias("drop"))
        out = row if out is None else out.unionByName(row)
    return out


def fit_regressor(df: DataFrame, features: Sequence[str], label: str, kind: str = "gbt", seed: int = 0) -> PipelineModel | None:
    """A fitted pipeline, none without rows; rows with a null feature or label must go before."""
    if df.isEmpty():
        return None
    learner = GBTRegressor(labelCol=label, featuresCol="raw", maxIter=20, maxDepth=4, seed=seed) if kind == "gbt" else RandomForestRegressor(labelCol=label, featuresCol="raw", numTrees=20, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"), learner]).fit(df)


def predicted(model: PipelineModel | None, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction``; null without a model."""
    return df.withColumn("prediction", F.lit(None).cast("double")) if model is None else model.transform(df)


def to_unit(df: DataFrame, value: str, train: DataFrame, train_value: str) -> DataFrame:
    """``df`` with ``unit``: the share of training values that are at most the value."""
    n = train.where(F.col(train_value).isNotNull()).count()
    both = df.select(F.col(value).alias("v"), F.lit(0).alias("t")).unionByName(train.select(F.col(train_value).alias("v"), F.lit(1).alias("t")))
    ranks = value_ranks(both, "v", ["t"]).select(F.col("v").alias(value), ((F.col("before_t") + F.col("t")) / max(n, 1)).alias("unit"))
    return df.join(ranks, value, "left")


def blend(a: str, b: str, weight: float):
    """Weighted mean of two columns; null if either is."""
    return F.col(a) * weight + F.col(b) * (1 - weight)
