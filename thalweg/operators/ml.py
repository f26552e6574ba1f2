"""Boosted trees on MLlib, with missing values imputed and flagged, and the reports around them."""

from __future__ import annotations

import itertools
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stats


def with_weights(df: DataFrame) -> DataFrame:
    """weight: negatives over positives for positives, 1 for negatives."""
    n = df.agg(F.count_if(F.col("y") == 0).alias("_neg"), F.count_if(F.col("y") == 1).alias("_pos"))
    weight = F.when(F.col("y") == 1, F.coalesce(F.try_divide("_neg", "_pos"), F.lit(1.0))).otherwise(F.lit(1.0))
    return df.crossJoin(F.broadcast(n)).withColumn("weight", weight).drop("_neg", "_pos")  # one row


def _flagged(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in features} | {c: F.col(c).cast("double") for c in features})


def fit_trees(df: DataFrame, features: list[str], rounds: int = 200, depth: int = 4, rate: float = 0.1, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees on y with balanced weights."""
    filled = [f"{c}_filled" for c in features]
    stages = [
        Imputer(inputCols=features, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=[*filled, *[f"{c}_missing" for c in features]], outputCol="features"),
        GBTClassifier(labelCol="y", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed),
    ]
    return Pipeline(stages=stages).fit(with_weights(_flagged(df, features)))


def predict(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """df with score, the probability of class 1."""
    return model.transform(_flagged(df, features)).withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "score")


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by importance; a feature's missing flag counts with it."""
    v = model.stages[-1].featureImportances.toArray()
    n = len(features)
    return sorted(((c, float(v[i] + v[n + i])) for i, c in enumerate(features)), key=lambda x: (-x[1], x[0]))


def random_grid(space: dict[str, list], k: int, seed: int = 42) -> list[dict]:
    """k settings drawn without replacement from all combinations."""
    every = [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]
    return random.Random(seed).sample(every, min(k, len(every)))


def search(df: DataFrame, features: list[str], space: dict[str, list], fold: str = "fold", k: int = 80, seed: int = 42) -> list[tuple[dict, float]]:
    """Settings with their mean precision over the folds of a column, best first."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    found = []
    for setting in random_grid(space, k, seed):
        values = []
        for f in folds:
            model = fit_trees(df.filter(F.col(fold) != f), features, seed=seed, **setting)
            values.append(stats.confusion(predict(model, df.filter(F.col(fold) == f), features)).first()["precision"])
        found.append((setting, sum(values) / len(values)))
    return sorted(found, key=lambda x: -x[1])


def leave_one_group_out(df: DataFrame, features: list[str], group: str = "basin", **trees) -> DataFrame:
    """Scores of every row by a model that has not seen its group."""
    out = None
    for (value,) in df.select(group).distinct().orderBy(group).collect():
        scored = predict(fit_trees(df.filter(F.col(group) != value), features, **trees), df.filter(F.col(group) == value), features)
        out = scored if out is None else out.unionByName(scored)
    return out


def compare_feature_sets(df: DataFrame, sets: dict[str, list[str]], group: str = "basin", **trees) -> dict[str, float]:
    """Leave-one-group-out AUC of each set of features."""
    return {name: stats.roc_auc(leave_one_group_out(df, columns, group, **trees)).first()["auc"] for name, columns in sets.items()}


def group_metrics(scored: DataFrame, group: str = "basin", least: int = 10, threshold: float = 0.5) -> DataFrame:
    """Metrics of groups with more than `least` rows; auc is NULL with a single class."""
    large = scored.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    rows = scored.join(large.select(group), group, "left_semi")
    return stats.confusion(rows, threshold, [group]).join(stats.roc_auc(rows, [group]), group).join(large, group)


def save_model(model: PipelineModel, path: str, features: list[str], threshold: float) -> None:
    """The model, and beside it a row with its features and the threshold of a positive."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(features, threshold)], "features array<string>, threshold double").coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def load_model(path: str) -> tuple[PipelineModel, list[str], float]:
    row = SparkSession.active().read.schema("features array<string>, threshold double").json(f"{path}/settings").first()
    return PipelineModel.load(f"{path}/model"), list(row["features"]), row["threshold"]
