"""Experiment tables: metrics per configuration and the choice of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mse(df: DataFrame, predicted: str | Column, actual: str | Column) -> DataFrame:
    p, a = (F.col(c) if isinstance(c, str) else c for c in (predicted, actual))
    return df.agg(F.avg((p - a) * (p - a)).alias("mse"))


def categorical_accuracy(df: DataFrame, scores: str, label: str) -> DataFrame:
    """Share of rows whose largest score (the first on ties) is at the true class."""
    best = F.array_position(scores, F.array_max(scores)) - 1
    return df.agg((F.count_if(best == F.col(label)) / F.count("*")).alias("accuracy"))


def results_frame(df: DataFrame, vec: str, label: str) -> DataFrame:
    """One row per one-feature classifier: configuration (architecture, filters, params) and its accuracy and error.

    Classifier d predicts by the sign of entry d and errs by its distance to the label (-1 or 1).
    All classifiers are measured in one pass.
    """
    rows = df.select(F.col(label).alias("_y"), F.posexplode(vec).alias("_d", "_v"))
    hit = F.when(F.col("_v") >= 0, 1).otherwise(-1) == F.col("_y")
    err = F.col("_v").cast("double") - F.col("_y")
    return rows.groupBy("_d").agg(
        (F.count_if(hit) / F.count("*")).alias("accuracy"), F.avg(err * err).alias("mse")).select(
        F.when(F.col("_d") % 2 == 0, "even").otherwise("odd").alias("architecture"), F.array("_d").alias("filters"),
        (F.col("_d") + 1).alias("params"), "accuracy", "mse")


def best_config(results: DataFrame, max_params: int = 100_000) -> DataFrame:
    """The most accurate configuration with fewer than ``max_params`` parameters; the lower error wins a tie."""
    return results.where(F.col("params") < max_params).orderBy(F.desc("accuracy"), "mse", "params").limit(1)


def sweep(results: DataFrame, c: str) -> DataFrame:
    return results.orderBy(c)
