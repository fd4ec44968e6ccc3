"""Queries on experiment tables, measured on the given vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataweft.operators import experiments
from dataweft.plans.registry import query
from dataweft.sources.inputs import table

RESULTS = {
    "cells": """SELECT CASE WHEN label < 5 THEN 1 ELSE -1 END AS y, unnest(embedding)::DOUBLE AS v,
        generate_subscripts(embedding, 1) - 1 AS d FROM embeddings""",
    "results": """SELECT CASE WHEN d % 2 = 0 THEN 'even' ELSE 'odd' END AS architecture, CAST(d AS VARCHAR) AS filters,
        CAST(d + 1 AS INTEGER) AS params, count(CASE WHEN (CASE WHEN v >= 0 THEN 1 ELSE -1 END) = y THEN 1 END) / count(*)::DOUBLE AS accuracy,
        avg((v - y) * (v - y)) AS mse FROM cells GROUP BY d"""}


def results(spark, d):
    e = table(spark, d, "embeddings").withColumn("y", F.when(F.col("label") < 5, 1).otherwise(-1))
    return experiments.results_frame(e, "embedding", "y")


def _shown(df):
    return df.withColumns({"filters": F.array_join(F.col("filters").cast("array<string>"), ","), "mse": F.round("mse", 6)})


@query("q_experiments", "SELECT architecture, filters, params, accuracy, round(mse, 6) AS mse FROM results ORDER BY params", ctes=RESULTS)
def experiment_table(spark, d):
    return _shown(experiments.sweep(results(spark, d), "params"))


@query("q_best_config", """
    SELECT architecture, filters, params, accuracy, round(mse, 6) AS mse FROM results WHERE params < 50
    ORDER BY accuracy DESC, mse, params LIMIT 1""", ctes=RESULTS)
def best_config(spark, d):
    return _shown(experiments.best_config(results(spark, d), 50))


@query("q_mse", "SELECT round(avg((quality - (1 - toxic)) * (quality - (1 - toxic))), 6) AS mse FROM labels")
def mse(spark, d):
    out = experiments.mse(table(spark, d, "labels"), F.col("quality"), 1 - F.col("toxic"))
    return out.select(F.round("mse", 6).alias("mse"))


@query("q_cat_accuracy", """
    SELECT count(CASE WHEN list_position(embedding, list_max(embedding)) - 1 = label THEN 1 END) / count(*)::DOUBLE AS accuracy
    FROM embeddings""")
def cat_accuracy(spark, d):
    return experiments.categorical_accuracy(table(spark, d, "embeddings"), "embedding", "label")
