"""Summaries of tables and columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataweft.operators.ordering import attach, quantiles_of, value_table
from dataweft.session import cut


def _melt(one: DataFrame, names: Sequence[str], value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias(value)) for i, c in enumerate(names)])
    return one.select(F.inline(pairs))


def _long(df: DataFrame, cols: Sequence[str], type_: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(type_).alias("value")) for c in cols])
    return df.select(F.inline(pairs))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def schema_table(df: DataFrame) -> DataFrame:
    """Column, type and non-NULL count."""
    types = dict(df.dtypes)
    counts = df.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    kinds = F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])])
    return _melt(counts, df.columns, "non_null").withColumn("type", F.element_at(kinds, F.col("column_name")))


def null_counts(df: DataFrame) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return _melt(one, df.columns, "n_null")


def missing_pct(df: DataFrame) -> DataFrame:
    one = df.agg(*[(F.count_if(F.col(c).isNull()) / F.count("*") * 100).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return _melt(one, df.columns, "missing_pct")


def nunique(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct non-NULL values of every column."""
    f = F.approx_count_distinct if approx else F.countDistinct
    return _melt(df.agg(*[f(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]), df.columns, "n_distinct")


def uniques(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).distinct()


def value_counts(df: DataFrame, c: str, dropna: bool = False) -> DataFrame:
    return (df.where(F.col(c).isNotNull()) if dropna else df).groupBy(c).agg(F.count("*").alias("n"))


def value_share(df: DataFrame, c: str) -> DataFrame:
    """Share of each category in percent, two digits, ties to even."""
    counts = value_counts(df, c, dropna=True)
    total = df.select(F.count(c)).scalar()
    return counts.withColumn("share", F.rint(F.col("n") / total * 100 * 100) / 100)


def numeric_summary(df: DataFrame, c: str, where: Column | None = None) -> DataFrame:
    """count, min, max, mean and exact median of the whole table."""
    return grouped_summary(df, [], c, where)


def grouped_summary(df: DataFrame, by: Sequence[str], c: str, where: Column | None = None) -> DataFrame:
    """The same per group. The median does not hold a group's values in one task."""
    if where is not None:
        df = df.where(where)
    by = list(by)
    groups = cut(df.groupBy(*by, F.col(c).alias("_v")).agg(F.count(c).alias("_c")))  # NULL values keep their groups
    basic = groups.groupBy(*by).agg(F.sum("_c").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), _weighted_mean().alias("avg"))
    medians = quantiles_of(groups.where("_c > 0"), by, {"median": 0.5})
    if not by:
        return basic.withColumn("median", medians.select("median").scalar()).withColumn("n", F.coalesce("n", F.lit(0)))
    return attach(basic, medians, by, "left")


def _weighted_mean() -> Column:
    """Mean from values and their numbers; NULL without values."""
    return F.sum(F.col("_v") * F.col("_c")) / F.nullif(F.sum("_c"), F.lit(0)).cast("double")


def sketch(df: DataFrame, by: Sequence[str], c: str, error: float = 0.01) -> DataFrame:
    """(by, side, bin, n): a summary of ``c`` per group from which quantiles follow with a relative error of at most ``error``.

    Bins grow by a fixed factor, so a group has at most some 71,000 of them however many rows it has. NULL and NaN are skipped.
    """
    x = F.col(c).cast("double")
    factor = (1 + error) / (1 - error)
    place = F.when(x == 0, 0).otherwise(F.ceil(F.log(F.abs(x)) / math.log(factor))).cast("long")
    return df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by, F.signum(x).cast("int").alias("side"), place.alias("bin")).agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups; summing counts loses nothing, so parts of any cut of the rows may be kept and merged."""
    return sketches.groupBy(*by, "side", "bin").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, by: Sequence[str], probs: dict[str, float], error: float = 0.01) -> DataFrame:
    """(by, n, one column per entry): the value of rank floor(p * (n - 1)), off by at most ``error`` of itself."""
    by, factor = list(by), (1 + error) / (1 - error)
    merged = merge_sketches(sketches, by)
    order = Window.partitionBy(*by).orderBy("side", F.col("side") * F.col("bin")).rowsBetween(Window.unboundedPreceding, 0)  # bins, not rows
    ranked = attach(merged.withColumn("_cum", F.sum("n").over(order)), merged.groupBy(*by).agg(F.sum("n").alias("_all")), by)
    value = F.col("side") * 2 * F.pow(F.lit(factor), F.col("bin")) / (factor + 1)
    at = {name: F.floor((F.col("_all") - 1) * F.lit(float(p))) for name, p in probs.items()}
    return ranked.groupBy(*by).agg(F.max("_all").alias("n"), *[
        F.max(F.when((k < F.col("_cum")) & (k >= F.col("_cum") - F.col("n")), value)).alias(name) for name, k in at.items()])


def describe_num(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max of each column."""
    rows = value_table(_long(df, cols, "double"), ["column_name"], "value")
    mean = rows.groupBy("column_name").agg(F.sum("_c").alias("n"), _weighted_mean().alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    spread = attach(rows, mean.select("column_name", "mean"), ["column_name"]).groupBy("column_name").agg(
        F.sum((F.col("_v") - F.col("mean")) * (F.col("_v") - F.col("mean")) * F.col("_c")).alias("_s"))
    basic = mean.join(spread, "column_name").select(
        "column_name", "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("_s") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("std"), "min", "max")
    return basic.join(quantiles_of(rows, ["column_name"], {"q25": .25, "q50": .5, "q75": .75}), "column_name", "left")


def describe_cat(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, distinct values, most frequent value (smallest on ties) and its frequency of each column."""
    counts = (_long(df, cols, "string").where("value IS NOT NULL")
              .groupBy("column_name", "value").agg(F.count("*").alias("c")))
    return counts.groupBy("column_name").agg(
        F.sum("c").alias("n"), F.count("*").alias("n_distinct"),
        F.min_by("value", F.struct((-F.col("c")), "value")).alias("top"), F.max("c").alias("freq"))


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of each pair, in one pass."""
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return _melt(one, [f"{a}~{b}" for a, b in pairs], "corr")


def date_span(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.min(c).alias("first"), F.max(c).alias("last"))


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per composite key; rows with a NULL key part are left out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias(name))
