"""Exact numbering, running totals and quantiles without a single-task window.

Rows are range-partitioned on the full sort key, so equal group keys may span tasks, and the position
inside a task is added to the totals of the tasks before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataweft.session import cut


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-partition and sort, keep the task number and the row's place in the task.

    The source task is the last sort key, so that copies of one row, equal in all other keys, need not share a task.
    """
    place = F.monotonically_increasing_id()
    by = [*order, F.col("_from")]
    ordered = df.withColumn("_from", F.spark_partition_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    return cut(ordered.select(*df.columns, F.shiftright(place, 33).cast("int").alias("_task"),
                              place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")))


def with_row_id(df: DataFrame, order: Sequence[str | Column], name: str = "id") -> DataFrame:
    """Number all rows 1..n in ``order``; give a total order for a repeatable result."""
    parts = _ranged(df, _cols(order))
    # one row per task: bounded by the number of partitions, like the range bounds themselves
    sizes = parts.groupBy("_task").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (parts.join(F.broadcast(starts), "_task")
            .withColumn(name, F.col("_start") + F.col("_place") + 1)
            .drop("_task", "_place", "_start"))


def with_group_position(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                        name: str = "position", size: str | None = None) -> DataFrame:
    """``row_number`` per group (and the group's size) that splits a hot group over many tasks."""
    keys = list(keys)
    numbered = with_row_id(df, [*keys, *order], "_row")
    groups = numbered.groupBy(*keys).agg(F.min("_row").alias("_first"), F.count("*").alias("_size"))
    joined = attach(numbered, groups, keys)
    return joined.select(*df.columns, (F.col("_row") - F.col("_first") + 1).alias(name),
                         *([F.col("_size").alias(size)] if size else []))


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join the columns of ``right`` (one row per key) to ``left``; NULL keys match each other."""
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str | Sequence[str],
                  name: str | Sequence[str] = "running") -> DataFrame:
    """Inclusive running sum of an integer ``weight`` (or of several) per group, a hot group being split over tasks."""
    keys = list(keys)
    weights, names = ([x] if isinstance(x, str) else list(x) for x in (weight, name))
    numbers = range(len(weights))
    parts = _ranged(df, _cols([*keys, *order])).drop("_place")
    pieces = parts.groupBy(*keys, "_task").agg(*[F.sum(weights[i]).alias(f"_sum{i}") for i in numbers])
    # at most one row per (group, task): a hot group has as many rows here as there are tasks
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_task") \
        .rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(*keys, "_task", *[F.coalesce(F.sum(f"_sum{i}").over(before), F.lit(0)).alias(f"_start{i}") for i in numbers])
    inside = Window.partitionBy(*keys, "_task").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select("*", *[F.sum(weights[i]).over(inside).alias(f"_local{i}") for i in numbers])
    return attach(local, starts, [*keys, "_task"]).select(
        *df.columns, *[(F.col(f"_local{i}") + F.col(f"_start{i}")).alias(names[i]) for i in numbers])


def value_table(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _v, _c): each value of each group and its number of rows, evaluated once."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
    return cut(rows.agg(F.count("*").alias("_c")))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of ``value`` per group, NULL values skipped, one output column per entry."""
    return quantiles_of(value_table(df, keys, value), keys, probs)


def quantiles_of(counts: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """The same from a ``value_table``. Values are ranked by a distributed running total at every size."""
    keys = list(keys)
    ranked = running_total(counts, keys, ["_v"], "_c", "_cum")
    if keys:
        joined = attach(ranked, counts.groupBy(*keys).agg(F.sum("_c").alias("_n")), keys)
    else:
        joined = ranked.withColumn("_n", counts.select(F.sum("_c")).scalar())

    def at(index: Column) -> Column:
        hit = (index < F.col("_cum")) & (index >= F.col("_cum") - F.col("_c"))
        return F.max(F.when(hit, F.col("_v").cast("double")))

    picks, outs = [], []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        picks += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}"),
                  F.max(pos - F.floor(pos)).alias(f"_f_{name}")]
        lo, hi, frac = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_f_{name}")
        outs.append((lo + (hi - lo) * frac).alias(name))
    return joined.groupBy(*keys).agg(*picks).select(*keys, *outs)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group.

    Spark limits each group to ``n`` rows per task before the shuffle, so a hot group does not travel whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
