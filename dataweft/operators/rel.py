"""Joins, membership filters and row selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataweft.operators.ordering import attach, with_group_position
from dataweft.operators.profile import value_counts, value_share
from dataweft.session import cut


def enrich(facts: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Left join one dimension per key column; Spark broadcasts a dimension only if its size allows."""
    for key, dim in dims.items():
        facts = facts.join(dim, key, "left")
    return facts


def semi(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def keep_frequent(df: DataFrame, c: str, n: int) -> DataFrame:
    """Rows whose category has more than ``n`` rows."""
    return attach(df, value_counts(df, c, dropna=True).where(F.col("n") > n).select(c), [c])  # adaptive execution may split a hot category


def keep_top(df: DataFrame, c: str, n: int) -> DataFrame:
    """Rows of the ``n`` largest categories, ties by name."""
    return attach(df, value_counts(df, c, dropna=True).orderBy(F.desc("n"), c).limit(n).select(c), [c])


def keep_share(df: DataFrame, base: DataFrame, c: str, pct: float) -> DataFrame:
    """Rows whose category makes more than ``pct`` percent of ``base``."""
    return attach(df, value_share(base, c).where(F.col("share") > pct).select(c), [c])


def keep_active(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of keys with at least ``n`` rows; ``attach`` lets adaptive execution split a hot key."""
    return attach(df, value_counts(df, key, dropna=True).where(F.col("n") >= n).select(key), [key])


def stratified_sample(df: DataFrame, c: str, frac: float, order: Sequence[str | Column]) -> DataFrame:
    """Exactly ``round(frac * size)`` rows of each stratum, the first in ``order`` (integers, NULL first).

    No row moves: histograms of ever finer ranges of the order find each stratum's last row, and a filter keeps what is not beyond
    it. Two ranges of 16 bits settle a hash unless rows tie; rows that tie in all of ``order`` are told apart by a hash of the whole row, and
    rows equal in all columns by their number alone. Pass a seeded hash such as ``F.xxhash64(key, F.lit(seed))`` followed by
    the key for a random draw.
    """
    keys = [F.coalesce((F.col(o) if isinstance(o, str) else o).cast("long"), F.lit(-(1 << 63))) for o in order]
    rows = df.withColumns({f"_o{i}": k for i, k in enumerate([*keys, F.xxhash64(*df.columns)])})
    names = [f"_o{i}" for i in range(len(keys) + 1)]
    sizes = rows.groupBy(c).agg(F.rint(F.count("*") * frac).cast("long").alias("_want"))
    # A stratum's cut: rows up to _last in (o0, o1, ...) stay. _left is how many of the range at _at are still wanted.
    state = cut(sizes.select(c, F.col("_want").alias("_left"), (F.col("_want") <= 0).alias("_done"), F.array().cast("array<bigint>").alias("_last"), F.lit(None).cast("long").alias("_at")))
    full = F.lit((1 << 63) - 1)
    for name in names:
        for shift in (48, 32, 16, 0):
            if state.where(~F.col("_done")).isEmpty():
                break
            open_ = state.where(~F.col("_done")).select(c, "_left", "_last", "_at")
            near = attach(rows.select(c, *names), open_, [c])
            for i, n in enumerate(names[:names.index(name)]):
                near = near.where(F.col(n) == F.get("_last", F.lit(i)))
            if shift < 48:
                near = near.where(F.shiftright(name, shift + 16) == F.col("_at"))
            counts = near.groupBy(c, F.shiftright(name, shift).alias("_bin")).agg(F.count("*").alias("_n"), F.first("_left").alias("_left"), F.first("_last").alias("_last"))
            before = Window.partitionBy(c).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 ranges of a stratum
            placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            hit = placed.where((F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_before") + F.col("_n")))
            whole = F.col("_left") == F.col("_before") + F.col("_n")
            end = F.shiftleft("_bin", shift) + F.lit((1 << shift) - 1)
            moved = hit.select(c, (F.col("_left") - F.col("_before")).alias("_left"), whole.alias("_done"),
                               F.when(whole | F.lit(shift == 0), F.concat("_last", F.array(end))).otherwise(F.col("_last")).alias("_last"), F.col("_bin").alias("_at"))
            state = cut(state.where("_done").unionByName(moved))
    beyond = F.lit(False)  # lexicographic: o0 > l0, or o0 = l0 and o1 > l1, ...
    for i, n in reversed(list(enumerate(names))):
        last = F.coalesce(F.get("_last", F.lit(i)), full)
        beyond = (F.col(n) > last) | ((F.col(n) == last) & beyond)
    marked = attach(rows, state.where(F.size("_last") > 0).select(c, "_last", "_left", "_done"), [c])
    kept = marked.where(~beyond)
    if state.where(~F.col("_done")).isEmpty():
        return kept.select(*df.columns)
    # Equal rows beyond the wanted number: any of them go, so only their number matters.
    equal = (F.size("_last") == len(names)) & ~F.col("_done")
    for i, n in enumerate(names):
        equal = equal & (F.col(n) == F.get("_last", F.lit(i)))
    some = kept.where(equal).groupBy(*df.columns).agg(F.first("_left").alias("_left")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_left")))
    return kept.where(~equal).select(*df.columns).unionByName(some.select(*df.columns))


def collect_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], name: str,
                    max_len: int = 100_000) -> DataFrame:
    """Ordered array of ``fields`` per key, in parts of at most ``max_len`` entries (``part`` 0, 1, ...).

    Positions come from the distributed numbering at every size, so no task ever holds a whole large group and no entry is
    lost. A group of more than ``max_len`` entries has several rows; ``max_len`` bounds the entries of a row, not their bytes,
    so choose it for the size of an entry.
    """
    keys = list(keys)
    placed = with_group_position(df, keys, order, "_pos")
    placed = placed.withColumn("part", F.floor((F.col("_pos") - 1) / max_len)).drop("_pos")
    entry = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("_e"))
    packed = placed.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    return packed.select(*keys, "part", F.transform("_all", lambda x: x["_e"]).alias(name))
