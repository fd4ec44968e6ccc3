"""Projections, filters and value clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataweft.operators.ordering import with_row_id


def cast_cols(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def drop_sentinels(df: DataFrame, values: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Drop rows holding a placeholder value; NULL is kept, as a comparison of frames in memory keeps it."""
    keep = F.lit(True)
    for c, bad in values.items():
        for v in bad:
            keep = keep & ~F.col(c).eqNullSafe(F.lit(v))
    return df.where(keep)


def keep_any(df: DataFrame, cols: Sequence[str], absent: str = "None") -> DataFrame:
    """Keep rows where at least one of the flags is set; a missing flag differs from ``absent`` and so keeps its row."""
    keep = F.lit(False)
    for c in cols:
        keep = keep | ~F.col(c).eqNullSafe(F.lit(absent))
    return df.where(keep)


def drop_null_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def fill(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    return df.fillna(dict(values))


def replace_values(df: DataFrame, c: str, mapping: Mapping[Any, Any]) -> DataFrame:
    return df.replace(dict(mapping), subset=[c])


def impute_mean(df: DataFrame, c: str) -> DataFrame:
    """Fill NULL with the column mean, then cut to int. The mean is a scalar subquery, so nothing is joined."""
    mean = df.select(F.avg(c)).scalar()
    return df.withColumn(c, F.coalesce(F.col(c).cast("double"), mean).cast("int"))


def dedupe(df: DataFrame, cols: Sequence[str] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows, or one row per ``cols``: the smallest by ``order``, then by all other columns."""
    if cols is None:
        return df.distinct()
    rest = [*(order or []), *[c for c in df.columns if c not in cols and c not in (order or [])]]
    best = df.groupBy(*cols).agg(F.min(F.struct(*rest)).alias("_best"))
    return best.select(*cols, "_best.*").select(*df.columns)


def exclude_window(df: DataFrame, c: str, lo: date, hi: date) -> DataFrame:
    """Drop one calendar window, both ends included; one filter, so it reaches the scan."""
    return df.where((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi)))


def exclude_yearly(df: DataFrame, c: str, lo: tuple[int, int], hi: tuple[int, int], span: DataFrame | None = None,
                   keep_last_year: bool = False) -> DataFrame:
    """Drop a (month, day) window in every year from the first year of ``span`` on.

    The default drops the whole last year too, since years run over ``[first, last)``.
    ``span`` is the frame whose first and last dates count; by default ``df`` itself.
    """
    span = df if span is None else span
    first, last = (span.select(F.year(f(c))).scalar() for f in (F.min, F.max))
    day = F.month(c) * 100 + F.dayofmonth(c)
    inside = day.between(lo[0] * 100 + lo[1], hi[0] * 100 + hi[1])
    years = F.year(c) >= first
    return df.where(~inside & years & ((F.year(c) <= last) if keep_last_year else (F.year(c) < last)))


def bucket(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open range a value falls in; ``labels`` has one more entry than ``edges``."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.when(c < edges[0], labels[0])
    for e, label in zip(edges[1:], labels[1:-1]):
        out = out.when(c < e, label)
    return out.otherwise(labels[-1])


def ceil_bucket(c: str | Column, step: int, cap: int) -> Column:
    """Smallest positive multiple of ``step`` above the value, at most ``cap``; NULL falls in ``cap``."""
    c = F.col(c) if isinstance(c, str) else c
    up = F.greatest(F.least((F.floor(c / step) + 1) * step, F.lit(cap)), F.lit(step))
    return F.coalesce(up, F.lit(cap)).cast("int")


def histogram(df: DataFrame, c: str, edges: Sequence[float]) -> DataFrame:
    """Rows per left-closed bin, empty bins with 0, values outside all bins left out."""
    bins = F.array(*[F.lit(float(e)) for e in edges])
    number = F.size(F.filter(bins, lambda e: e <= F.col(c)))
    found = (df.where(F.col(c).isNotNull() & (F.col(c) >= float(edges[0])) & (F.col(c) < float(edges[-1])))
             .groupBy(number.cast("long").alias("_bin")).agg(F.count("*").alias("_n")))
    frame = df.sparkSession.range(1, len(edges)).select(
        F.col("id").alias("_bin"), F.element_at(bins, F.col("id").cast("int")).alias("bin_from"),
        F.element_at(bins, (F.col("id") + 1).cast("int")).alias("bin_to"))
    return frame.join(found, "_bin", "left").select("bin_from", "bin_to", F.coalesce("_n", F.lit(0)).alias("n"))


def dense_id(df: DataFrame, c: str, name: str, start: int = 0, missing: int | None = None) -> DataFrame:
    """Number the distinct values of ``c`` from ``start`` in sorted order and add the number to each row.

    The input is read for the values and again for the rows, so hand in a table or a ``cut`` frame.
    """
    return dense_ids(df, {c: name}, start, missing)


def dense_ids(df: DataFrame, names: Mapping[str, str], start: int = 0, missing: int | None = None) -> DataFrame:
    """``dense_id`` of several columns at once: all values are collected in one pass and numbered together."""
    values = F.array(*[F.struct(F.lit(i).alias("_i"), *[(F.col(c) if c == d else F.lit(None).cast(df.schema[d].dataType)).alias(f"_v{j}")
                                                      for j, d in enumerate(names)]) for i, c in enumerate(names)])
    each = df.select(F.inline(values)).distinct()
    keys = [f"_v{j}" for j in range(len(names))]
    each = each.where(" OR ".join(f"{k} IS NOT NULL" for k in keys))
    numbered = with_row_id(each, ["_i", *keys], "_id")
    first = numbered.groupBy("_i").agg(F.min("_id").alias("_first"))  # one row per column
    codes = numbered.join(F.broadcast(first), "_i").withColumn("_n", (F.col("_id") - F.col("_first") + start).cast("int"))
    out = df
    for i, (c, name) in enumerate(names.items()):
        own = codes.where(F.col("_i") == i).select(F.col(f"_v{i}").alias(c), F.col("_n").alias(name))
        out = out.join(own, c, "left")
    out = out.select(*df.columns, *names.values())
    return out if missing is None else out.fillna({n: missing for n in names.values()})


def new_ids(df: DataFrame, c: str, known: DataFrame | None = None, name: str = "id", start: int = 0) -> DataFrame:
    """(c, name) of the values of ``c`` that the dictionary ``known`` lacks: numbers after its largest, in sorted order.

    Append the result to the stored dictionary; values that it has keep their numbers, and a second try finds nothing new. NULL gets none.
    """
    values = df.select(c).where(F.col(c).isNotNull()).distinct()
    if known is None:
        first = F.lit(start).cast("long")
    else:
        values = values.join(known, c, "left_anti")
        first = F.coalesce(known.select(F.max(name) + 1).scalar(), F.lit(start)).cast("long")
    return with_row_id(values, [c], "_row").select(c, (F.col("_row") - 1 + first).alias(name))


def category_codes(df: DataFrame, cols: Sequence[str], suffix: str = "_Code") -> DataFrame:
    """Integer code of each category in sorted order, -1 where it is missing."""
    return dense_ids(df, {c: f"{c}{suffix}" for c in cols}, missing=-1)


def prefix(c: str | Column, n: int, pad: int | None = None) -> Column:
    """First ``n`` characters of a code, after left-padding with zeros when ``pad`` is given."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    if pad is not None:
        text = F.lpad(text, pad, "0")
    return F.substring(text, 1, n)


def update(df: DataFrame, assign: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """New values for the rows that match; all expressions see the old row."""
    if where is None:
        return df.withColumns(dict(assign))
    return df.withColumns({c: F.when(where, e).otherwise(F.col(c)) for c, e in assign.items()})


