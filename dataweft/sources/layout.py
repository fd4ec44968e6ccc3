"""Tables whose rows are laid out so that filters on several columns skip files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataweft.operators.clean import dense_ids
from dataweft.sources.io import read_table


def _place(c: str, bounds: Sequence | None) -> Column:
    """The number of ``bounds`` (sorted, one less than a power of two) that are not above the value, by bisection; 0 for NULL."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit((len(bounds) + 1) >> k) for k in range(1, (len(bounds) + 1).bit_length())])
    return F.aggregate(steps, F.lit(0), lambda a, s: F.when(F.get(table, a + s - 1) <= F.col(c), a + s).otherwise(a))


def interleaved(df: DataFrame, cols: Sequence[str], bits: int = 8) -> DataFrame:
    """``df`` with ``_z``: the interleaved bits of the numbers of the columns' ranges.

    A column is cut into at most 2**bits ranges of about equal numbers of rows, whose bounds are approximate quantiles; only these
    (2**bits - 1 values a column) reach the driver. Text is numbered in sorted order first. NULL lies in the first range.
    """
    text = [c for c in cols if df.schema[c].dataType.simpleString() in ("string", "boolean", "binary")]
    keys = {c: f"_key_{c}" if c in text else c for c in cols}
    rows = dense_ids(df, {c: keys[c] for c in text}) if text else df
    probs = [i / (1 << bits) for i in range(1, 1 << bits)]
    bounds = rows.agg(*[F.percentile_approx(k, probs).alias(f"b{i}") for i, k in enumerate(keys.values())]).first()
    z = F.lit(0).cast("long")
    for j, k in enumerate(keys.values()):
        rows = rows.withColumn(f"_place{j}", _place(k, bounds[j]).cast("long"))
        for i in range(bits):
            z = z + F.shiftleft(F.shiftright(f"_place{j}", i).bitwiseAND(F.lit(1)), i * len(keys) + j)
    return rows.withColumn("_z", z).select(*df.columns, "_z")


def write_interleaved(df: DataFrame, path: str, cols: Sequence[str], files: int, bits: int = 8, mode: str = "overwrite") -> DataFrame:
    """Write about ``files`` files, each holding rows that lie near each other in all of ``cols`` at once.

    The least and largest values that parquet keeps of a file then let a filter on any of the columns skip most files. ``df`` is read for the
    bounds and again for the rows, so hand in a table or a ``cut`` frame. An empty frame gives an empty table.
    """
    rows = interleaved(df, cols, bits).repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z")
    rows.write.mode(mode).parquet(path)
    return read_table(df.sparkSession, path, df.schema)
