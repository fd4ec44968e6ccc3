"""Versioned tables as one parquet table partitioned by version, and the differences of two states of a table.

The folder names are all there is: ``base`` is the version whose snapshot the rows build on, ``version`` the one that brought them and
``operation`` what that was. A state is read by a filter on these partitions, the history by counting rows per partition. Rows of a version
are written by dynamic partition overwrite, so a write that is tried again replaces what it left. One writer at a time; a version
without rows leaves no trace.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = ("base", "version", "operation")


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def _write(df: DataFrame, path: str, base: int, version: int, operation: str, mode: str) -> int:
    rows = df.withColumns(dict(zip(PLACE, (F.lit(base), F.lit(version), F.lit(operation)), strict=True)))
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(path)
    return version


def _last(spark: SparkSession, path: str, upto: int | None = None) -> tuple[int, int]:
    """(base, version) of the last version, or of the stated one; only folder names are needed."""
    table = _table(spark, path).select("base", "version")
    row = (table if upto is None else table.where(F.col("version") == upto)).agg(F.max(F.struct("version", "base")).alias("m")).first()["m"]
    if row is None:
        raise ValueError(f"no version {upto}")
    return row["base"], row["version"]


def create(df: DataFrame, path: str, operation: str = "create") -> int:
    """Write version 0; it is an error if the table exists."""
    return _write(df, path, 0, 0, operation, "errorifexists")


def commit(df: DataFrame, path: str, operation: str, add: bool = False) -> int:
    """Write the next version: a whole snapshot, or with ``add`` the rows of ``df`` on top of the last version."""
    base, version = _last(df.sparkSession, path)
    return _write(df, path, base if add else version + 1, version + 1, operation, "overwrite")


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The table as of a version; the filter on the partitions leaves out all other files."""
    base, _ = _last(spark, path, version)
    return _table(spark, path).where((F.col("base") == base) & (F.col("version") <= version)).drop(*PLACE)


def history(spark: SparkSession, path: str) -> DataFrame:
    """(version, operation, n_rows, n_parts): rows that each version wrote and the number of versions that make up its state."""
    counts = _table(spark, path).groupBy(*PLACE).agg(F.count("*").alias("n_rows"))
    parts = F.count("*").over(Window.partitionBy("base").orderBy("version"))  # a row per version
    return counts.select("version", "operation", "n_rows", parts.cast("int").alias("n_parts"))


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that turn ``old`` into ``new``: insert, delete, update_preimage and update_postimage. Keys are unique."""
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"))
    both = a.join(b, list(keys), "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    row = lambda kind, side: F.struct(F.lit(kind).alias("change_type"), F.col(side).alias("r"))
    kinds = (F.when(F.col("_old").isNull(), F.array(row("insert", "_new")))
             .when(F.col("_new").isNull(), F.array(row("delete", "_old")))
             .otherwise(F.array(row("update_preimage", "_old"), row("update_postimage", "_new"))))
    return both.select(*keys, F.explode(kinds).alias("e")).select(*keys, "e.change_type", "e.r.*")


def row_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to delete from and insert into ``old`` to get ``new``, as often as needed: (columns, change_type), for tables without a key.

    Equal rows are counted with a sign on both sides, so a row that stands three times before and once after is deleted twice. Counts
    combine on the map side; rows are compared in all columns, NULL with NULL.
    """
    signed = old.withColumn("_n", F.lit(-1)).unionByName(new.select(*old.columns).withColumn("_n", F.lit(1)))
    left = signed.groupBy(*old.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n")))
    return left.select(*old.columns, F.when(F.col("_n") < 0, "delete").otherwise("insert").alias("change_type"), copies.alias("_copy")).drop("_copy")


def compare(new: DataFrame, old: DataFrame, aggs: Mapping[str, Column], names: tuple[str, str] = ("new", "old")) -> DataFrame:
    """Each aggregate of two states of a table and the difference new - old, in one row."""
    one_a, one_b = (df.agg(*[e.alias(n) for n, e in aggs.items()]) for df in (new, old))
    sides = one_a.withColumn("_s", F.lit("a")).unionByName(one_b.withColumn("_s", F.lit("b")))
    pick = lambda n, s: F.max(F.when(F.col("_s") == s, F.col(n)))
    wide = sides.agg(*[pick(n, s).alias(f"{n}_{v}") for n in aggs for s, v in zip("ab", names, strict=True)])
    return wide.withColumns({f"{n}_difference": F.col(f"{n}_{names[0]}") - F.col(f"{n}_{names[1]}") for n in aggs})
