"""Named constraints. A predicate that is NULL counts as violated."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Constraint(NamedTuple):
    name: str
    expr: Column


class ConstraintViolation(ValueError):
    pass


def _ok(c: Constraint) -> Column:
    return F.coalesce(c.expr, F.lit(False))


def valid_rows(df: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    keep = F.lit(True)
    for c in constraints:
        keep = keep & c.expr
    return df.where(keep)


def violation_report(df: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    """Violating rows per constraint, counted in one pass."""
    one = df.agg(*[F.count(F.when(~_ok(c), 1)).alias(f"c{i}") for i, c in enumerate(constraints)])
    pairs = F.array(*[F.struct(F.lit(c.name).alias("constraint_name"), F.col(f"c{i}").alias("violations"))
                      for i, c in enumerate(constraints)])
    return one.select(F.inline(pairs))


def enforce(df: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    """Return ``df`` when every row holds, else raise with the counts; run before a write."""
    broken = violation_report(df, constraints).where("violations > 0").collect()  # one row per constraint at most
    if broken:
        raise ConstraintViolation(", ".join(f"{r.constraint_name}: {r.violations} rows" for r in broken))
    return df


def write_enforced(df: DataFrame, path: str, constraints: Sequence[Constraint], mode: str = "errorifexists") -> DataFrame:
    """Write ``df`` if every row holds, else raise with the counts; the frame is evaluated once.

    Violations are counted on the rows as they are written into a staging folder beside ``path``. Only a folder without any is renamed to
    ``path``, so a violation, a failed job or a lost driver leaves nothing to be read there. ``overwrite`` replaces a table then.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"unknown mode {mode}")
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, staged = hadoop.Path(path), hadoop.Path(f"{path}.staged-{uuid.uuid4().hex}")
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode == "errorifexists" and store.exists(target):
        raise FileExistsError(path)
    seen = Observation()
    counts = [F.count_if(~_ok(c)).alias(f"c{i}") for i, c in enumerate(constraints)] or [F.count(F.lit(1)).alias("n")]
    try:
        df.observe(seen, *counts).write.parquet(staged.toString())
        broken = [(c.name, n) for i, c in enumerate(constraints) if (n := seen.get[f"c{i}"])]
        if broken:
            raise ConstraintViolation(", ".join(f"{name}: {n} rows" for name, n in broken))
        if mode == "overwrite":
            store.delete(target, True)
        if not store.rename(staged, target):
            raise OSError(f"{path} could not be put in place")
    finally:
        store.delete(staged, True)
    return spark.read.schema(df.schema).parquet(path)


# Names, columns and open bounds of the vehicle table's checks.
LISTING_BOUNDS = [("price_valid", "price", 1000, 500_000), ("yearOfRegistration_valid", "yearOfRegistration", 1900, 2026)]
LISTING_REQUIRED = [("model_known", ("model", "vehicleType")), ("brand_not_null", ("brand",)), ("abtest_not_null", ("abtest",))]


def listing_rules(max_price: int | None = None) -> list[tuple[str, str]]:
    """(name, SQL condition) of the five checks: one of some columns is given, or a column lies between its bounds."""
    given = [(name, " OR ".join(f"{c} IS NOT NULL" for c in cols)) for name, cols in LISTING_REQUIRED]
    high = lambda name, value: max_price if name == "price_valid" and max_price is not None else value
    return given + [(name, f"{c} > {lo} AND {c} < {high(name, hi)}") for name, c, lo, hi in LISTING_BOUNDS]


def listing_constraints(max_price: int | None = None) -> list[Constraint]:
    """The five checks of the vehicle table."""
    return [Constraint(name, F.expr(rule)) for name, rule in listing_rules(max_price)]
