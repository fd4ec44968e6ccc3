"""Vectors in blocks: cleaning, packing and the top products of a block of queries and a block of vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dataweft.session import cut


def usable(vectors: DataFrame, vec_id: str, vector: str, change=lambda x: x) -> DataFrame:
    """(vec_id long, v array<double>) of the rows with an id and a vector of finite components, one row per id.

    ``change`` is applied to every component. Of rows that share an id the smallest vector counts, so repeated
    rows are one. Empty vectors take no part.
    """
    x = F.col(vector)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_id).isNotNull()).where(fine)
    changed = F.transform(x.cast("array<double>"), change)
    return cut(rows.groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(F.min(changed).alias("v")))


def packed(rows: DataFrame, keys: Sequence[str], most: int, ids: str, vecs: str) -> DataFrame:
    """(keys, part, ids, vecs): the rows of each key in blocks of about ``most``, a larger group being dealt out evenly."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("parts"))
    dealt = rows.join(sizes, list(keys)).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts")))
    return dealt.groupBy(*keys, "part").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows")).select(
        *keys, "part", F.col("rows.vec_id").alias(ids), F.col("rows.v").alias(vecs))


def matrix(vecs: pa.Scalar | pa.Array, dims: int) -> np.ndarray:
    """Rows of a nested array, shorter vectors being filled with zeros."""
    values = vecs.values if isinstance(vecs, pa.Scalar) else vecs
    size = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims))
    rows = np.repeat(np.arange(len(size)), size)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def top_ranks(found: DataFrame, k: int, *score: Column) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows per query; Spark cuts each task's rows before the shuffle."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 4) -> Iterator[None]:
    """Send tasks few rows at once, where a row is a whole block; work must be evaluated before the block ends."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
