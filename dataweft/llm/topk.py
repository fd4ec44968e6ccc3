"""Exact top-k search by integer inner product, vectors grouped by length.

Vectors stand in buckets of like length, longest first; a task holds a group of buckets and reads queries in batches. The first bucket gives every query a first
k-th best score. A later bucket is only met by queries for which length times length can still reach that score,
and there the score divided by both lengths is the bucket's local cosine threshold. A low threshold prunes by length (a
sorted bucket's prefix), a high one by coordinates: a vector whose cosine reaches it lies in an interval around each of
the query's largest coordinates. What is left is verified by the product itself, so the result is exact.

Defined results: a vector that is NULL or empty or holds NULL or a non-finite component takes no part, neither do rows
without an id; rows that share an id are one (the smallest vector); a shorter vector counts as filled with zeros; ties go to
the smaller id; fewer candidates than k give fewer rows; an empty table gives an empty result. Scores are exact up to 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataweft.llm.vectors import best, matrix, top_ranks, usable
from dataweft.operators.ordering import with_row_id
from dataweft.session import cut

#: Vectors in a bucket, queries that meet it at once, buckets that one task holds, and tasks that the search is dealt to, about, where fewer groups of buckets are there.
BUCKET, BLOCK, SPAN, CELLS = 1024, 256, 32, 12
#: From this local cosine threshold on, coordinates prune better than length, looking at so many of them.
STEEP, FOCUS = 0.3, 3


def candidates(q: np.ndarray, size: float, theta: float, bucket: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places in the bucket (longest first) whose product with ``q`` may reach ``theta``."""
    if theta <= 0 or size == 0 or length[0] == 0:
        return np.arange(len(length))
    slack = 1e-9
    alive = int(np.searchsorted(-length, -theta / size * (1 - slack), side="right"))  # shorter ones can't reach it
    local = theta / (size * length[0]) * (1 - slack)
    if alive == 0 or local > 1:
        return np.arange(0)
    if local < STEEP:
        return np.arange(alive)
    keep = np.ones(alive, bool)
    need = theta / (size * length[:alive]) * (1 - slack)  # cosine that each vector must reach
    across = np.sqrt(np.maximum(0, 1 - need * need))
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        c = q[f] / size
        wide, x = across * np.sqrt(max(0.0, 1 - c * c)), bucket[:alive, f] / length[:alive]
        # Two vectors at an angle of at most acos(need): the axis sees the one within that angle of the other.
        low = np.where(c >= -need, c * need - wide, -1.0)
        high = np.where(c <= need, c * need + wide, 1.0)
        keep &= (x >= low - slack) & (x <= high + slack)
    return np.flatnonzero(keep)


def _search(k: int, dims: int):
    """The ``k`` best of a task's vectors for each of its queries; the vectors (kind 0) come first and stay, queries (kind 1) come in batches."""
    def meet(qid: np.ndarray, qs: np.ndarray, theta: np.ndarray, buckets: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        size, out = np.sqrt((qs * qs).sum(1)), []
        for vid, vs, length in buckets:
            for j, q in enumerate(qs):
                at = candidates(q, float(size[j]), float(theta[j]), vs, length)
                at = at[vid[at] != qid[j]]
                score = vs[at] @ q
                top = best(score, vid[at], k)
                out.append((np.full(len(top), j), vid[at[top]], score[top].astype(np.int64)))
        j, vid, score = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((vid, -score, j))
        by = j[order]
        order = order[np.arange(len(by)) - np.searchsorted(by, by) < k]
        return pa.RecordBatch.from_arrays([pa.array(qid[j[order]]), pa.array(vid[order]), pa.array(score[order])], names=["query_id", "vec_id", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        buckets: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            ids, vs, theta = batch.column("vec_id").to_numpy(), matrix(batch.column("v"), dims), batch.column("theta").to_numpy(zero_copy_only=False)
            if (kind == 0).any():
                held.append((ids[kind == 0], vs[kind == 0], batch.column("bucket").to_numpy(zero_copy_only=False)[kind == 0]))
            at = np.flatnonzero(kind == 1)
            if len(at) and held:
                vid, v, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
                held = []
                length = np.sqrt((v * v).sum(1))
                order = np.lexsort((-length, bucket))
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                buckets = [(vid[o], v[o], length[o]) for o in np.split(order, cuts)]
            for i in range(0, len(at) if buckets else 0, BLOCK):
                some = at[i:i + BLOCK]
                yield meet(ids[some], vs[some], theta[some], buckets)
    return work


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest products of every row whose id is divisible by ``every``."""
    rows = usable(vectors, vec_id, vector, lambda x: F.floor(x * scale).cast("double"))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.withColumn("length", F.sqrt(size))
    dims, n = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(1)), F.count("*")).first()
    schema = "query_id long, vec_id long, score long"
    n_buckets = max(1, -(-n // BUCKET))
    longest_first = [F.desc("length"), "vec_id"]
    placed = cut(with_row_id(rows, longest_first, "row").select("vec_id", "v", "length", F.floor((F.col("row") - 1) / BUCKET).cast("int").alias("bucket")))
    queries = placed.where(F.col("vec_id") % every == 0).select("vec_id", "v", "length")

    def found(queries: DataFrame, first: int, last: int) -> DataFrame:
        """The best of the stated buckets for every query, by groups of them that are long enough for it.

        A group and a share of the queries meet in a task. Vectors travel once for each share, a query once for each group, both as rows of one
        shuffle: nothing that grows with the tables is broadcast but a number for each group.
        """
        groups = -(-(last + 1 - first) // SPAN)
        shares = max(1, min(CELLS, n_buckets) // groups)
        group = F.floor((F.col("bucket") - first) / SPAN).cast("int").alias("group")
        mine = placed.where(F.col("bucket").between(first, last))
        longest = mine.groupBy(group).agg(F.max("length").alias("longest"))
        need = F.when(F.col("length") > 0, F.col("theta") / F.col("length")).otherwise(float("-inf"))
        to = queries.join(F.broadcast(longest), F.col("longest") * (1 + 1e-9) >= need)
        share = F.pmod(F.xxhash64("vec_id"), F.lit(shares)).cast("int")
        asked = to.select((F.col("group") * shares + share).alias("cell"), F.lit(1).alias("kind"), "vec_id", "v", "theta", F.lit(None).cast("int").alias("bucket"))
        given = mine.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select(
            (group * shares + F.col("share")).alias("cell"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(0.0).alias("theta"), "bucket")
        met = given.unionByName(asked).repartitionById(groups * shares, F.col("cell").cast("int")).sortWithinPartitions("kind").drop("cell")
        return met.mapInArrow(_search(k, dims), schema)

    head = cut(found(queries.withColumn("theta", F.lit(float("-inf"))), 0, 0))
    if n_buckets == 1:
        return top_ranks(head, k)
    kth = head.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("theta"))
    known = queries.join(kth, F.col("vec_id") == F.col("query_id"), "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))
    return top_ranks(head.unionByName(found(known.select("vec_id", "v", "length", "theta"), 1, n_buckets - 1)), k)
