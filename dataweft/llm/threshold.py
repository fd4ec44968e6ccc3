"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

Candidates stand in shards of one label, longest vectors first. A shard keeps, for every dimension, its candidates sorted by that
component. An anchor reads each list from its best end (the top where its own component is positive, the bottom where it is
negative), scores every candidate it comes across in full, and knows from the last components read the largest score that a candidate not
yet seen can have. It stops when that threshold lies strictly below the k-th best score of each of its windows, or below a window's
lower end; so no tie is lost and the result is exact. The positives are one open window; each positive then opens a window of its own.

Blocks of anchors are only sent to a shard whose box of components can reach the least score that one of them needs; ids and boxes
are compared first, vectors travel after. Anchors are the stated query set; every row is a candidate.

Defined results: a row without an id or a label, or whose vector is NULL, empty or holds NULL or a non-finite component, takes no part;
rows that share an id are one (the smallest label, then vector); a shorter vector counts as filled with zeros; ties go to the
smaller id; an anchor without another row of its label has no rows, nor a positive without negatives in its window; a
negative positive score leaves an empty window; an empty table gives no rows. Scores are exact up to 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataweft.llm.vectors import best, matrix, packed, small_batches
from dataweft.operators.ordering import with_group_position, with_row_id
from dataweft.session import cut

#: Vectors in a shard, anchors in a block, places read from each list in the first round.
SHARD, BLOCK, FIRST = 2048, 256, 8
LOWEST = -(1 << 62)


def sorted_lists(x: np.ndarray) -> np.ndarray:
    """(dimension, depth): the places of the vectors, largest component first."""
    return np.argsort(-x, axis=0, kind="stable").T.astype(np.int32)


class Scan:
    """One anchor's sorted and random access to one shard."""

    def __init__(self, q: np.ndarray, x: np.ndarray, lists: np.ndarray, own: np.ndarray):
        self.q, self.x, self.lists, self.n = q, x, lists, len(x)
        self.up, self.down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        self.seen = own.copy()  # the anchor itself is no candidate
        self.at: list[np.ndarray] = []
        self.scores: list[np.ndarray] = []
        self.depth = 0

    def threshold(self) -> float:
        """The largest score of a candidate that no list has shown yet."""
        if self.depth >= self.n:
            return -np.inf
        up = self.x[self.lists[self.up, max(0, self.depth - 1)], self.up] @ self.q[self.up]
        down = self.x[self.lists[self.down, self.n - max(1, self.depth)], self.down] @ self.q[self.down]
        return float(up + down)

    def read(self, depth: int) -> None:
        """Sorted access down to ``depth``, random access to what is new."""
        before, self.depth = self.depth, min(depth, self.n)
        new = np.zeros(self.n, bool)
        new[self.lists[self.up, before:self.depth].ravel()] = True
        new[self.lists[self.down, self.n - self.depth:self.n - before].ravel()] = True
        if not len(self.up) and not len(self.down):  # every score is 0
            new[:] = True
            self.depth = self.n
        at = np.flatnonzero(new & ~self.seen)
        self.seen[at] = True
        self.at.append(at)
        self.scores.append(self.x[at] @ self.q)

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.at) != 1:
            self.at, self.scores = [np.concatenate(self.at or [np.arange(0)])], [np.concatenate(self.scores or [np.zeros(0)])]
        return self.at[0], self.scores[0]


def scan(q: np.ndarray, x: np.ndarray, lists: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Scan:
    """Read until no unseen candidate can be among the ``k`` best of a window [low, high]."""
    s = Scan(q, x, lists, own)
    low = np.where(low > high, np.inf, low)  # an empty window needs nothing
    depth = FIRST
    while True:
        tau = s.threshold()
        open_ = tau >= low
        if open_.any() and s.depth:
            scores = s.found()[1]
            for w in np.flatnonzero(open_):
                inside = scores[(scores >= low[w]) & (scores <= high[w])]
                if len(inside) >= k and tau < np.partition(inside, len(inside) - k)[len(inside) - k]:
                    open_[w] = False
        if not open_.any():
            return s
        s.read(depth)
        depth *= 2


def _index(dims: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = matrix(batch.column("vecs")[i], dims)
                row = batch.slice(i, 1)
                more = [pa.array([sorted_lists(x).tobytes()], pa.binary()), pa.array([x.min(0)], pa.list_(pa.float64())), pa.array([x.max(0)], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*row.columns, *more], names=[*batch.schema.names, "lists", "least", "most"])
    return work


def _box(rows: DataFrame, dims: int, names: tuple[str, str]) -> DataFrame:
    """Bounds of the components of a block's vectors."""
    def component(d: int) -> Column:
        return F.transform("queries", lambda v: F.coalesce(F.get(v, F.lit(d)), F.lit(0.0)))

    return rows.withColumns({name: F.array(*[pick(component(d)) for d in range(dims)]) for name, pick in zip(names, (F.array_min, F.array_max), strict=True)})


def _reach() -> Column:
    """The largest product of a vector of the block's box and one of the shard's."""
    corner = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    products = F.arrays_zip(*[corner(a, b).alias(f"p{i}") for i, (a, b) in enumerate((a, b) for a in ("low", "high") for b in ("least", "most"))])
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + F.greatest(p["p0"], p["p1"], p["p2"], p["p3"]))


def _search(k: int, dims: int, names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                col = {n: batch.column(n)[i] for n in batch.schema.names}
                qid, vid = (col[c].values.to_numpy() for c in ("query_ids", "vec_ids"))
                qs, xs = matrix(col["queries"], dims), matrix(col["vecs"], dims)
                lists = np.frombuffer(col["lists"].as_buffer(), np.int32).reshape(dims, len(xs))
                out: list[list[np.ndarray]] = []
                for j, q in enumerate(qs):
                    windows = col["windows"][j].values
                    rank, low, high = (windows.field(c).to_numpy() for c in ("rank", "low", "high"))
                    at, scores = scan(q, xs, lists, vid == qid[j], low.astype(float), high.astype(float), k).found()
                    for r, a, b in zip(rank, low, high, strict=True):
                        inside = np.flatnonzero((scores >= a) & (scores <= b))
                        top = inside[best(scores[inside], vid[at[inside]], k)]
                        out.append([np.full(len(top), qid[j]), np.full(len(top), r), vid[at[top]], scores[top].astype(np.int64)])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=names)
    return work


class Shards:
    """The candidates' shards and the meeting of anchors with them."""

    def __init__(self, rows: DataFrame, dims: int):
        self.dims = dims
        length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        placed = with_group_position(rows, ["label"], [length.desc(), F.col("vec_id")], "pos").withColumn("part", F.floor((F.col("pos") - 1) / SHARD))
        dealt = placed.groupBy("label", "part").agg(F.collect_list(F.struct("vec_id", "v")).alias("r"))
        numbered = with_row_id(dealt.select("label", "part", F.col("r.vec_id").alias("vec_ids"), F.col("r.v").alias("vecs")), ["label", "part"], "shard")
        plain = numbered.select("shard", "label", "vec_ids", "vecs")
        with small_batches(rows.sparkSession):
            self.index = cut(plain.mapInArrow(_index(dims), "shard long, label long, vec_ids array<long>, vecs array<array<double>>, "
                                                            "lists binary, least array<double>, most array<double>"))
        self.count = self.index.count()

    def meet(self, asked: DataFrame, own_label: bool, k: int, dims: int) -> DataFrame:
        """(query_id, positive_rank, vec_id, score): the ``k`` best of each shard and window.

        ``asked`` holds (label, vec_id, v, windows); windows are (rank, low, high).
        """
        least = F.array_min(F.transform("windows", lambda w: F.when(w["low"] <= w["high"], w["low"]).otherwise(F.lit(-LOWEST))))
        rows = asked.withColumn("v", F.struct("v", "windows", least.alias("least")))
        blocks = packed(rows, ["label"], BLOCK, "query_ids", "r").select(
            "label", "part", "query_ids", F.col("r.v").alias("queries"), F.col("r.windows").alias("windows"), F.array_min("r.least").alias("need"))
        blocks = cut(_box(blocks, dims, ("low", "high")))
        meta = self.index.select("shard", F.col("label").alias("of"), "least", "most")
        ranges = meta.groupBy("of").agg(F.min("shard").alias("first"), F.max("shard").alias("last"))
        heads = blocks.select("label", "part", "need", "low", "high").join(ranges, F.col("label") == F.col("of")).drop("of")
        if own_label:
            numbers = F.sequence("first", "last")
        else:
            numbers = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(self.count).cast("long")), lambda x: (x < F.col("first")) | (x > F.col("last")))
        pairs = heads.withColumn("shard", F.explode(numbers)).join(meta, "shard").where(_reach() >= F.col("need"))
        near = pairs.select("label", "part", "shard").join(blocks.select("label", "part", "query_ids", "queries", "windows"), ["label", "part"])
        work = near.join(self.index.select("shard", "vec_ids", "vecs", "lists"), "shard").select("query_ids", "queries", "windows", "vec_ids", "vecs", "lists")
        names = ["query_id", "positive_rank", "vec_id", "score"]
        with small_batches(asked.sparkSession):
            return cut(work.mapInArrow(_search(k, dims, names), "query_id long, positive_rank long, vec_id long, score long"))


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: float, relabel: int, labels: int) -> DataFrame:
    """(vec_id, label, v): rows that take part, components as floors; labels of ids divisible by ``relabel`` move on by one."""
    x = F.col(vector)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull()).where(fine)
    own, of = F.col(vec_id).cast("long"), F.col(label).cast("long")
    moved = F.when(own % relabel == 0, (of + 1) % labels).otherwise(of) if relabel else of
    rows = rows.select(own.alias("vec_id"), F.struct(moved.alias("label"), F.transform(x.cast("array<double>"), lambda c: F.floor(c * scale).cast("double")).alias("v")).alias("r"))
    return cut(rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.*"))


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, relabel: int = 7,
                   labels: int = 10, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows whose id is divisible by ``every``.

    An anchor's positives are its best rows of the same label; a positive's negatives are the best rows of other labels whose
    score lies between ``low`` and ``high`` percent of the positive's.
    """
    rows = usable(vectors, vec_id, vector, label, scale, relabel, labels)
    dims = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]
    shards = Shards(rows, dims)
    anchors = rows.where(F.col("vec_id") % every == 0)
    window = lambda rank, a, b: F.struct(F.lit(rank).cast("long").alias("rank"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    whole = F.array(window(0, F.lit(LOWEST), F.lit(-LOWEST)))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best_own = shards.meet(anchors.withColumn("windows", whole), True, positives, dims).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= positives)
    near = cut(best_own.select(F.col("query_id").alias("anchor_id"), F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Integer ends: the least score of at least low percent, the largest of at most high percent.
    ends = near.select("anchor_id", window(F.col("positive_rank"), F.ceil(F.col("positive_score") * low / F.lit(100).cast("decimal(3,0)")),
                                           F.floor(F.col("positive_score") * high / F.lit(100).cast("decimal(3,0)"))).alias("w"))
    opened = ends.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list("w")).alias("windows"))
    asked = anchors.join(opened, "vec_id").select("label", "vec_id", "v", "windows")
    found = shards.meet(asked, False, negatives, dims)
    by = Window.partitionBy("query_id", "positive_rank").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    ranked = ranked.select(F.col("query_id").alias("anchor_id"), F.col("positive_rank").cast("int").alias("positive_rank"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(ranked, ["anchor_id", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
