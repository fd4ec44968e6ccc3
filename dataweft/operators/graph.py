"""Edge parsing, PageRank and connected components on edge lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataweft.functions.scalars import remove_literal, strip_one, trim_all
from dataweft.operators.ordering import attach, top_per_group
from dataweft.operators.rel import collect_ordered
from dataweft.session import cut, shuffle_partitions

LINKS_PER_TASK = 2_000_000


def parse_edges(lines: DataFrame, mode: str = "strict", c: str = "value") -> DataFrame:
    """``source|destination`` lines to edges; lines without exactly two parts are dropped.

    strict: every ``+]`` removed, empty parts ignored, distinct edges. loose: one trailing ``+`` removed from the
    trimmed line, empty parts count unless at the end. df: as loose, but the line is not trimmed and all empty
    parts count. The last two keep duplicates.
    """
    line = F.col(c)
    trim_parts = lambda parts: F.transform(parts, trim_all)
    if mode == "strict":
        parts = F.filter(trim_parts(F.split(remove_literal(trim_all(line), "+]"), r"\|")), lambda p: p != "")
    elif mode == "loose":
        bare = F.regexp_replace(strip_one(trim_all(line), "+"), r"\|+\z", "")  # empty parts at the end do not count
        parts = trim_parts(F.split(bare, r"\|"))
    elif mode == "df":
        parts = F.transform(F.split(strip_one(line, "+"), r"\|"), lambda p: F.trim(p))
    else:
        raise ValueError(f"unknown mode {mode}")
    edges = (lines.select(parts.alias("_p")).where(F.size("_p") == 2)
             .select(F.get("_p", F.lit(0)).alias("src"), F.get("_p", F.lit(1)).alias("dst")))
    return edges.distinct() if mode == "strict" else edges


def out_degree(edges: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return edges.groupBy(*group, "src").agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame, group: Sequence[str] = (), max_len: int = 100_000) -> DataFrame:
    """Sorted neighbour list per source, a hub's list being cut into parts."""
    packed = collect_ordered(edges, [*group, "src"], ["dst"], ["dst"], "neighbours", max_len)
    return packed.withColumn("neighbours", F.transform("neighbours", lambda e: e["dst"]))


def pagerank(edges: DataFrame, iters: int = 10, damping: float = 0.85, group: Sequence[str] = (),
             distinct: bool = True, slice_edges: int = 1_000_000, cut_every: int = 5) -> DataFrame:
    """Ranks (group, page, rank) after ``iters`` rounds, one rank set per group in a single job.

    Every source starts with 1; a page's next rank is ``1 - damping + damping * sum(rank / outdegree)`` over its
    in-links. Pages without in-links leave the set after a round and ranks of pages without out-links pass nothing on.

    Links and degrees are partitioned by source once; a round moves only the partial sums. The links of a source with more than
    ``slice_edges`` of them are spread over slices, and its rank is sent to each slice.
    """
    keys = on = [*group, "src"]
    spark = edges.sparkSession
    once = edges.groupBy(*group, "src", "dst").agg((F.lit(1) if distinct else F.count("*")).cast("long").alias("times"))
    once = cut(once)  # read twice below
    sources = once.groupBy(*keys).agg(F.sum("times").alias("degree"), F.count("*").alias("n_links"))
    sources = cut(sources.withColumn("slices", F.ceil(F.col("n_links") / slice_edges).cast("int")))
    slices, n_links = sources.agg(F.max("slices"), F.sum("n_links")).first()
    sources, hot = sources.drop("n_links"), (slices or 1) > 1
    # one number of tasks for links and ranks, by the number of links, so that rounds line up without moving links
    tasks = max(spark.sparkContext.defaultParallelism, -(-(n_links or 0) // LINKS_PER_TASK))

    with shuffle_partitions(spark, tasks):
        placed = lambda df, by: df.repartition(tasks, *by).sortWithinPartitions(*by).persist(StorageLevel.MEMORY_AND_DISK)
        links = once
        if hot:
            links = attach(once, sources.drop("degree"), keys).withColumn("slice", F.pmod(F.xxhash64("dst"), F.col("slices")).cast("int")).drop("slices")
            on = [*keys, "slice"]
        links, degrees = placed(links, on), placed(sources, keys)
        for df in (links, degrees):
            df.count()  # only a filled cache tells the planner how it is partitioned and sorted

        ranks = sources.select(*group, F.col("src").alias("page"), F.lit(1.0).alias("rank"))
        for i in range(iters):
            out = degrees.join(ranks.withColumnRenamed("page", "src"), keys).withColumn("part", F.col("rank") / F.col("degree"))
            if hot:
                out = out.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
            shares = links.join(out.select(*on, "part"), on).select(*group, "dst", (F.col("part") * F.col("times")).alias("share"))
            ranks = (shares.groupBy(*group, F.col("dst").alias("page")).agg(F.sum("share").alias("_c"))
                     .select(*group, "page", (F.lit(1 - damping) + F.lit(damping) * F.col("_c")).alias("rank")))
            if (i + 1) % cut_every == 0 and i + 1 < iters:
                ranks = cut(ranks)
        ranks = cut(ranks)
    links.unpersist()
    degrees.unpersist()
    return ranks


def normalise(ranks: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Ranks divided by the largest of their group; a largest rank of 0 or NULL counts as 1."""
    top = ranks.groupBy(*group).agg(F.max("rank").alias("_top"))
    if group:
        joined = attach(ranks, top, group)
    else:
        joined = ranks.withColumn("_top", top.scalar())
    by = F.when(F.coalesce(F.col("_top"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("_top"))
    return joined.withColumn("rank", F.col("rank") / by).drop("_top")


def top_pages(ranks: DataFrame, n: int = 15, group: Sequence[str] = ()) -> DataFrame:
    """The ``n`` best pages of each group, ties by name."""
    if not group:
        return ranks.orderBy(F.desc("rank"), "page").limit(n)
    return top_per_group(ranks, group, [F.desc("rank"), F.col("page")], n)


def rank_by_group(ranks: DataFrame, groups: DataFrame, group: str = "lang") -> DataFrame:
    """Total rank of each of the ``groups``, largest first; a group without ranks has 0."""
    totals = ranks.groupBy(group).agg(F.sum("rank").alias("total_rank"))
    return (groups.select(group).distinct().join(totals, group, "left").fillna({"total_rank": 0.0})
            .orderBy(F.desc("total_rank"), group))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node each node is connected to, directly or through others.

    Each round links the larger neighbours of a node to its smallest neighbour, then the node and its smaller
    neighbours to the smallest of them, until only stars are left: each node has one smaller neighbour, which has none.
    Minima are pre-aggregated per task; the join that hands them back is an equi-join whose hot keys adaptive execution
    splits, and no neighbour list is ever built.
    """
    pairs = cut(edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")))  # the edges are read once
    loops = cut(pairs.where("hi = lo").select(F.col("hi").alias("node")).distinct())
    stars = pairs.where("hi <> lo")
    for _ in range(max_rounds):
        # large star: every larger neighbour of u moves to the smallest node around u, which is u itself
        # unless u has a smaller neighbour
        low = stars.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m"))
        large = (attach(stars, low, ["lo"], "left")
                 .groupBy("hi", F.coalesce("m", "lo").alias("lo")).agg(F.max(F.col("m").isNotNull()).alias("moved")))
        # small star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        kept = attach(large, least, ["hi"])
        small = kept.select(F.explode(F.when(F.col("lo") == F.col("m"), F.array(F.struct("hi", F.col("m").alias("lo"), "moved")))
                                      .otherwise(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"),
                                                                  F.lit(True).alias("moved"))))).alias("e")).select("e.*")
        after = cut(small.groupBy("hi", "lo").agg(F.max("moved").alias("moved")))
        stars = after.select("hi", "lo")
        # all are stars unless a node is a member twice, or a member and a centre
        places = stars.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("n")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("n"))))
                              .alias("p")).select("p.*").groupBy("node").agg(F.sum("n").alias("n"), F.max(F.col("n") == 0).alias("centre"))
        if not after.agg(F.max("moved")).first()[0] or places.where((F.col("n") > 1) | ((F.col("n") > 0) & F.col("centre"))).isEmpty():
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    found = stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
    if loops.isEmpty():
        return found
    alone = loops.join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))
