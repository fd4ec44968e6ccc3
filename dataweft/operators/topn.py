"""Exact best items of every user that skips blocks of items by their length.

Items stand in blocks by the length of their vectors, longest first. No score exceeds the product of both lengths, so once a user's
n-th score exceeds the user's length times that of a block's first item, this block and all after it are skipped.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataweft.operators.ordering import top_per_group, with_row_id
from dataweft.operators.recsys import best_items
from dataweft.session import cut

#: Blocks of items at most; their bounds are held by the driver, one number each.
MOST_BLOCKS = 65_536


class Pruned(NamedTuple):
    """``recs`` (user, item, score) and ``met`` (user, blocks): the number of item blocks that a user was compared with."""
    recs: DataFrame
    met: DataFrame


def length(vec: str) -> Column:
    return F.sqrt(F.aggregate(F.col(vec).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))


def recommend_pruned(user_vecs: DataFrame, item_vecs: DataFrame, n: int, known: DataFrame | None = None, block: int = 1024, user_block: int = 4096) -> Pruned:
    """The ``n`` best items of each user, as ``recommend`` gives them.

    Rounds look at 1, 1, 2, 4, ... blocks. After each, a user whose n-th score can't be reached any more leaves; inside a round a user only
    goes to the blocks that are long enough. Blocks of a round meet in cells of a user block and an item block.
    """
    items = cut(item_vecs.select("item", "vec", length("vec").alias("_size")))
    users = cut(user_vecs.select("user", "vec", length("vec").alias("_size")))
    n_items, n_users = items.count(), users.count()
    block = max(block, math.ceil(n_items / MOST_BLOCKS))
    placed = cut(with_row_id(items, [F.desc("_size"), "item"], "_row").withColumn("_rb", F.floor((F.col("_row") - 1) / block).cast("int")).drop("_row"))
    heads = placed.groupBy("_rb").agg(F.max("_size").alias("_longest"))
    longest = [r["_longest"] for r in heads.orderBy("_rb").collect()]  # at most MOST_BLOCKS numbers
    n_blocks, n_cells = len(longest), max(1, math.ceil(n_users / user_block))
    near = None
    if known is not None:
        pairs = known.select("user", "item").distinct().join(placed.select("item", "_rb"), "item")
        near = cut(pairs.groupBy("user", "_rb").agg(F.collect_list("item").alias("_known")))
    users = users.withColumns({"_lb": F.pmod(F.xxhash64("user"), F.lit(n_cells)).cast("int"), "_nth": F.lit(float("-inf"))})
    recs = users.sparkSession.createDataFrame([], "user bigint, item bigint, score double")
    met = users.select("user", F.lit(0).cast("long").alias("blocks"))
    first = 0
    while first < n_blocks:
        last = min(n_blocks, max(1, 2 * first)) - 1
        bound = heads.where(F.col("_rb").between(first, last))
        to = users.withColumn("_rb", F.explode(F.sequence(F.lit(first), F.lit(last)))).join(bound, "_rb")
        # A score that equals the n-th may win by its id, so only smaller bounds are skipped; the slack covers rounding.
        to = cut(to.where(F.col("_longest") * F.col("_size") * (1 + 1e-9) >= F.col("_nth")).select("user", "vec", "_lb", "_rb"))
        met = met.unionByName(to.groupBy("user").agg(F.count("*").alias("blocks")))
        if near is not None:
            to = to.join(near, ["user", "_rb"], "left")
        goods = placed.where(F.col("_rb").between(first, last)).select("item", "vec", "_rb", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))).alias("_lb"))
        goods = goods.join(to.select("_lb", "_rb").distinct(), ["_lb", "_rb"], "left_semi")
        found = to.groupBy("_lb", "_rb").cogroup(goods.groupBy("_lb", "_rb")).applyInPandas(best_items(n), "user bigint, item bigint, score double")
        recs = cut(top_per_group(recs.unionByName(found), ["user"], [F.desc("score"), F.col("item")], n))
        first = last + 1
        if first < n_blocks:
            nth = recs.groupBy("user").agg(F.when(F.count("*") >= n, F.min("score")).otherwise(float("-inf")).alias("_nth"))
            users = users.drop("_nth").join(nth, "user", "left").withColumn("_nth", F.coalesce("_nth", F.lit(float("-inf"))))
            users = cut(users.where(F.col("_size") * longest[first] * (1 + 1e-9) >= F.col("_nth")))
            if users.isEmpty():
                break
    return Pruned(recs, met.groupBy("user").agg(F.sum("blocks").alias("blocks")))
