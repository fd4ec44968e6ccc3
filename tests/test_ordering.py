import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from dataweft.operators.ordering import (exact_quantiles, running_total, top_per_group, with_group_position, with_row_id)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key, another third are copies of one value."""
    rng = random.Random(5)
    data = [(("hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randrange(9)}"), 7 if i % 3 == 1 else rng.randrange(100), i)
            for i in range(3000)]
    return data, spark.createDataFrame(data, "k string, v int, id int").repartition(7).persist()


def test_row_id_counts_all_rows_in_order(skewed):
    data, df = skewed
    got = rows(with_row_id(df, ["v", "id"], "n"), "n", "v", "id")
    want = [(i + 1, v, n) for i, (v, n) in enumerate(sorted((v, n) for _, v, n in data))]
    assert got == want


def test_row_id_of_no_rows(spark):
    assert with_row_id(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_group_position_splits_a_hot_group(skewed):
    data, df = skewed
    got = with_group_position(df, ["k"], [F.desc("v"), F.col("id")], "pos", "size").collect()
    by = {}
    for k, v, i in data:
        by.setdefault(k, []).append((-v, i))
    want = {(k, i): (p + 1, len(g)) for k, g in by.items() for p, (_, i) in enumerate(sorted(g))}
    assert {(r.k, r.id): (r.pos, r["size"]) for r in got} == want


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_total(skewed, keys):
    data, df = skewed
    got = {r.id: r.run for r in running_total(df, keys, ["v", "id"], "v", "run").collect()}
    sums, want = {}, {}
    for k, v, i in sorted(data, key=lambda t: (t[1], t[2])):
        g = k if keys else 0
        sums[g] = sums.get(g, 0) + v
        want[i] = sums[g]
    assert got == want


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_equal_numpy(skewed, keys):
    data, df = skewed
    holed = df.withColumn("v", F.nullif("v", F.lit(50)))
    got = exact_quantiles(holed, keys, "v", {"a": .1, "q": .25, "m": .5, "z": 1.0}).collect()
    by = {}
    for k, v, _ in data:
        if v != 50:
            by.setdefault(k if keys else 0, []).append(v)
    assert len(got) == len(by)
    for r in got:
        values = by[r.k if keys else 0]
        assert np.allclose([r.a, r.q, r.m, r.z], np.percentile(values, [10, 25, 50, 100]))


def test_top_per_group_breaks_ties_by_order(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "w"), ("a", 0, "z"), ("b", 5, "q")], "k string, s int, i string")
    assert rows(top_per_group(df, ["k"], [F.desc("s"), F.col("i")], 1), "k", "i") == [("a", "w"), ("b", "q")]


def test_copies_of_one_row_are_split(spark):
    from dataweft.operators.ordering import _ranged
    df = spark.range(4000, numPartitions=8).select(F.lit("same").alias("k"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in _ranged(df, [F.col("k"), F.col("v")]).groupBy("_task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 4000 and max(sizes) <= 2000
    assert rows(with_group_position(df, ["k"], ["v"], "p"), "p") == [(i + 1,) for i in range(4000)]
