import random

import numpy as np
import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from dataweft.operators import graph

LINES = ["A|B", " A | B ", "A|B+", "A|B+ ", "A|B+]", "A||B", "|A", "A|", "A|B"]
EXPECTED = {
    "strict": [("A", "B"), ("A", "B+")],
    "loose": [("", "A"), ("A", "B"), ("A", "B"), ("A", "B"), ("A", "B"), ("A", "B"), ("A", "B+]")],
    "df": [("", "A"), ("A", ""), ("A", "B"), ("A", "B"), ("A", "B"), ("A", "B"), ("A", "B+"), ("A", "B+]")],
}


@pytest.mark.parametrize("mode", EXPECTED)
def test_parse_edges(spark, mode):
    df = spark.createDataFrame([(v,) for v in LINES], "value string")
    assert rows(graph.parse_edges(df, mode)) == EXPECTED[mode]


EDGES = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c")]


def ranks_by_hand(edges, iters):
    deg, rank = {}, {s: 1.0 for s, _ in edges}
    for s, _ in edges:
        deg[s] = deg.get(s, 0) + 1
    for _ in range(iters):
        c = {}
        for s, t in edges:
            if s in rank:
                c[t] = c.get(t, 0.0) + rank[s] / deg[s]
        rank = {p: 0.15 + 0.85 * v for p, v in c.items()}
    return rank


@pytest.mark.parametrize("iters", [1, 2, 7])
def test_pagerank_contract(spark, iters):
    got = {r.page: r["rank"] for r in graph.pagerank(spark.createDataFrame(EDGES, "src string, dst string"), iters).collect()}
    want = ranks_by_hand(EDGES, iters)
    assert got.keys() == want.keys() and all(np.isclose(got[p], want[p]) for p in want)
    if iters == 2:
        assert np.isclose(got["a"], 2.08375) and np.isclose(got["b"], 0.575) and np.isclose(got["c"], 1.06375)


def test_pagerank_splits_hubs_and_counts_duplicates(spark):
    rng = random.Random(2)
    edges = [("hub", f"n{i}") for i in range(200)] + [(f"n{rng.randrange(200)}", rng.choice(["hub", f"n{rng.randrange(200)}"])) for _ in range(300)]
    df = spark.createDataFrame(edges, "src string, dst string")
    for distinct, used in ((True, sorted(set(edges))), (False, edges)):
        want = ranks_by_hand(used, 4)
        for size in (7, 10**6):
            got = {r.page: r["rank"] for r in graph.pagerank(df, 4, distinct=distinct, slice_edges=size, cut_every=2).collect()}
            assert got.keys() == want.keys() and all(np.isclose(got[p], want[p]) for p in want)


def test_groups_do_not_mix_and_may_empty(spark):
    data = [("x", *e) for e in EDGES] + [("y", "p", "q"), ("y", "q", "r")]
    ranks = graph.pagerank(spark.createDataFrame(data, "lang string, src string, dst string"), 3, group=["lang"])
    assert {r.lang for r in ranks.collect()} == {"x"}  # the second graph has no cycle
    langs = spark.createDataFrame([("x",), ("y",)], "lang string")
    normal = graph.normalise(ranks, ["lang"]).persist()
    assert normal.agg(F.max("rank")).first()[0] == 1.0
    totals = graph.rank_by_group(normal, langs).collect()
    assert [(r.lang, round(r.total_rank, 6)) for r in totals][1] == ("y", 0.0)
    assert [r.page for r in graph.top_pages(normal, 1, ["lang"]).collect()] == ["a"] or ranks.count() == 3
    assert np.isclose(graph.normalise(ranks.drop("lang")).agg(F.max("rank")).first()[0], 1.0)


def test_rank_sum_is_bounded(spark):
    rng = random.Random(9)
    edges = sorted({(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(200)})
    ranks = graph.pagerank(spark.createDataFrame(edges, "src string, dst string"), 5)
    total, n = ranks.agg(F.sum("rank"), F.count("*")).first()
    assert total <= 40 + 1e-9 and n <= 40


def test_links_stay_in_place_between_rounds(spark, monkeypatch):
    seen = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (seen.append(plan(df)), cut(df))[1])
    graph.pagerank(spark.createDataFrame(EDGES * 50, "src string, dst string"), 2)
    last = seen[-1]
    scans = [line for line in last.splitlines() if "InMemoryTableScan" in line]
    assert len(scans) >= 2
    for i, line in enumerate(last.splitlines()):
        if "InMemoryTableScan" in line:
            above = last.splitlines()[max(0, i - 2):i]
            assert not any("Exchange hashpartitioning" in a for a in above)


def components_by_hand(edges):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        for x in (a, b):
            root.setdefault(x, x)
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "loops"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {"random": [(f"n{rng.randrange(120):03}", f"n{rng.randrange(120):03}") for _ in range(80)],
             "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in rng.sample(range(60), 60)],
             "star": [("z", f"n{i}") for i in range(50)] + [("z", "y")],
             "loops": [("a", "a"), ("b", "c"), ("c", "b")]}[shape]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == components_by_hand(edges)


@pytest.mark.parametrize("max_len", [10, 2])
def test_adjacency_parts(spark, max_len):
    out = graph.adjacency(spark.createDataFrame(EDGES, "src string, dst string"), max_len=max_len)
    assert rows(out.where("src = 'a'"), "part", "neighbours") == [(0, ["b", "c"])]
    assert rows(graph.out_degree(spark.createDataFrame(EDGES, "src string, dst string")))[0] == ("a", 2)


@pytest.fixture
def skew_settings(spark):
    """Small thresholds, no broadcast: joins of a hot key must show a split."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
                "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_keys_are_split(spark, skew_settings, monkeypatch):
    from dataweft.operators import rel
    df = spark.range(600_000).selectExpr("CASE WHEN id < 500000 THEN 0 ELSE id END AS k", "id")
    kept = rel.keep_active(df, "k", 2)
    assert kept.count() == 500_000
    kept.write.format("noop").mode("overwrite").save()
    split = kept.groupBy().agg(F.sum("id"))
    split.collect()
    assert "skew=true" in split._jdf.queryExecution().executedPlan().toString()
    plans = []
    real = graph.cut

    def cut(frame):
        out = real(frame)
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(graph, "cut", cut)
    star = spark.range(1, 300_000).selectExpr("0L AS src", "id AS dst")
    assert graph.connected_components(star).where("component <> 0").count() == 0
    assert any("skew=true" in p for p in plans)


def test_trees_need_no_round_to_be_sure(spark, monkeypatch):
    """Trees whose nodes are named from the root on are stars after one round, which another needn't confirm; nodes are not made distinct first."""
    cuts = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (cuts.append(df), cut(df))[1])
    edges = [(f"c{i % 4}", f"o{i}") for i in range(12)] + [(f"o{i}", f"x{i}-{j}") for i in range(12) for j in range(3)] + [("z", "z"), ("c0", "c0")]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == components_by_hand(edges) and len(cuts) == 3


def test_a_member_of_two_stars_is_not_the_end(spark):
    """After one round v belongs to the stars of a and b, of which neither belongs to another."""
    edges = [("w1", "v"), ("w1", "a"), ("w2", "v"), ("w2", "b")]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == components_by_hand(edges)
