"""Every named query against its SQL counterpart, and the plans of the queries that must scale."""

import duckdb
import pytest
from conftest import DATA, plan

from dataweft.plans import relational
from dataweft.plans.registry import load
from dataweft.session import work_path
from dataweft.sources import inputs, io

QUERIES, ORACLES = load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


#: Metrics of fitted models: tests of the losses stand in test_ranking.
NO_SQL = {"q_ranking_grid"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) | NO_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got, cols = df.collect(), df.columns
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(names)
    order = sorted(cols)
    a = sorted(tuple(repr(r[c]) for c in order) for r in got)
    b = sorted(tuple(repr(r[names.index(c)]) for c in order) for r in cur.fetchall())
    assert len(a) > 0 and a == b


def test_facts_are_read_once(spark, monkeypatch):
    """The whole preparation scans the order lines in one of its plans only."""
    from dataweft import session
    from dataweft.operators import clean, ordering, recsys
    seen, real = [], session.cut

    def cut(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    for module in (recsys, ordering, clean):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", cut)
    out = QUERIES["q_reco_prepared"](spark, DATA)
    seen.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("l_extendedprice") > 0 for p in seen) == 1


LIGHT = ["q_project", "q_filter_range", "q_left_enrich", "q_brand_year_damage", "q_customer_features", "q_best_per_group",
         "q_topn_per_user", "q_loo_split", "q_impute_mean", "q_value_share", "q_exclude_yearly", "q_recent_items", "q_null_counts",
         "q_dedupe_key", "q_describe_cat", "q_chat_reply", "q_out_degree", "q_merge_full", "q_interaction_shape", "q_overlap_pct"]


@pytest.mark.parametrize("name", LIGHT)
def test_no_cross_join_and_no_single_task_window(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not ("Window" in text and "Exchange SinglePartition" in text)


def test_filters_and_columns_reach_the_scan(spark):
    text = QUERIES["q_brand_year_damage"](spark, DATA)._jdf.queryExecution().toString()
    scans = [line for line in text.splitlines() if "FileScan" in line]
    line_scan = next(s for s in scans if "l_extendedprice" in s)
    assert "l_tax" not in line_scan and "l_shipdate" not in line_scan
    stored = io.write_table(relational.repaired(spark, DATA).select(*relational.REPORT_COLS), work_path(spark, "stored"))
    text = relational.brand_year_damage_report(stored)._jdf.queryExecution().toString()
    assert "In(brand, [Brand#2,Brand#3,Brand#4])" in text
    assert "PushedFilters" in text and "fuelType" not in next(line for line in text.splitlines() if "FileScan" in line)
    kept = inputs.table(spark, DATA, "lineitem").where("l_quantity > 10").select("l_orderkey")
    assert "GreaterThan(l_quantity,10.0)" in kept._jdf.queryExecution().toString()


def test_ranking_is_cut_before_the_shuffle(spark):
    text = plan(QUERIES["q_topn_per_user"](spark, DATA))
    assert "WindowGroupLimit" in text and "Partial" in text
