"""Queries on link lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataweft.operators import graph
from dataweft.plans.registry import query
from dataweft.sources.inputs import edge_lines, edges, table, tree_edges

TRIM = r"regexp_replace({0}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
LINE = TRIM.format("value")
STRICT_SQL = f"""
    SELECT DISTINCT p[1] AS src, p[2] AS dst FROM
    (SELECT [y FOR y IN [{TRIM.format('x')} FOR x IN string_split(replace({LINE}, '+]', ''), '|')] IF y <> ''] AS p
     FROM edge_lines) WHERE len(p) = 2"""


def _counted(spark, d, mode):
    return graph.parse_edges(edge_lines(spark, d), mode).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("q_parse_edges_strict", "SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM parsed GROUP BY src, dst",
       inputs=("edge_lines",), ctes={"parsed": STRICT_SQL})
def parse_edges_strict(spark, d):
    return _counted(spark, d, "strict")


@query("q_parse_edges_loose", f"""
    SELECT p[1] AS src, p[2] AS dst, CAST(count(*) AS BIGINT) AS n FROM
    (SELECT [{TRIM.format('x')} FOR x IN string_split(regexp_replace(regexp_replace({LINE}, '\\+$', ''), '\\|+$', ''), '|')] AS p
     FROM edge_lines) WHERE len(p) = 2 GROUP BY ALL""", inputs=("edge_lines",))
def parse_edges_loose(spark, d):
    return _counted(spark, d, "loose")


@query("q_parse_edges_df", """
    SELECT trim(p[1]) AS src, trim(p[2]) AS dst, CAST(count(*) AS BIGINT) AS n FROM
    (SELECT string_split(regexp_replace(value, '\\+$', ''), '|') AS p FROM edge_lines) WHERE len(p) = 2 GROUP BY ALL""",
       inputs=("edge_lines",))
def parse_edges_df(spark, d):
    return _counted(spark, d, "df")


@query("q_out_degree", "SELECT lang, src, CAST(count(*) AS BIGINT) AS degree FROM edges GROUP BY lang, src", inputs=("edges",))
def out_degree(spark, d):
    return graph.out_degree(edges(spark, d), ["lang"])


@query("q_links_count", "SELECT lang, CAST(count(DISTINCT src) AS BIGINT) AS n FROM edges GROUP BY lang", inputs=("edges",))
def links_count(spark, d):
    return graph.out_degree(edges(spark, d), ["lang"]).groupBy("lang").agg(F.count("*").alias("n"))


@query("q_adjacency", """
    SELECT lang, src, CAST(0 AS BIGINT) AS part, string_agg(dst, ',' ORDER BY dst) AS neighbours
    FROM (SELECT DISTINCT lang, src, dst FROM edges) GROUP BY lang, src""", inputs=("edges",))
def adjacency(spark, d):
    out = graph.adjacency(edges(spark, d).distinct(), ["lang"])
    return out.withColumn("neighbours", F.array_join("neighbours", ","))


def _rounds(n: int, distinct: bool = True) -> dict[str, str]:
    """Common table expressions r0..rn of the unrolled iteration."""
    times = "1" if distinct else "count(*)"
    ctes = {"links": f"SELECT lang, src, dst, {times} AS times FROM edges GROUP BY lang, src, dst",
            "degrees": "SELECT lang, src, sum(times) AS degree FROM links GROUP BY lang, src",
            "r0": "SELECT lang, src AS page, 1.0::DOUBLE AS rank FROM degrees"}
    for i in range(1, n + 1):
        ctes[f"r{i}"] = f"""SELECT l.lang, l.dst AS page, 0.15 + 0.85 * sum(r.rank / g.degree * l.times) AS rank
            FROM links l JOIN r{i - 1} r ON l.lang = r.lang AND l.src = r.page
            JOIN degrees g ON l.lang = g.lang AND l.src = g.src GROUP BY l.lang, l.dst"""
    return ctes


def _ranks(spark, d, iters=10, distinct=True):
    return graph.pagerank(edges(spark, d), iters, group=["lang"], distinct=distinct)


RANK_SQL = "SELECT lang, page, round(rank, 6) AS rank FROM r{0}"


@query("q_pagerank_1", RANK_SQL.format(1), inputs=("edges",), ctes=_rounds(1))
def pagerank_1(spark, d):
    return _ranks(spark, d, 1).withColumn("rank", F.round("rank", 6))


@query("q_pagerank_10", "SELECT page, round(rank, 6) AS rank FROM r10", inputs=("edges",), ctes={
    **{k: v.replace("l.lang = r.lang AND ", "").replace("l.lang = g.lang AND ", "").replace("l.lang, ", "").replace("lang, ", "")
       for k, v in _rounds(10).items()}})
def pagerank_10(spark, d):
    """All links as one graph."""
    ranks = graph.pagerank(edges(spark, d).select("src", "dst"), 10)
    return ranks.withColumn("rank", F.round("rank", 6))


@query("q_pagerank_lang", RANK_SQL.format(10), inputs=("edges",), ctes=_rounds(10))
def pagerank_lang(spark, d):
    return _ranks(spark, d).withColumn("rank", F.round("rank", 6))


@query("q_pagerank_duplicates", RANK_SQL.format(10), inputs=("edges",), ctes=_rounds(10, distinct=False))
def pagerank_duplicates(spark, d):
    return _ranks(spark, d, distinct=False).withColumn("rank", F.round("rank", 6))


NORMAL = {"normal": "SELECT lang, page, rank / max(rank) OVER (PARTITION BY lang) AS rank FROM r10"}


@query("q_rank_normalised", "SELECT lang, page, round(rank, 6) AS rank FROM normal", inputs=("edges",), ctes={**_rounds(10), **NORMAL})
def rank_normalised(spark, d):
    return graph.normalise(_ranks(spark, d), ["lang"]).withColumn("rank", F.round("rank", 6))


@query("q_top_pages", """
    SELECT lang, page, round(rank, 5) AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rank DESC, page) AS rn FROM normal) WHERE rn <= 15""",
       inputs=("edges",), ctes={**_rounds(10), **NORMAL})
def top_pages(spark, d):
    top = graph.top_pages(graph.normalise(_ranks(spark, d), ["lang"]), 15, ["lang"])
    return top.withColumn("rank", F.round("rank", 5))


@query("q_rank_by_lang", """
    SELECT g.lang, round(coalesce(sum(rank), 0), 5) AS total_rank
    FROM (SELECT DISTINCT lang FROM edges UNION SELECT DISTINCT o_orderstatus FROM orders) g
    LEFT JOIN normal n ON g.lang = n.lang GROUP BY g.lang""", inputs=("edges",), ctes={**_rounds(10), **NORMAL})
def rank_by_lang(spark, d):
    """Order states serve as further languages; one of them has no pages."""
    langs = edges(spark, d).select("lang").union(table(spark, d, "orders").select("o_orderstatus"))
    totals = graph.rank_by_group(graph.normalise(_ranks(spark, d), ["lang"]), langs)
    return totals.withColumn("total_rank", F.round("total_rank", 5))


COMPONENTS = {
    "both_ways": "SELECT src AS a, dst AS b FROM tree_edges UNION SELECT dst, src FROM tree_edges",
    "reach": "SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.seen = e.a",
    "components": "SELECT node, min(seen) AS component FROM reach GROUP BY node"}


@query("q_components", "SELECT node, component FROM components", inputs=("tree_edges",), ctes=COMPONENTS)
def components(spark, d):
    return graph.connected_components(tree_edges(spark, d))


@query("q_component_sizes", "SELECT component, CAST(count(*) AS BIGINT) AS n FROM components GROUP BY component",
       inputs=("tree_edges",), ctes=COMPONENTS)
def component_sizes(spark, d):
    return graph.connected_components(tree_edges(spark, d)).groupBy("component").agg(F.count("*").alias("n"))
