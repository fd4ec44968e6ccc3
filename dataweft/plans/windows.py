"""Queries on numbering and per-group selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataweft.operators import recsys, rel
from dataweft.operators.clean import bucket
from dataweft.operators.ordering import top_per_group, with_row_id
from dataweft.plans.registry import half_even, query
from dataweft.sources.inputs import LISTING_KEY, articles, customers, listings, scored, transactions

KEY = ", ".join(LISTING_KEY[:4])
# Repeatable stand-in for a random order that both engines can compute.
SHUFFLE_SQL = "(CAST({0} AS BIGINT) * 7919) % 1009"


def shuffled(c: str):
    return (F.col(c).cast("bigint") * 7919) % 1009


@query("q_row_id", f"""
    SELECT {KEY}, CAST(row_number() OVER (ORDER BY dateCrawled, {', '.join(LISTING_KEY)}) AS BIGINT) AS id FROM listings""",
       inputs=("listings",))
def row_id(spark, d):
    return with_row_id(listings(spark, d).select("dateCrawled", *LISTING_KEY), ["dateCrawled", *LISTING_KEY]) \
        .select(*LISTING_KEY[:4], "id")


GROUP = recsys.ARTICLE_GROUP


@query("q_best_per_group", f"""
    SELECT {', '.join(GROUP)}, article_id, n AS transaction_count FROM
    (SELECT *, row_number() OVER (PARTITION BY {', '.join(GROUP)} ORDER BY n DESC, article_id) AS rn FROM
     (SELECT {', '.join(GROUP)}, article_id, CAST(count(*) AS BIGINT) AS n FROM transactions JOIN articles USING (article_id)
      GROUP BY ALL)) WHERE rn = 1""", inputs=("transactions", "articles"))
def best_per_group(spark, d):
    return recsys.best_sellers(transactions(spark, d), articles(spark, d))


AGE_SQL = """CASE WHEN age < 20 THEN '<20' WHEN age < 25 THEN '20-25' WHEN age < 30 THEN '25-30'
    WHEN age < 40 THEN '30-40' WHEN age < 50 THEN '40-50' ELSE '50+' END"""


def _grouped(spark, d):
    return customers(spark, d).select("customer_id", bucket("age", recsys.AGE_EDGES, recsys.AGE_LABELS).alias("age_group"))


@query("q_stratified_sizes", f"""
    SELECT age_group, CAST({half_even("count(*) * 0.9::DOUBLE")} AS BIGINT) AS n FROM
    (SELECT {AGE_SQL} AS age_group FROM customers) GROUP BY age_group""", inputs=("customers",))
def stratified_sizes(spark, d):
    """A seeded hash draw; only its sizes are fixed."""
    drawn = rel.stratified_sample(_grouped(spark, d), "age_group", 0.9, [F.xxhash64("customer_id", F.lit(1)), F.col("customer_id")])
    return drawn.groupBy("age_group").agg(F.count("*").alias("n"))


@query("q_stratified_sample", f"""
    SELECT customer_id, age_group FROM
    (SELECT customer_id, age_group, count(*) OVER (PARTITION BY age_group) AS size,
            row_number() OVER (PARTITION BY age_group ORDER BY {SHUFFLE_SQL.format("customer_id")}, customer_id) AS pos
     FROM (SELECT customer_id, {AGE_SQL} AS age_group FROM customers)) WHERE pos <= {half_even("size * 0.9::DOUBLE")}""",
       inputs=("customers",))
def stratified_sample(spark, d):
    return rel.stratified_sample(_grouped(spark, d), "age_group", 0.9, [shuffled("customer_id"), F.col("customer_id")])


LOO_SQL = f"""
    SELECT customer_id, article_id,
           row_number() OVER (PARTITION BY customer_id ORDER BY {SHUFFLE_SQL.format("article_id")}, article_id) = 1 AS is_test
    FROM (SELECT DISTINCT customer_id, article_id FROM transactions)"""


@query("q_loo_split", LOO_SQL, inputs=("transactions",))
def loo_split(spark, d):
    pairs = transactions(spark, d).select("customer_id", "article_id").distinct()
    train, test = recsys.leave_one_out(pairs, "customer_id", "article_id", order=[shuffled("article_id"), F.col("article_id")])
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query("q_topn_per_user", """
    SELECT user, item, score FROM
    (SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rn FROM scored) WHERE rn <= 12""".replace(
        "SELECT user,", 'SELECT "user",').replace("BY user", 'BY "user"'), inputs=("scored",))
def topn_per_user(spark, d):
    return top_per_group(scored(spark, d).select("user", "item", "score"), ["user"], [F.desc("score"), F.col("item")], 12)
