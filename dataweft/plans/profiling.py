"""Queries on summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataweft.operators import profile, recsys
from dataweft.plans.cleaning import FILLED_CUSTOMERS_SQL, filled_customers
from dataweft.plans.registry import query
from dataweft.plans.relational import SHARE_SQL
from dataweft.session import work_path
from dataweft.sources.inputs import articles, customers, listings, table, transactions
from dataweft.sources.io import write_table


@query("q_counts", """
    SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(model) AS BIGINT) AS n_model, CAST(count(brand) AS BIGINT) AS n_brand,
           CAST(count(CASE WHEN model IS NULL AND vehicleType IS NULL THEN 1 END) AS BIGINT) AS n_unknown FROM listings""",
       inputs=("listings",))
def counts(spark, d):
    return listings(spark, d).agg(
        F.count("*").alias("n_rows"), F.count("model").alias("n_model"), F.count("brand").alias("n_brand"),
        F.count(F.when(F.col("model").isNull() & F.col("vehicleType").isNull(), 1)).alias("n_unknown"))


@query("q_price_summary", """
    SELECT CAST(count(price) AS BIGINT) AS n, min(price) AS min, max(price) AS max, avg(price) AS avg, median(price) AS median
    FROM listings WHERE price < 100000 AND price > 1000""", inputs=("listings",))
def price_summary(spark, d):
    return profile.numeric_summary(listings(spark, d), "price", (F.col("price") < 100_000) & (F.col("price") > 1000))


@query("q_price_by_type", """
    SELECT vehicleType, CAST(count(price) AS BIGINT) AS n, min(price) AS min, max(price) AS max, avg(price) AS avg,
           median(price) AS median FROM listings WHERE notRepairedDamage = 'ja' GROUP BY vehicleType""", inputs=("listings",))
def price_by_type(spark, d):
    return profile.grouped_summary(listings(spark, d), ["vehicleType"], "price", F.col("notRepairedDamage") == "ja")


SKETCH_ERROR = 0.01
FACTOR = (1 + SKETCH_ERROR) / (1 - SKETCH_ERROR)


@query("q_price_sketch", f"""
    SELECT vehicleType, CAST(max(total) AS BIGINT) AS n,
           round(max(CASE WHEN floor((total - 1) * 0.5) < cum AND floor((total - 1) * 0.5) >= cum - n THEN 2 * power({FACTOR!r}, bin) / {FACTOR + 1!r} END), 4) AS median,
           round(max(CASE WHEN floor((total - 1) * 0.9) < cum AND floor((total - 1) * 0.9) >= cum - n THEN 2 * power({FACTOR!r}, bin) / {FACTOR + 1!r} END), 4) AS q90
    FROM (SELECT *, sum(n) OVER (PARTITION BY vehicleType ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY vehicleType) AS total
          FROM (SELECT vehicleType, ceil(ln(CAST(price AS DOUBLE)) / ln({FACTOR!r})) AS bin, count(*) AS n FROM listings WHERE price > 0 GROUP BY ALL))
    GROUP BY vehicleType""", inputs=("listings",))
def price_sketch(spark, d):
    """Sketches of every day and type are written; those of the types are merged from them."""
    positive = listings(spark, d).where("price > 0")
    daily = write_table(profile.sketch(positive, ["dateCreated", "vehicleType"], "price", SKETCH_ERROR), work_path(spark, "sketches"))
    out = profile.sketch_quantiles(daily, ["vehicleType"], {"median": 0.5, "q90": 0.9}, SKETCH_ERROR)
    return out.select("vehicleType", "n", F.round("median", 4).alias("median"), F.round("q90", 4).alias("q90"))


@query("q_value_counts", """
    SELECT notRepairedDamage, CAST(count(*) AS BIGINT) AS n FROM listings GROUP BY notRepairedDamage""", inputs=("listings",))
def value_counts(spark, d):
    return profile.value_counts(listings(spark, d), "notRepairedDamage")


@query("q_value_share", "SELECT * FROM shares", inputs=("articles",), ctes={"shares": SHARE_SQL})
def value_share(spark, d):
    return profile.value_share(articles(spark, d), "product_type_name")


CUSTOMER_COLS = ["customer_id", "FN", "Active", "club_member_status", "fashion_news_frequency", "age", "postal_code"]


@query("q_nunique", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM customers" for c in CUSTOMER_COLS),
       inputs=("customers",))
def nunique(spark, d):
    return profile.nunique(customers(spark, d))


@query("q_missing_pct", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, (count(*) - count({c})) / count(*)::DOUBLE * 100 AS missing_pct FROM customers"
    for c in CUSTOMER_COLS), inputs=("customers",))
def missing_pct(spark, d):
    return profile.missing_pct(customers(spark, d))


NUMERIC = ["price", "kilometer", "powerPS"]


@query("q_describe_num", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS n, avg({c}) AS mean, round(stddev_samp({c}), 4) AS std,
           CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, quantile_cont({c}, 0.25)::DOUBLE AS q25,
           quantile_cont({c}, 0.5)::DOUBLE AS q50, quantile_cont({c}, 0.75)::DOUBLE AS q75 FROM listings""" for c in NUMERIC),
       inputs=("listings",))
def describe_num(spark, d):
    return profile.describe_num(listings(spark, d), NUMERIC).withColumn("std", F.round("std", 4))


CATEGORIES = ["product_type_name", "product_group_name", "perceived_colour_value_name", "detail_desc"]


@query("q_describe_cat", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, (SELECT CAST(count({c}) AS BIGINT) FROM articles) AS n,
           (SELECT CAST(count(DISTINCT {c}) AS BIGINT) FROM articles) AS n_distinct, v AS top, c AS freq
    FROM (SELECT {c} AS v, CAST(count(*) AS BIGINT) AS c FROM articles WHERE {c} IS NOT NULL GROUP BY 1
          ORDER BY c DESC, v LIMIT 1)""" for c in CATEGORIES), inputs=("articles",))
def describe_cat(spark, d):
    return profile.describe_cat(articles(spark, d), CATEGORIES)


@query("q_corr", """
    SELECT 'FN_Code~news_Code' AS column_name, round(corr(a, n), 6) AS corr FROM coded
    UNION ALL SELECT 'FN_Code~club_Code', round(corr(a, c), 6) FROM coded""",
       inputs=("customers",), ctes={"filled": FILLED_CUSTOMERS_SQL, "coded": """
    SELECT CAST(dense_rank() OVER (ORDER BY FN) AS DOUBLE) AS a, CAST(dense_rank() OVER (ORDER BY fashion_news_frequency) AS DOUBLE) AS n,
           CAST(dense_rank() OVER (ORDER BY club_member_status) AS DOUBLE) AS c FROM filled"""})
def corr(spark, d):
    from dataweft.operators.clean import category_codes
    df = filled_customers(spark, d).select("FN", F.col("fashion_news_frequency").alias("news"), F.col("club_member_status").alias("club"))
    coded = category_codes(df, ["FN", "news", "club"])
    return profile.correlations(coded, [("FN_Code", "news_Code"), ("FN_Code", "club_Code")]).withColumn("corr", F.round("corr", 6))


@query("q_date_span", "SELECT min(t_dat)::VARCHAR AS first, max(t_dat)::VARCHAR AS last FROM transactions", inputs=("transactions",))
def date_span(spark, d):
    span = profile.date_span(transactions(spark, d), "t_dat")
    return span.select(F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


RECENCY_SQL = """
    SELECT customer_id, min(t_dat) AS t_dat_min, max(t_dat) AS t_dat_max, CAST(count(DISTINCT t_dat) AS INTEGER) AS ct_carts
    FROM transactions GROUP BY customer_id"""
PRICE_SQL = """
    SELECT customer_id, CAST(min(price) AS DOUBLE) AS price_min, CAST(sum(price) AS DOUBLE) / count(*) AS price_mean,
           CAST(max(price) AS DOUBLE) AS price_max FROM transactions GROUP BY customer_id"""
BASKET_SQL = """
    SELECT customer_id, CAST(min(v) AS DOUBLE) AS cart_value_min, CAST(sum(v) AS DOUBLE) / count(*) AS cart_value_mean,
           CAST(max(v) AS DOUBLE) AS cart_value_max
    FROM (SELECT customer_id, t_dat, sum(price) AS v FROM transactions GROUP BY 1, 2) GROUP BY customer_id"""


@query("q_customer_recency", """
    SELECT customer_id, t_dat_min::VARCHAR AS t_dat_min, t_dat_max::VARCHAR AS t_dat_max, coalesce(ct_carts, 0) AS ct_carts
    FROM customers LEFT JOIN recency USING (customer_id)""", inputs=("transactions", "customers"), ctes={"recency": RECENCY_SQL})
def customer_recency(spark, d):
    out = customers(spark, d).select("customer_id").join(recsys.customer_recency(transactions(spark, d)), "customer_id", "left")
    return out.select("customer_id", F.col("t_dat_min").cast("string").alias("t_dat_min"),
                      F.col("t_dat_max").cast("string").alias("t_dat_max"), F.coalesce("ct_carts", F.lit(0)).alias("ct_carts"))


@query("q_price_stats", PRICE_SQL, inputs=("transactions",))
def price_stats(spark, d):
    return recsys.price_stats(transactions(spark, d))


@query("q_basket_stats", BASKET_SQL, inputs=("transactions",))
def basket_stats(spark, d):
    return recsys.basket_stats(transactions(spark, d))


@query("q_group_sizes", """
    SELECT index_group_name, garment_group_name, detail_desc, CAST(count(*) AS BIGINT) AS n FROM articles
    WHERE detail_desc IS NOT NULL GROUP BY ALL""", inputs=("articles",))
def group_sizes(spark, d):
    return profile.group_sizes(articles(spark, d), ["index_group_name", "garment_group_name", "detail_desc"])


@query("q_postal_count", "SELECT CAST(count(DISTINCT postalCode) AS BIGINT) AS n FROM listings", inputs=("listings",))
def postal_count(spark, d):
    return listings(spark, d).agg(F.countDistinct("postalCode").alias("n"))


@query("q_event_value_summary", """
    SELECT event_type, CAST(count(value) AS BIGINT) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg,
           round(median(value), 6) AS median FROM events GROUP BY event_type""")
def event_value_summary(spark, d):
    out = profile.grouped_summary(table(spark, d, "events"), ["event_type"], "value")
    return out.withColumns({"avg": F.round("avg", 6), "median": F.round("median", 6)})
