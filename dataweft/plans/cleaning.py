"""Queries on projections, filters, value clean-up and constraints."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from dataweft.operators import clean, quality, recsys
from dataweft.plans.registry import query
from dataweft.session import work_path
from dataweft.sources import io
from dataweft.sources.inputs import articles, customers, edges, listings, transactions

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEYS = KEY.split(", ")


@query("q_project", f"""
    SELECT {KEY}, price, vehicleType AS vehiculeType, 'web' AS channel, price * 2 AS double_price FROM listings""", inputs=("listings",))
def project(spark, d):
    return (listings(spark, d).withColumnRenamed("vehicleType", "vehiculeType")
            .select(*KEYS, "price", "vehiculeType", F.lit("web").alias("channel"), (F.col("price") * 2).alias("double_price")))


@query("q_drop_cols", "SELECT customer_id, club_member_status, fashion_news_frequency, age FROM customers", inputs=("customers",))
def drop_cols(spark, d):
    return customers(spark, d).drop("FN", "Active", "postal_code")


@query("q_cast", """
    SELECT customer_id, CAST(FN AS INTEGER) AS "FN", CAST(age AS INTEGER) AS age, CAST(postal_code AS INTEGER) AS postal_code
    FROM customers""", inputs=("customers",))
def cast(spark, d):
    return clean.cast_cols(customers(spark, d).select("customer_id", "FN", "age", "postal_code"),
                           {"FN": "int", "age": "int", "postal_code": "int"})


@query("q_filter_nulls", f"""
    SELECT {KEY}, brand, vehicleType, model FROM listings
    WHERE (model IS NULL AND vehicleType IS NULL) OR NOT (brand IS NOT NULL)""", inputs=("listings",))
def filter_nulls(spark, d):
    no_kind = F.col("model").isNull() & F.col("vehicleType").isNull()
    return listings(spark, d).where(no_kind | ~F.col("brand").isNotNull()).select(*KEYS, "brand", "vehicleType", "model")


@query("q_filter_range", f"""
    SELECT {KEY}, price, yearOfRegistration, brand FROM listings
    WHERE price < 50000 AND price > 1000 AND yearOfRegistration BETWEEN 1996 AND 1998 AND brand IN ('Brand#2', 'Brand#5')""",
       inputs=("listings",))
def filter_range(spark, d):
    return (listings(spark, d)
            .where((F.col("price") < 50000) & (F.col("price") > 1000) & F.col("yearOfRegistration").between(1996, 1998)
                   & F.col("brand").isin("Brand#2", "Brand#5"))
            .select(*KEYS, "price", "yearOfRegistration", "brand"))


@query("q_filter_precedence", """
    SELECT CAST(count(CASE WHEN yearOfRegistration > 2000 OR yearOfRegistration < 1996
                            AND (model IS NULL OR vehicleType IS NULL) THEN yearOfRegistration END) AS BIGINT) AS n_written,
           CAST(count(CASE WHEN (yearOfRegistration > 2000 OR yearOfRegistration < 1996)
                            AND (model IS NULL OR vehicleType IS NULL) THEN yearOfRegistration END) AS BIGINT) AS n_meant
    FROM listings""", inputs=("listings",))
def filter_precedence(spark, d):
    year = F.col("yearOfRegistration")
    late, early = year > 2000, year < 1996
    gap = F.col("model").isNull() | F.col("vehicleType").isNull()
    return listings(spark, d).agg(F.count(F.when(late | (early & gap), year)).alias("n_written"),
                                  F.count(F.when((late | early) & gap, year)).alias("n_meant"))


@query("q_drop_sentinels", """
    SELECT article_id, perceived_colour_value_name, detail_desc FROM articles
    WHERE perceived_colour_value_name IS DISTINCT FROM 'Unknown' AND perceived_colour_value_name IS DISTINCT FROM 'Undefined'
      AND detail_desc IS DISTINCT FROM 'red widget'""", inputs=("articles",))
def drop_sentinels(spark, d):
    kept = clean.drop_sentinels(articles(spark, d), {"perceived_colour_value_name": ["Unknown", "Undefined"],
                                                     "detail_desc": ["red widget"]})
    return kept.select("article_id", "perceived_colour_value_name", "detail_desc")


FILLED_CUSTOMERS_SQL = """
    SELECT customer_id, coalesce(FN, 0) AS FN, Active, coalesce(club_member_status, 'None') AS club_member_status,
           coalesce(CASE WHEN fashion_news_frequency = 'NONE' THEN 'None' ELSE fashion_news_frequency END, 'None')
             AS fashion_news_frequency, age, postal_code
    FROM customers"""


def filled_customers(spark, d):
    return recsys.fill_customers(customers(spark, d))


@query("q_keep_any_flag", """
    SELECT 'filled' AS state, customer_id FROM filled WHERE fashion_news_frequency <> 'None' OR club_member_status <> 'None'
    UNION ALL SELECT 'raw', customer_id FROM customers
    WHERE fashion_news_frequency IS DISTINCT FROM 'NONE' OR club_member_status IS DISTINCT FROM 'ACTIVE'""",
       inputs=("customers",), ctes={"filled": FILLED_CUSTOMERS_SQL})
def keep_any_flag(spark, d):
    """Once on filled flags and once on flags with gaps, where a gap keeps its row."""
    flags = ["fashion_news_frequency", "club_member_status"]
    filled = clean.keep_any(filled_customers(spark, d), flags)
    people = customers(spark, d)
    raw = clean.keep_any(people.withColumn("club_member_status", F.when(F.col("club_member_status") == "ACTIVE", "NONE").otherwise(F.col("club_member_status"))), flags, "NONE")
    return filled.select(F.lit("filled").alias("state"), "customer_id").unionByName(raw.select(F.lit("raw").alias("state"), "customer_id"))


@query("q_dropna", f"""
    SELECT {KEY}, model, brand FROM listings WHERE model IS NOT NULL AND brand IS NOT NULL""", inputs=("listings",))
def dropna(spark, d):
    return clean.drop_null_keys(listings(spark, d), ["model", "brand"]).select(*KEYS, "model", "brand")


@query("q_fill_const", "SELECT article_id, coalesce(detail_desc, 'Not Available') AS detail_desc FROM articles", inputs=("articles",))
def fill_const(spark, d):
    return clean.fill(articles(spark, d), {"detail_desc": "Not Available"}).select("article_id", "detail_desc")


@query("q_replace", """
    SELECT customer_id, CASE WHEN fashion_news_frequency = 'NONE' THEN 'None' ELSE fashion_news_frequency END
           AS fashion_news_frequency FROM customers""", inputs=("customers",))
def replace(spark, d):
    return clean.replace_values(customers(spark, d), "fashion_news_frequency", {"NONE": "None"}) \
        .select("customer_id", "fashion_news_frequency")


@query("q_impute_mean", """
    SELECT customer_id, CAST(trunc(coalesce(age, (SELECT avg(age) FROM customers))) AS INTEGER) AS age FROM customers""",
       inputs=("customers",))
def impute_mean(spark, d):
    return clean.impute_mean(customers(spark, d).select("customer_id", "age"), "age")


@query("q_dedupe", "SELECT DISTINCT lang, src, dst FROM edges", inputs=("edges",))
def dedupe(spark, d):
    return clean.dedupe(edges(spark, d))


@query("q_dedupe_key", """
    SELECT customer_id, CAST(min(t_dat) AS VARCHAR) AS t_dat,
           arg_min(article_id, struct_pack(a := t_dat, b := article_id, c := price)) AS article_id
    FROM transactions GROUP BY customer_id""", inputs=("transactions",))
def dedupe_key(spark, d):
    kept = clean.dedupe(transactions(spark, d), ["customer_id"], order=["t_dat", "article_id", "price"])
    return kept.select("customer_id", F.col("t_dat").cast("string").alias("t_dat"), "article_id")


ONE_OFF = (date(1998, 3, 15), date(1998, 5, 15))


@query("q_exclude_window", """
    SELECT CAST(t_dat AS VARCHAR) AS t_dat, CAST(count(*) AS BIGINT) AS n FROM transactions
    WHERE t_dat < DATE '1998-03-15' OR t_dat > DATE '1998-05-15' GROUP BY t_dat""", inputs=("transactions",))
def exclude_window(spark, d):
    kept = clean.exclude_window(transactions(spark, d), "t_dat", *ONE_OFF)
    return kept.groupBy(F.col("t_dat").cast("string").alias("t_dat")).agg(F.count("*").alias("n"))


def _yearly_sql(cmp: str) -> str:
    return f"""
    SELECT CAST(t_dat AS VARCHAR) AS t_dat, CAST(count(*) AS BIGINT) AS n FROM transactions
    WHERE NOT (month(t_dat) = 12 AND day(t_dat) BETWEEN 10 AND 25)
      AND year(t_dat) {cmp} (SELECT year(max(t_dat)) FROM transactions) GROUP BY t_dat"""


def _yearly(spark, d, keep):
    kept = clean.exclude_yearly(transactions(spark, d), "t_dat", (12, 10), (12, 25), keep_last_year=keep)
    return kept.groupBy(F.col("t_dat").cast("string").alias("t_dat")).agg(F.count("*").alias("n"))


@query("q_exclude_yearly", _yearly_sql("<"), inputs=("transactions",))
def exclude_yearly(spark, d):
    return _yearly(spark, d, False)


@query("q_exclude_yearly_keep", _yearly_sql("<="), inputs=("transactions",))
def exclude_yearly_keep(spark, d):
    return _yearly(spark, d, True)




@query("q_age_group", """
    SELECT customer_id, CASE WHEN age < 20 THEN '<20' WHEN age < 25 THEN '20-25' WHEN age < 30 THEN '25-30'
           WHEN age < 40 THEN '30-40' WHEN age < 50 THEN '40-50' ELSE '50+' END AS age_group FROM customers""", inputs=("customers",))
def age_group(spark, d):
    return customers(spark, d).select("customer_id", clean.bucket("age", recsys.AGE_EDGES, recsys.AGE_LABELS).alias("age_group"))


POWER_SQL = "CASE " + " ".join(f"WHEN {{0}} < {v} THEN {v}" for v in range(2000, 20000, 2000)) + " ELSE 20000 END"


@query("q_power_bucket", f"""
    SELECT {KEY}, {POWER_SQL.format("p")} AS power FROM (SELECT *, nullif(powerPS, 4000) AS p FROM listings)""",
       inputs=("listings",))
def power_bucket(spark, d):
    df = listings(spark, d).withColumn("powerPS", F.nullif("powerPS", F.lit(4000)))
    return df.select(*KEYS, clean.ceil_bucket("powerPS", 2000, 20000).alias("power"))


@query("q_histogram", """
    SELECT CAST(i AS DOUBLE) AS bin_from, CAST(i + 1 AS DOUBLE) AS bin_to,
           (SELECT CAST(count(*) AS BIGINT) FROM lineitem WHERE l_discount * 100 >= i AND l_discount * 100 < i + 1) AS n
    FROM range(0, 11) t(i)""")
def histogram(spark, d):
    from dataweft.sources.inputs import table
    scaled = table(spark, d, "lineitem").select((F.col("l_discount") * 100).alias("v"))
    return clean.histogram(scaled, "v", range(12))


@query("q_category_codes", """
    SELECT customer_id,
           CAST(coalesce((SELECT count(DISTINCT b.club_member_status) FROM customers b
             WHERE b.club_member_status < a.club_member_status) + CASE WHEN a.club_member_status IS NULL THEN -1 ELSE 0 END, -1)
             AS INTEGER) AS club_member_status_code,
           CAST(CASE WHEN a.fashion_news_frequency IS NULL THEN -1 ELSE (SELECT count(DISTINCT b.fashion_news_frequency)
             FROM customers b WHERE b.fashion_news_frequency < a.fashion_news_frequency) END AS INTEGER)
             AS fashion_news_frequency_code
    FROM customers a""", inputs=("customers",))
def category_codes(spark, d):
    df = customers(spark, d).select("customer_id", "club_member_status", "fashion_news_frequency")
    return clean.category_codes(df, ["club_member_status", "fashion_news_frequency"], "_code") \
        .select("customer_id", "club_member_status_code", "fashion_news_frequency_code")


FIRST_BATCH = "t_dat < DATE '1992-02-15'"


@query("q_kept_ids", f"""
    SELECT v AS article_id, CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS id FROM early
    UNION ALL SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 + (SELECT count(*) FROM early) AS BIGINT)
    FROM (SELECT DISTINCT article_id AS v FROM transactions EXCEPT SELECT v FROM early)""", inputs=("transactions",),
       ctes={"early": f"SELECT DISTINCT article_id AS v FROM transactions WHERE {FIRST_BATCH}"})
def kept_ids(spark, d):
    """Two batches number their articles in one stored dictionary."""
    bought, path = transactions(spark, d).select("article_id", "t_dat"), work_path(spark, "dictionary")
    known = io.write_table(clean.new_ids(bought.where(FIRST_BATCH), "article_id"), path)
    io.write_table(clean.new_ids(bought, "article_id", known), path, mode="append")
    return io.read_table(spark, path, known.schema)


@query("q_dense_id", """
    SELECT customer_id, article_id, CAST(dense_rank() OVER (ORDER BY customer_id) - 1 AS INTEGER) AS user_idx,
           CAST(dense_rank() OVER (ORDER BY article_id) - 1 AS INTEGER) AS item_idx FROM transactions""", inputs=("transactions",))
def dense_id(spark, d):
    df = transactions(spark, d).select("customer_id", "article_id")
    return clean.dense_id(clean.dense_id(df, "customer_id", "user_idx"), "article_id", "item_idx")


@query("q_prefix", f"SELECT {KEY}, substr(CAST(postalCode AS VARCHAR), 1, 2) AS department FROM listings", inputs=("listings",))
def prefix(spark, d):
    return listings(spark, d).select(*KEYS, clean.prefix("postalCode", 2).alias("department"))


@query("q_prefix_padded", f"""
    SELECT {KEY}, substr(lpad(CAST(postalCode AS VARCHAR), 5, '0'), 1, 2) AS department FROM listings""", inputs=("listings",))
def prefix_padded(spark, d):
    return listings(spark, d).select(*KEYS, clean.prefix("postalCode", 2, pad=5).alias("department"))


@query("q_update", f"""
    SELECT {KEY}, coalesce(notRepairedDamage, 'ja') AS "notRepairedDamage", {POWER_SQL.format("powerPS")} AS "powerPS"
    FROM listings""", inputs=("listings",))
def update(spark, d):
    df = clean.update(listings(spark, d), {"notRepairedDamage": F.lit("ja")}, F.col("notRepairedDamage").isNull())
    df = clean.update(df, {"powerPS": clean.ceil_bucket("powerPS", 2000, 20000)})
    return df.select(*KEYS, "notRepairedDamage", "powerPS")


# The upper price bound is 100000 here, so that the check meets rows that break it.
MAX_PRICE = 100_000
VALID_SQL = " AND ".join(f"({rule})" for _, rule in quality.listing_rules(MAX_PRICE))


@query("q_valid_rows", f"SELECT {KEY}, price, brand, model FROM listings WHERE {VALID_SQL}", inputs=("listings",))
def valid_rows(spark, d):
    kept = quality.valid_rows(listings(spark, d), quality.listing_constraints(MAX_PRICE))
    return kept.select(*KEYS, "price", "brand", "model")


@query("q_violation_counts", """
    SELECT 'model_known' AS constraint_name, CAST(count(*) AS BIGINT) AS violations FROM listings WHERE model IS NULL AND vehicleType IS NULL
    UNION ALL SELECT 'price_valid', CAST(count(*) AS BIGINT) FROM listings WHERE NOT coalesce(price > 1000 AND price < 100000, false)
    UNION ALL SELECT 'yearOfRegistration_valid', CAST(count(*) AS BIGINT) FROM listings
      WHERE NOT coalesce(yearOfRegistration > 1900 AND yearOfRegistration < 2026, false)
    UNION ALL SELECT 'brand_not_null', CAST(count(*) AS BIGINT) FROM listings WHERE brand IS NULL
    UNION ALL SELECT 'abtest_not_null', CAST(count(*) AS BIGINT) FROM listings WHERE abtest IS NULL""", inputs=("listings",))
def violation_counts(spark, d):
    return quality.violation_report(listings(spark, d), quality.listing_constraints(MAX_PRICE))


@query("q_enforced_write", f"SELECT {KEY}, price FROM listings WHERE {VALID_SQL}", inputs=("listings",))
def enforced_write(spark, d):
    """Valid rows pass the checks and are written; the whole table would not."""
    constraints = quality.listing_constraints(MAX_PRICE)
    kept = quality.valid_rows(listings(spark, d), constraints).select(*KEYS, "price", "model", "vehicleType", "brand", "abtest", "yearOfRegistration")
    return quality.write_enforced(kept, work_path(spark, "enforced"), constraints).select(*KEYS, "price")
