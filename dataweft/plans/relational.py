"""Queries on joins, membership filters, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataweft.operators import clean, profile, quality, rel
from dataweft.plans.cleaning import MAX_PRICE, POWER_SQL, VALID_SQL
from dataweft.plans.registry import half_even, query
from dataweft.session import work_path
from dataweft.sources import io
from dataweft.sources.inputs import LISTING_KEY, articles, customers, edges, listings, transactions

KEYS = LISTING_KEY[:4]
KEY = ", ".join(KEYS)


@query("q_inner_join", """
    SELECT e.lang, e.dst, CAST(count(*) AS BIGINT) AS n, max(d.deg) AS max_deg FROM edges e
    JOIN (SELECT lang, src, CAST(count(*) AS BIGINT) AS deg FROM edges GROUP BY lang, src) d
      ON e.lang = d.lang AND e.dst = d.src GROUP BY e.lang, e.dst""", inputs=("edges",))
def inner_join(spark, d):
    e = edges(spark, d)
    deg = e.groupBy("lang", F.col("src").alias("dst")).agg(F.count("*").alias("deg"))
    return e.join(deg, ["lang", "dst"]).groupBy("lang", "dst").agg(F.count("*").alias("n"), F.max("deg").alias("max_deg"))


@query("q_left_enrich", """
    SELECT t_dat::VARCHAR AS t_dat, customer_id, article_id, CAST(price AS DOUBLE) AS price, age, product_type_name
    FROM transactions LEFT JOIN (SELECT customer_id, age FROM customers WHERE club_member_status IS NOT NULL) USING (customer_id)
    LEFT JOIN (SELECT article_id, product_type_name FROM articles WHERE detail_desc IS NOT NULL) USING (article_id)""",
       inputs=("transactions", "customers", "articles"))
def left_enrich(spark, d):
    c = customers(spark, d).where("club_member_status IS NOT NULL").select("customer_id", "age")
    a = articles(spark, d).where("detail_desc IS NOT NULL").select("article_id", "product_type_name")
    out = rel.enrich(transactions(spark, d), {"customer_id": c, "article_id": a})
    return out.select(F.col("t_dat").cast("string").alias("t_dat"), "customer_id", "article_id",
                      F.col("price").cast("double").alias("price"), "age", "product_type_name")


@query("q_semi_join", """
    SELECT customer_id, article_id, CAST(price AS DOUBLE) AS price FROM transactions WHERE article_id IN
    (SELECT article_id FROM articles WHERE perceived_colour_value_name = 'red')""", inputs=("transactions", "articles"))
def semi_join(spark, d):
    red = articles(spark, d).where("perceived_colour_value_name = 'red'").select("article_id")
    return rel.semi(transactions(spark, d), red, "article_id").select("customer_id", "article_id", F.col("price").cast("double").alias("price"))


@query("q_anti_join", """
    SELECT customer_id, article_id, CAST(price AS DOUBLE) AS price FROM transactions t WHERE NOT EXISTS
    (SELECT 1 FROM articles a WHERE a.article_id = t.article_id AND detail_desc IS NOT NULL)""", inputs=("transactions", "articles"))
def anti_join(spark, d):
    described = articles(spark, d).where("detail_desc IS NOT NULL").select("article_id")
    return rel.anti(transactions(spark, d), described, "article_id").select(
        "customer_id", "article_id", F.col("price").cast("double").alias("price"))


@query("q_null_counts", """
    SELECT 'customer_id' AS column_name, CAST(count(*) - count(customer_id) AS BIGINT) AS n_null FROM j
    UNION ALL SELECT 'article_id', CAST(count(*) - count(article_id) AS BIGINT) FROM j
    UNION ALL SELECT 'age', CAST(count(*) - count(age) AS BIGINT) FROM j
    UNION ALL SELECT 'detail_desc', CAST(count(*) - count(detail_desc) AS BIGINT) FROM j""",
       inputs=("transactions", "customers", "articles"), ctes={"j": """
    SELECT customer_id, article_id, age, detail_desc FROM transactions LEFT JOIN customers USING (customer_id)
    LEFT JOIN articles USING (article_id)"""})
def null_counts(spark, d):
    joined = rel.enrich(transactions(spark, d), {"customer_id": customers(spark, d), "article_id": articles(spark, d)})
    return profile.null_counts(joined.select("customer_id", "article_id", "age", "detail_desc"))


def repaired(spark, d):
    """Valid listings with the damage filled: the base of the two reports."""
    df = quality.valid_rows(listings(spark, d), quality.listing_constraints(MAX_PRICE))
    return clean.update(df, {"notRepairedDamage": F.lit("ja")}, F.col("notRepairedDamage").isNull())


REPAIRED_SQL = f"""
    SELECT * EXCLUDE (notRepairedDamage), coalesce(notRepairedDamage, 'ja') AS notRepairedDamage FROM listings WHERE {VALID_SQL}"""
BRANDS = ("Brand#2", "Brand#3", "Brand#4")
# The output columns of the two reports.


def brand_year_damage_report(df):
    return (df.where(F.col("yearOfRegistration").between(1950, 1996) & F.col("brand").isin(*BRANDS))
            .groupBy("brand", "yearOfRegistration", "notRepairedDamage")
            .agg(F.count("*").alias("count"), F.avg("price").alias("avg_price"), F.avg("kilometer").alias("avg_km"))
            .orderBy("brand", F.desc("yearOfRegistration"), "notRepairedDamage"))


def brand_fuel_damage_report(df):
    return (df.where(F.col("yearOfRegistration").between(1950, 1996))
            .groupBy("brand", "fuelType", "notRepairedDamage")
            .agg(F.count("*").alias("total_vehicles"), F.avg("price").alias("avg_price"),
                 F.avg("kilometer").alias("avg_kilometers"), F.max("yearOfRegistration").alias("newest_vehicle_year"))
            .orderBy("brand", "fuelType", "notRepairedDamage"))


BRAND_YEAR_SQL = """
    SELECT brand, yearOfRegistration, notRepairedDamage, CAST(count(*) AS BIGINT) AS count, avg(price) AS avg_price,
           avg(kilometer) AS avg_km
    FROM repaired WHERE yearOfRegistration BETWEEN 1950 AND 1996 AND brand IN ('Brand#2', 'Brand#3', 'Brand#4')
    GROUP BY ALL ORDER BY brand, yearOfRegistration DESC, notRepairedDamage"""
BRAND_FUEL_SQL = """
    SELECT brand, fuelType, notRepairedDamage, CAST(count(*) AS BIGINT) AS total_vehicles, avg(price) AS avg_price,
           avg(kilometer) AS avg_kilometers, max(yearOfRegistration) AS newest_vehicle_year
    FROM repaired WHERE yearOfRegistration BETWEEN 1950 AND 1996
    GROUP BY ALL ORDER BY brand, fuelType, notRepairedDamage"""


@query("q_brand_year_damage", BRAND_YEAR_SQL, inputs=("listings",), ctes={"repaired": REPAIRED_SQL})
def brand_year_damage(spark, d):
    return brand_year_damage_report(repaired(spark, d))


@query("q_brand_fuel_damage", BRAND_FUEL_SQL, inputs=("listings",), ctes={"repaired": REPAIRED_SQL})
def brand_fuel_damage(spark, d):
    return brand_fuel_damage_report(repaired(spark, d))


REPORT_COLS = ["brand", "yearOfRegistration", "notRepairedDamage", "fuelType", "price", "kilometer"]


@query("q_brand_year_damage_by_brand", BRAND_YEAR_SQL, inputs=("listings",), ctes={"repaired": REPAIRED_SQL})
def brand_year_damage_by_brand(spark, d):
    stored = io.write_partitioned(repaired(spark, d).select(*REPORT_COLS), work_path(spark, "by-brand"), ["brand"])
    return brand_year_damage_report(stored)


@query("q_brand_fuel_damage_by_year", BRAND_FUEL_SQL, inputs=("listings",), ctes={"repaired": REPAIRED_SQL})
def brand_fuel_damage_by_year(spark, d):
    stored = io.write_partitioned(repaired(spark, d).select(*REPORT_COLS), work_path(spark, "by-year"), ["yearOfRegistration"])
    return brand_fuel_damage_report(stored)


@query("q_sum_by_key", """
    SELECT customer_id, CAST(sum(price) AS DOUBLE) AS total FROM transactions GROUP BY customer_id""", inputs=("transactions",))
def sum_by_key(spark, d):
    return transactions(spark, d).groupBy("customer_id").agg(F.sum("price").cast("double").alias("total"))


@query("q_keep_frequent", """
    SELECT article_id, product_type_name FROM articles WHERE product_type_name IN
    (SELECT product_type_name FROM articles GROUP BY 1 HAVING count(*) > 6)""", inputs=("articles",))
def keep_frequent(spark, d):
    return rel.keep_frequent(articles(spark, d), "product_type_name", 6).select("article_id", "product_type_name")


@query("q_keep_top", """
    SELECT article_id, product_group_name FROM articles WHERE product_group_name IN
    (SELECT product_group_name FROM articles GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)""", inputs=("articles",))
def keep_top(spark, d):
    return rel.keep_top(articles(spark, d), "product_group_name", 10).select("article_id", "product_group_name")


SHARE_SQL = f"""
    SELECT product_type_name, CAST(count(*) AS BIGINT) AS n,
           {half_even("count(*) / (SELECT count(*) FROM articles)::DOUBLE * 100 * 100")} / 100 AS share
    FROM articles GROUP BY product_type_name"""


@query("q_keep_share", """
    SELECT article_id, product_type_name FROM articles
    WHERE product_type_name IN (SELECT product_type_name FROM shares WHERE share > 1)
      AND detail_desc IS NOT NULL""", inputs=("articles",), ctes={"shares": SHARE_SQL})
def keep_share(spark, d):
    a = articles(spark, d)
    return rel.keep_share(a.where("detail_desc IS NOT NULL"), a, "product_type_name", 1.0).select("article_id", "product_type_name")


@query("q_keep_active", """
    SELECT customer_id, article_id, CAST(price AS DOUBLE) AS price FROM transactions WHERE customer_id IN
    (SELECT customer_id FROM transactions GROUP BY 1 HAVING count(*) >= 40)""", inputs=("transactions",))
def keep_active(spark, d):
    return rel.keep_active(transactions(spark, d), "customer_id", 40).select(
        "customer_id", "article_id", F.col("price").cast("double").alias("price"))


@query("q_sort_multi", """
    SELECT product_type_name, index_group_name, article_id FROM articles ORDER BY 1, 2 DESC, 3""", inputs=("articles",))
def sort_multi(spark, d):
    return articles(spark, d).select("product_type_name", "index_group_name", "article_id") \
        .orderBy("product_type_name", F.desc("index_group_name"), "article_id")


@query("q_datediff_top", f"""
    SELECT {KEY}, CAST(date_diff('day', CAST(dateCreated AS DATE), CAST(lastSeen AS DATE)) AS INTEGER) AS days
    FROM listings WHERE notRepairedDamage = 'nein' ORDER BY days DESC, {', '.join(LISTING_KEY)} LIMIT 20""", inputs=("listings",))
def datediff_top(spark, d):
    days = F.datediff("lastSeen", "dateCreated")
    return (listings(spark, d).where("notRepairedDamage = 'nein'").select(*LISTING_KEY, days.alias("days"))
            .orderBy(F.desc("days"), *LISTING_KEY).limit(20).select(*KEYS, "days"))


@query("q_first_distinct", "SELECT DISTINCT customer_id FROM transactions ORDER BY customer_id LIMIT 10", inputs=("transactions",))
def first_distinct(spark, d):
    return transactions(spark, d).select("customer_id").distinct().orderBy("customer_id").limit(10)


@query("q_union_all", """
    SELECT customer_id, article_id, t_dat::VARCHAR AS t_dat FROM transactions WHERE t_dat < DATE '1998-03-15'
    UNION ALL SELECT customer_id, article_id, t_dat::VARCHAR FROM transactions WHERE t_dat > DATE '1998-03-01'""",
       inputs=("transactions",))
def union_all(spark, d):
    t = transactions(spark, d).select("customer_id", "article_id", F.col("t_dat").cast("string").alias("t_dat"))
    return t.where("t_dat < '1998-03-15'").unionByName(t.where("t_dat > '1998-03-01'"))


@query("q_uniques", "SELECT DISTINCT fashion_news_frequency FROM customers", inputs=("customers",))
def uniques(spark, d):
    return profile.uniques(customers(spark, d), "fashion_news_frequency")


@query("q_scalar_strings", """
    SELECT value, trim(value) AS trimmed, regexp_replace(value, '\\+$', '') AS no_plus, replace(value, '+]', '') AS no_mark,
           CAST(len(string_split(value, '|')) AS INTEGER) AS n_parts, string_split(value, '|')[1] AS first_part,
           substr(value, 1, 2) AS head, CAST(count(*) AS BIGINT) AS n
    FROM edge_lines GROUP BY value""", inputs=("edge_lines",))
def scalar_strings(spark, d):
    from dataweft.functions.scalars import remove_literal, strip_one
    from dataweft.sources.inputs import edge_lines
    lines = edge_lines(spark, d).groupBy("value").agg(F.count("*").alias("n"))
    parts = F.split("value", r"\|")
    return lines.select("value", F.trim("value").alias("trimmed"), strip_one(F.col("value"), "+").alias("no_plus"),
                        remove_literal(F.col("value"), "+]").alias("no_mark"), F.size(parts).alias("n_parts"),
                        F.get(parts, F.lit(0)).alias("first_part"), F.substring("value", 1, 2).alias("head"), "n")


@query("q_scalar_dates", """
    SELECT CAST(t_dat AS VARCHAR) AS t_dat, CAST(year(t_dat) AS INTEGER) AS y, CAST(t_dat - INTERVAL 1 YEAR AS DATE)::VARCHAR AS last_year,
           make_date(year(t_dat), 12, 10)::VARCHAR AS window_start, CAST(date_diff('day', t_dat, DATE '2001-08-01') AS INTEGER) AS age_days,
           strptime(strftime(t_dat, '%d/%m/%Y'), '%d/%m/%Y')::DATE::VARCHAR AS parsed, CAST(count(*) AS BIGINT) AS n
    FROM transactions GROUP BY ALL""", inputs=("transactions",))
def scalar_dates(spark, d):
    t = transactions(spark, d).groupBy("t_dat").agg(F.count("*").alias("n"))
    text = F.date_format("t_dat", "dd/MM/yyyy")
    return t.select(
        F.col("t_dat").cast("string").alias("t_dat"), F.year("t_dat").alias("y"),
        F.add_months("t_dat", -12).cast("string").alias("last_year"),
        F.make_date(F.year("t_dat"), F.lit(12), F.lit(10)).cast("string").alias("window_start"),
        F.datediff(F.lit("2001-08-01").cast("date"), "t_dat").alias("age_days"),
        F.to_date(text, "dd/MM/yyyy").cast("string").alias("parsed"), "n")


@query("q_scalar_arrays", """
    SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS self_dot,
           CAST(embedding[1] AS DOUBLE) AS first_value, embedding[1000] IS NULL AS past_end_is_null,
           array_to_string(list_resize(label_text[1:1], 3, '-'), ',') AS padded,
           greatest(0, least(2, 1 - round(embedding[1]::DOUBLE, 6))) AS clamped, printf('%.5f', round(embedding[1]::DOUBLE, 5)) AS shown
    FROM (SELECT *, [label::VARCHAR, 'x'] AS label_text FROM embeddings)""")
def scalar_arrays(spark, d):
    from dataweft.functions.scalars import dot, fit_length
    from dataweft.sources.inputs import table
    e = table(spark, d, "embeddings")
    first = F.get("embedding", F.lit(0)).cast("double")
    return e.select("vec_id", F.round(dot(F.col("embedding"), F.reverse("embedding")), 6).alias("self_dot"),
                    first.alias("first_value"), F.get("embedding", F.lit(999)).isNull().alias("past_end_is_null"),
                    F.array_join(fit_length(F.slice(F.array(F.col("label").cast("string"), F.lit("x")), 1, 1), 3, "-"), ",").alias("padded"),
                    F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - F.round(first, 6))).alias("clamped"),
                    F.format_string("%.5f", F.round(first, 5)).alias("shown"))
