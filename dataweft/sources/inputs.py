"""The operators' inputs, derived from the given tables, each as a DataFrame and as the same SELECT in SQL.

``INPUT_SQL`` holds one common table expression per derived input; an entry may use those before it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Total order of listing rows; also their key.
LISTING_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Used-vehicle adverts: one row per order line."""
    li, o, p = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    damage = F.when(F.col("l_returnflag") == "R", "ja").when(F.col("l_returnflag") == "A", "nein")
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(p, F.col("l_partkey") == F.col("p_partkey"))
            .select(*LISTING_KEY,
                    F.col("o_orderdate").alias("dateCrawled"), F.col("o_orderdate").alias("dateCreated"),
                    F.col("l_shipdate").alias("lastSeen"),
                    F.floor("l_extendedprice").cast("int").alias("price"),
                    F.year("o_orderdate").alias("yearOfRegistration"),
                    damage.alias("notRepairedDamage"),
                    (F.col("p_size") * 400).alias("powerPS"),
                    F.floor(F.col("l_quantity") * 1000).cast("int").alias("kilometer"),
                    F.col("o_orderpriority").alias("fuelType"),
                    F.nullif(F.col("p_type"), F.lit("PROMO")).alias("vehicleType"),
                    F.col("o_orderstatus").alias("gearbox"),
                    F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("model"),
                    F.col("l_linestatus").alias("abtest"),
                    F.nullif(F.col("p_brand"), F.lit("Brand#1")).alias("brand"),
                    F.col("o_custkey").alias("postalCode")))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Page links (lang, src, dst) with duplicates; returned lines link back."""
    li = table(spark, d, "lineitem")
    part = F.concat(F.lit("p"), F.col("l_partkey"))
    supp = F.concat(F.lit("s"), F.col("l_suppkey"))
    there = F.struct(part.alias("src"), supp.alias("dst"))
    back = F.struct(supp.alias("src"), part.alias("dst"))
    both = F.when(F.col("l_returnflag") == "R", F.array(there, back)).otherwise(F.array(there))
    return li.select(F.col("l_linestatus").alias("lang"), F.explode(both).alias("e")).select("lang", "e.src", "e.dst")


def edge_lines(spark: SparkSession, d: str) -> DataFrame:
    """Link lines ``source|destination`` with the dirt the parsers must handle."""
    li = table(spark, d, "lineitem")
    src, dst = F.concat(F.lit("p"), F.col("l_partkey")), F.concat(F.lit("s"), F.col("l_suppkey"))
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 11
    line = (F.when(kind == 0, F.concat(src, F.lit("|"), dst, F.lit("+")))
            .when(kind == 1, F.concat(src, F.lit("|"), dst, F.lit("+]")))
            .when(kind == 2, F.concat(src, F.lit("||"), dst))
            .when(kind == 3, F.concat(src, F.lit("|")))
            .when(kind == 4, F.concat(F.lit("|"), dst))
            .when(kind == 5, F.concat(F.lit("  "), src, F.lit(" | "), dst, F.lit(" ")))
            .when(kind == 6, F.concat(src, F.lit("|"), dst, F.lit("+ ")))
            .when(kind == 7, src)
            .otherwise(F.concat(src, F.lit("|"), dst)))
    return li.select(line.alias("value"))


def tree_edges(spark: SparkSession, d: str) -> DataFrame:
    """Undirected links customer-order and order-line: one component per customer with orders."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    up = o.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("dst"))
    down = li.select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src"),
                     F.concat_ws("-", F.lit("x"), "l_orderkey", "l_linenumber").alias("dst"))
    return up.unionByName(down)


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """Purchases: money as decimal, so that sums do not depend on the order of rows."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.to_date("o_orderdate").alias("t_dat"), F.col("o_custkey").cast("string").alias("customer_id"),
                    F.col("l_partkey").cast("string").alias("article_id"),
                    F.col("l_extendedprice").cast("decimal(12,2)").alias("price")))


def customers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    seg, bal, nat = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_nationkey")
    return c.select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.when(nat % 3 != 0, F.lit(1.0)).alias("FN"), F.when(nat % 2 == 0, F.lit(1.0)).alias("Active"),
        F.when(seg == "HOUSEHOLD", "PRE-CREATE").when(seg != "BUILDING", "ACTIVE").alias("club_member_status"),
        F.when(seg == "AUTOMOBILE", "NONE").when((seg == "BUILDING") & (bal < 0), F.lit(None))
        .when(nat < 12, "Regularly").otherwise("Monthly").alias("fashion_news_frequency"),
        F.when(bal >= 0, (F.lit(16) + F.col("c_custkey") % 60).cast("double")).alias("age"),
        nat.cast("string").alias("postal_code"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    word = F.split("p_name", " ")
    return p.select(
        F.col("p_partkey").cast("string").alias("article_id"),
        F.when(F.col("p_size") < 10, F.concat_ws(" ", "p_type", F.lit("mini"), "p_size")).otherwise(F.col("p_type"))
        .alias("product_type_name"),
        F.col("p_brand").alias("product_group_name"),
        F.when(word[0] == "old", "Unknown").otherwise(word[0]).alias("perceived_colour_value_name"),
        F.col("p_size").cast("string").alias("department_name"),
        (F.col("p_size") % 5).cast("string").alias("index_group_name"),
        word[1].alias("garment_group_name"),
        F.when(word[0] != "small", F.col("p_name")).alias("detail_desc"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"),
                    F.when(F.col("label") < 5, 1).otherwise(-1).alias("label"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The same labels over all entries."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.when(F.col("label") < 5, 1).otherwise(-1).alias("label"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Candidate items per user with a score, ties included, and the relevance flags of two sets."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"))
            .agg(F.sum("l_quantity").alias("score"),
                 F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("in_test"),
                 F.max(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("in_train")))


INPUT_SQL: dict[str, str] = {
    "listings": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
               o_orderdate AS dateCrawled, o_orderdate AS dateCreated, l_shipdate AS lastSeen,
               CAST(floor(l_extendedprice) AS INTEGER) AS price,
               CAST(year(o_orderdate) AS INTEGER) AS yearOfRegistration,
               CASE l_returnflag WHEN 'R' THEN 'ja' WHEN 'A' THEN 'nein' END AS notRepairedDamage,
               p_size * 400 AS powerPS, CAST(floor(l_quantity * 1000) AS INTEGER) AS kilometer,
               o_orderpriority AS fuelType, nullif(p_type, 'PROMO') AS vehicleType, o_orderstatus AS gearbox,
               CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS model, l_linestatus AS abtest,
               nullif(p_brand, 'Brand#1') AS brand, o_custkey AS postalCode
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "edges": """
        SELECT l_linestatus AS lang, concat('p', l_partkey) AS src, concat('s', l_suppkey) AS dst FROM lineitem
        UNION ALL
        SELECT l_linestatus, concat('s', l_suppkey), concat('p', l_partkey) FROM lineitem WHERE l_returnflag = 'R'""",
    "edge_lines": """
        SELECT CASE (l_orderkey + l_linenumber) % 11
               WHEN 0 THEN concat('p', l_partkey, '|s', l_suppkey, '+')
               WHEN 1 THEN concat('p', l_partkey, '|s', l_suppkey, '+]')
               WHEN 2 THEN concat('p', l_partkey, '||s', l_suppkey)
               WHEN 3 THEN concat('p', l_partkey, '|')
               WHEN 4 THEN concat('|s', l_suppkey)
               WHEN 5 THEN concat('  p', l_partkey, ' | s', l_suppkey, ' ')
               WHEN 6 THEN concat('p', l_partkey, '|s', l_suppkey, '+ ')
               WHEN 7 THEN concat('p', l_partkey)
               ELSE concat('p', l_partkey, '|s', l_suppkey) END AS value FROM lineitem""",
    "tree_edges": """
        SELECT concat('c', o_custkey) AS src, concat('o', o_orderkey) AS dst FROM orders
        UNION ALL
        SELECT concat('o', l_orderkey), concat('x-', l_orderkey, '-', l_linenumber) FROM lineitem""",
    "transactions": """
        SELECT CAST(o_orderdate AS DATE) AS t_dat, CAST(o_custkey AS VARCHAR) AS customer_id,
               CAST(l_partkey AS VARCHAR) AS article_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS price
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "customers": """
        SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
               CASE WHEN c_nationkey % 3 <> 0 THEN 1.0::DOUBLE END AS FN,
               CASE WHEN c_nationkey % 2 = 0 THEN 1.0::DOUBLE END AS Active,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'PRE-CREATE' WHEN c_mktsegment <> 'BUILDING' THEN 'ACTIVE' END
                 AS club_member_status,
               CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'NONE' WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN NULL
                    WHEN c_nationkey < 12 THEN 'Regularly' ELSE 'Monthly' END AS fashion_news_frequency,
               CASE WHEN c_acctbal >= 0 THEN CAST(16 + c_custkey % 60 AS DOUBLE) END AS age,
               CAST(c_nationkey AS VARCHAR) AS postal_code
        FROM customer""",
    "articles": """
        SELECT CAST(p_partkey AS VARCHAR) AS article_id,
               CASE WHEN p_size < 10 THEN concat(p_type, ' mini ', p_size) ELSE p_type END AS product_type_name,
               p_brand AS product_group_name,
               CASE WHEN split_part(p_name, ' ', 1) = 'old' THEN 'Unknown' ELSE split_part(p_name, ' ', 1) END
                 AS perceived_colour_value_name,
               CAST(p_size AS VARCHAR) AS department_name, CAST(p_size % 5 AS VARCHAR) AS index_group_name,
               split_part(p_name, ' ', 2) AS garment_group_name,
               CASE WHEN split_part(p_name, ' ', 1) <> 'small' THEN p_name END AS detail_desc
        FROM part""",
    "messages": "SELECT conv_id, turn, role, text AS content FROM conversations",
    "points": """
        SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
               CASE WHEN label < 5 THEN 1 ELSE -1 END AS label FROM embeddings""",
    "scored": """
        SELECT o_custkey AS "user", l_partkey AS item, sum(l_quantity) AS score,
               max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS in_test,
               max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS in_train
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
}
