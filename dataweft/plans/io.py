"""Queries on readers and writers: each writes a table derived from the given ones and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import (IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType)

from dataweft.operators import clean, profile
from dataweft.plans.registry import query
from dataweft.session import cut, work_path
from dataweft.sources import io, layout
from dataweft.sources.inputs import (LISTING_KEY, edge_lines, edges, listings, messages, table, transactions)


@query("q_text_scan", "SELECT value, CAST(count(*) AS BIGINT) AS n FROM edge_lines GROUP BY value", inputs=("edge_lines",))
def text_scan(spark, d):
    path = work_path(spark, "lines")
    edge_lines(spark, d).write.text(path)
    return io.read_lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query("q_csv_roundtrip", """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer""")
def csv_roundtrip(spark, d):
    path = work_path(spark, "csv")
    source = table(spark, d, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    io.write_csv(source, path)
    back = io.read_csv(spark, path)  # inferred types, conformed to the declared ones
    return io.conform(back, source.schema)


@query("q_csv_dates", """
    SELECT customer_id, article_id, CAST(t_dat AS VARCHAR) AS t_dat, CAST(price AS DOUBLE) AS price FROM transactions""",
       inputs=("transactions",))
def csv_dates(spark, d):
    path = work_path(spark, "csvgz")
    io.write_csv(transactions(spark, d), path, compression="gzip")
    schema = "t_dat string, customer_id string, article_id string, price double"
    back = io.read_csv(spark, path, schema=schema, dates=["t_dat"])
    return back.withColumn("t_dat", F.col("t_dat").cast("string"))


@query("q_ctas", """
    SELECT brand, CAST(count(*) AS BIGINT) AS n, CAST(sum(price) AS BIGINT) AS total FROM listings
    WHERE brand IS NOT NULL GROUP BY brand""", inputs=("listings",))
def ctas(spark, d):
    source = listings(spark, d).where("brand IS NOT NULL").select("brand", "price")
    stored = io.write_table(source, work_path(spark, "ctas"))
    return stored.groupBy("brand").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


# The declared columns, spelled as they are declared.
LISTING_SCHEMA = StructType([
    StructField("id", LongType()), StructField("dateCreated", TimestampNTZType()), StructField("price", IntegerType()),
    StructField("yearOfRegistration", IntegerType()), StructField("notRepairedDamage", StringType()),
    StructField("powerPSCat", IntegerType()), StructField("kilometer", IntegerType()), StructField("fuelType", StringType()),
    StructField("vehiculeType", StringType()), StructField("gearbox", StringType()), StructField("model", StringType()),
    StructField("abtest", StringType()), StructField("brand", StringType()), StructField("lastSeen", TimestampNTZType()),
    StructField("department", IntegerType())])


def conformed(df):
    """Listing rows as the declared table takes them; ``id`` is the order key here."""
    source = df.select(
        F.col("l_orderkey").cast("string").alias("id"), "dateCreated", "price", "yearOfRegistration", "notRepairedDamage",
        F.col("powerPS").alias("powerPSCat"), "kilometer", "fuelType", F.col("vehicleType").alias("vehiculeType"), "gearbox",
        "model", "abtest", "brand", clean.prefix("postalCode", 2).alias("department"), "lastSeen")
    return io.conform(source, LISTING_SCHEMA)


CONFORMED_SQL = """
    SELECT l_orderkey AS id, CAST(dateCreated AS VARCHAR) AS dateCreated, price, yearOfRegistration, notRepairedDamage,
           powerPS AS powerPSCat, kilometer, fuelType, vehicleType AS vehiculeType, gearbox, model, abtest, brand,
           CAST(lastSeen AS VARCHAR) AS lastSeen, CAST(substr(CAST(postalCode AS VARCHAR), 1, 2) AS INTEGER) AS department
    FROM listings"""


def _plain_times(df):
    return df.withColumns({c: F.col(c).cast("string") for c in ("dateCreated", "lastSeen")})


@query("q_conform", CONFORMED_SQL, inputs=("listings",))
def conform(spark, d):
    return _plain_times(conformed(listings(spark, d)))


@query("q_partitioned_scan", """
    SELECT yearOfRegistration, CAST(count(*) AS BIGINT) AS n, CAST(sum(kilometer) AS BIGINT) AS km FROM listings
    WHERE brand IN ('Brand#3', 'Brand#7', 'Brand#11') GROUP BY yearOfRegistration""", inputs=("listings",))
def partitioned_scan(spark, d):
    source = listings(spark, d).select("brand", "yearOfRegistration", "kilometer")
    stored = io.write_partitioned(source, work_path(spark, "by-brand"), ["brand"])
    return (stored.where(F.col("brand").isin("Brand#3", "Brand#7", "Brand#11")).groupBy("yearOfRegistration")
            .agg(F.count("*").alias("n"), F.sum("kilometer").alias("km")))


@query("q_interleaved_scan", """
    SELECT 'brand' AS report, CAST(count(*) AS BIGINT) AS n, CAST(sum(kilometer) AS BIGINT) AS km FROM listings WHERE brand = 'Brand#3'
    UNION ALL SELECT 'year', CAST(count(*) AS BIGINT), CAST(sum(kilometer) AS BIGINT) FROM listings WHERE yearOfRegistration = 1995""", inputs=("listings",))
def interleaved_scan(spark, d):
    """Two reports, each filtered by another column, on one table laid out for both."""
    source = cut(listings(spark, d).select("brand", "yearOfRegistration", "kilometer"))
    stored = layout.write_interleaved(source, work_path(spark, "interleaved"), ["brand", "yearOfRegistration"], 16)
    report = lambda name, where: stored.where(where).agg(F.lit(name).alias("report"), F.count("*").alias("n"), F.sum("kilometer").alias("km"))
    return report("brand", "brand = 'Brand#3'").unionByName(report("year", "yearOfRegistration = 1995"))


@query("q_append", f"""
    SELECT id, dateCreated, price, brand, department, lastSeen FROM conformed
    UNION ALL SELECT id + 1000000, dateCreated, price, brand, department, lastSeen FROM conformed""",
       inputs=("listings",), ctes={"conformed": CONFORMED_SQL})
def append(spark, d):
    base = _plain_times(conformed(listings(spark, d))).select("id", "dateCreated", "price", "brand", "lastSeen", "department")
    path = work_path(spark, "append")
    stored = io.write_table(base, path)
    # the new rows list two columns the other way round: names decide, not places
    shifted = stored.select((F.col("id") + 1_000_000).alias("id"), "dateCreated", "price", "brand", "department", "lastSeen")
    io.write_table(shifted, path, mode="append")
    return io.read_table(spark, path, base.schema)


@query("q_chat_nested", """
    SELECT conv_id, CAST(0 AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n_messages,
           string_agg(role, ',' ORDER BY turn) AS roles, string_agg(content, chr(10) ORDER BY turn) AS contents
    FROM messages GROUP BY conv_id""", inputs=("messages",))
def chat_nested(spark, d):
    from dataweft.operators.chat import nest_messages
    path = work_path(spark, "chat")
    nest_messages(messages(spark, d)).write.parquet(path)
    chats = io.read_nested(spark, path)
    return chats.select("conv_id", "part", F.size("messages").cast("long").alias("n_messages"),
                        F.array_join("messages.role", ",").alias("roles"),
                        F.array_join("messages.content", "\n").alias("contents"))


@query("q_schema", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS type, CAST(count({c}) AS BIGINT) AS non_null FROM customers"
    for c, t in [("customer_id", "string"), ("FN", "double"), ("Active", "double"), ("club_member_status", "string"),
                 ("fashion_news_frequency", "string"), ("age", "double"), ("postal_code", "string")]), inputs=("customers",))
def schema(spark, d):
    from dataweft.sources.inputs import customers
    return profile.schema_table(customers(spark, d))


@query("q_head_sample", f"""
    SELECT l_orderkey, l_linenumber, price, brand FROM listings ORDER BY {', '.join(LISTING_KEY)} LIMIT 5""", inputs=("listings",))
def head_sample(spark, d):
    return io.head_sample(listings(spark, d), 5, LISTING_KEY).select("l_orderkey", "l_linenumber", "price", "brand")


@query("q_shape", "SELECT CAST(count(*) AS BIGINT) AS n_rows, 3 AS n_cols FROM edges", inputs=("edges",))
def shape(spark, d):
    return profile.shape(edges(spark, d))


@query("q_empty_frame", "SELECT id, price, brand FROM conformed", inputs=("listings",), ctes={"conformed": CONFORMED_SQL})
def empty_frame(spark, d):
    """An empty frame of the declared columns, filled from the listings by name."""
    rows = conformed(listings(spark, d))
    return io.append(io.empty(spark, rows.schema), rows).select("id", "price", "brand")
