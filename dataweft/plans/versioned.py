"""Queries on versioned tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataweft.operators import clean
from dataweft.operators.ordering import with_row_id
from dataweft.plans.registry import query
from dataweft.session import work_path
from dataweft.sources import io, versions
from dataweft.sources.inputs import LISTING_KEY, listings

KEYS = LISTING_KEY[:4]
KEY = ", ".join(KEYS)


def two_versions(spark, d) -> str:
    """Version 0: listings with an id; version 1: the same rows added once more with shifted ids."""
    path = work_path(spark, "versions")
    rows = with_row_id(listings(spark, d).select(*LISTING_KEY, "price", "brand"), LISTING_KEY)
    versions.create(rows.select("id", "price", "brand"), path)
    base = versions.read_version(spark, path, 0)
    shifted = base.select("brand", (F.col("id") + 1_000_000_000).alias("id"), "price")
    versions.commit(io.append(base.limit(0), shifted), path, "insert", add=True)
    return path


@query("q_read_version", """
    SELECT 0 AS version, id, price, brand FROM v0 UNION ALL SELECT 1, id, price, brand FROM v0
    UNION ALL SELECT 1, id + 1000000000, price, brand FROM v0""", inputs=("listings",), ctes={
        "v0": f"""SELECT CAST(row_number() OVER (ORDER BY {', '.join(LISTING_KEY)}) AS BIGINT) AS id, price, brand FROM listings"""})
def read_version(spark, d):
    path = two_versions(spark, d)
    both = [versions.read_version(spark, path, v).withColumn("version", F.lit(v)) for v in (0, 1)]
    return both[0].unionByName(both[1])


@query("q_version_history", """
    SELECT 0 AS version, 'create' AS operation, CAST(count(*) AS BIGINT) AS n_rows, 1 AS n_folders FROM listings
    UNION ALL SELECT 1, 'insert', CAST(count(*) AS BIGINT), 2 FROM listings""", inputs=("listings",))
def version_history(spark, d):
    return versions.history(spark, two_versions(spark, d)).select("version", "operation", "n_rows", F.col("n_parts").alias("n_folders"))


@query("q_version_compare", """
    SELECT avg(price) AS avg_price_v1, avg(price) AS avg_price_v0, 0.0::DOUBLE AS avg_price_difference,
           CAST(2 * count(price) AS BIGINT) AS count_price_v1, CAST(count(price) AS BIGINT) AS count_price_v0,
           CAST(count(price) AS BIGINT) AS count_price_difference FROM listings""", inputs=("listings",))
def version_compare(spark, d):
    """A table before and after its rows were added once more."""
    old = listings(spark, d).select("price")
    return versions.compare(old.unionByName(old), old, {"avg_price": F.avg("price"), "count_price": F.count("price")}, ("v1", "v0"))


@query("q_changes", f"""
    SELECT {', '.join('coalesce(a.' + k + ', b.' + k + ') AS ' + k for k in KEYS)},
           CASE WHEN a.l_orderkey IS NULL THEN 'insert' WHEN b.l_orderkey IS NULL THEN 'delete' ELSE kind END AS change_type,
           CASE WHEN a.l_orderkey IS NULL OR (b.l_orderkey IS NOT NULL AND kind = 'update_postimage') THEN b.damage ELSE a.damage END
             AS damage
    FROM before a FULL OUTER JOIN after b
      ON {' AND '.join(f'a.{k} = b.{k}' for k in LISTING_KEY)}
    JOIN (VALUES ('update_preimage'), ('update_postimage')) t(kind)
      ON (a.l_orderkey IS NOT NULL AND b.l_orderkey IS NOT NULL) OR kind = 'update_preimage'
    WHERE a.l_orderkey IS NULL OR b.l_orderkey IS NULL OR a.damage IS DISTINCT FROM b.damage""",
       inputs=("listings",), ctes={
           "before": f"SELECT {', '.join(LISTING_KEY)}, notRepairedDamage AS damage FROM listings WHERE price < 100000",
           "after": f"SELECT {', '.join(LISTING_KEY)}, coalesce(notRepairedDamage, 'ja') AS damage FROM listings WHERE price > 1500"})
def changes(spark, d):
    """Version 1 fills the damage, drops cheap rows and brings in dear ones."""
    rows = listings(spark, d).withColumn("damage", F.col("notRepairedDamage")).select(*LISTING_KEY, "price", "damage")
    before = rows.where("price < 100000").drop("price")
    after = clean.update(rows, {"damage": F.lit("ja")}, F.col("damage").isNull()).where("price > 1500").drop("price")
    feed = versions.changes(before, after, LISTING_KEY)
    return feed.select(*KEYS, "change_type", "damage")


ROWS = "brand, price, damage"


@query("q_row_changes", f"""
    SELECT {ROWS}, 'delete' AS change_type, CAST(1 AS BIGINT) AS n_each FROM
      (SELECT {ROWS} FROM before EXCEPT ALL SELECT {ROWS} FROM after)
    UNION ALL SELECT {ROWS}, 'insert', CAST(1 AS BIGINT) FROM (SELECT {ROWS} FROM after EXCEPT ALL SELECT {ROWS} FROM before)""",
       inputs=("listings",), ctes={
           "before": "SELECT brand, price // 1000 AS price, notRepairedDamage AS damage FROM listings WHERE price < 100000",
           "after": "SELECT brand, price // 1000 AS price, coalesce(notRepairedDamage, 'ja') AS damage FROM listings WHERE price > 1500"})
def row_changes(spark, d):
    """Two states without a key and with many equal rows."""
    rows = listings(spark, d).select("brand", F.floor(F.col("price") / 1000).cast("int").alias("kprice"), F.col("notRepairedDamage").alias("damage"), "price")
    before = rows.where("price < 100000")
    after = clean.update(rows, {"damage": F.lit("ja")}, F.col("damage").isNull()).where("price > 1500")
    short = lambda df: df.select("brand", F.col("kprice").alias("price"), "damage")
    return versions.row_changes(short(before), short(after)).withColumn("n_each", F.lit(1).cast("long"))
