"""Queries on recommender preparation, splits, scores and metrics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from dataweft.operators import recsys, topn
from dataweft.operators.recsys import ARTICLE_GROUP
from dataweft.plans.cleaning import FILLED_CUSTOMERS_SQL
from dataweft.plans.profiling import BASKET_SQL, PRICE_SQL, RECENCY_SQL
from dataweft.plans.registry import half_even, query
from dataweft.plans.windows import AGE_SQL, SHUFFLE_SQL, shuffled
from dataweft.session import cut
from dataweft.sources.inputs import articles, customers, scored, table, transactions


@query("q_interactions", """
    SELECT customer_id, article_id, CAST(count(*) AS BIGINT) AS n,
           CAST(dense_rank() OVER (ORDER BY customer_id) - 1 AS INTEGER) AS user_idx,
           CAST(dense_rank() OVER (ORDER BY article_id) - 1 AS INTEGER) AS item_idx
    FROM transactions GROUP BY customer_id, article_id""", inputs=("transactions",))
def interactions(spark, d):
    return recsys.interactions(transactions(spark, d))


@query("q_interaction_shape", """
    SELECT n_users, n_items, n_pairs, n_pairs / (n_users * n_items)::DOUBLE AS density FROM
    (SELECT CAST(count(DISTINCT customer_id) AS BIGINT) AS n_users, CAST(count(DISTINCT article_id) AS BIGINT) AS n_items,
            CAST(count(DISTINCT (customer_id, article_id)) AS BIGINT) AS n_pairs FROM transactions)""", inputs=("transactions",))
def interaction_shape(spark, d):
    return recsys.interaction_shape(transactions(spark, d))


def _pairs(spark, d):
    return transactions(spark, d).groupBy("customer_id", "article_id").agg(F.count("*").alias("n"))


@query("q_random_split", """
    SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_in_both, CAST(0 AS BIGINT) AS n_in_none, true AS share_fits
    FROM (SELECT DISTINCT customer_id, article_id FROM transactions)""", inputs=("transactions",))
def random_split(spark, d):
    """The two parts share no row, miss no row, and a fifth of the rows is in the second, give or take five standard errors."""
    pairs = cut(_pairs(spark, d))
    train, test = recsys.random_split(pairs, 0.2, ["customer_id", "article_id"], seed=7)
    placed = pairs.select("customer_id", "article_id", F.lit(0).alias("part")).unionByName(
        train.select("customer_id", "article_id", F.lit(1).alias("part"))).unionByName(test.select("customer_id", "article_id", F.lit(2).alias("part")))
    each = placed.groupBy("customer_id", "article_id").agg(F.count_if(F.col("part") == 1).alias("a"), F.count_if(F.col("part") == 2).alias("b"))
    share = F.avg(F.when(F.col("b") > 0, 1.0).otherwise(0.0))
    return each.agg(F.count("*").alias("n_rows"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("n_in_both"),
                    F.count_if((F.col("a") == 0) & (F.col("b") == 0)).alias("n_in_none"),
                    (F.abs(share - 0.2) < 5 * F.sqrt(F.lit(0.16) / F.count("*"))).alias("share_fits"))


@query("q_recent_items", """
    SELECT DISTINCT article_id FROM transactions
    WHERE t_dat >= CAST((SELECT max(t_dat) FROM transactions) - INTERVAL 1 YEAR AS DATE)""", inputs=("transactions",))
def recent_items(spark, d):
    t = transactions(spark, d)
    return recsys.recent_items(t, t.select(F.max("t_dat")).scalar())


@query("q_customer_features", """
    SELECT customer_id, age, t_dat_min::VARCHAR AS t_dat_min, t_dat_max::VARCHAR AS t_dat_max, coalesce(ct_carts, 0) AS ct_carts,
           price_min, price_mean, price_max, cart_value_min, cart_value_mean, cart_value_max
    FROM customers LEFT JOIN recency USING (customer_id) LEFT JOIN prices USING (customer_id) LEFT JOIN baskets USING (customer_id)""",
       inputs=("transactions", "customers"), ctes={"recency": RECENCY_SQL, "prices": PRICE_SQL, "baskets": BASKET_SQL})
def customer_features(spark, d):
    out = recsys.customer_features(transactions(spark, d), customers(spark, d).select("customer_id", "age"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("t_dat_min", "t_dat_max")})


def _shown(df):
    return df.withColumns({"t_dat": F.col("t_dat").cast("string"), "price": F.col("price").cast("double")})


ARTICLE_COLS = ", ".join(ARTICLE_GROUP)


@query("q_merge_full", f"""
    SELECT t_dat::VARCHAR AS t_dat, customer_id, article_id, CAST(price AS DOUBLE) AS price, FN, Active, club_member_status,
           fashion_news_frequency, age, postal_code, {ARTICLE_COLS}, product_group_name, detail_desc
    FROM transactions LEFT JOIN customers USING (customer_id) LEFT JOIN articles USING (article_id)""",
       inputs=("transactions", "customers", "articles"))
def merge_full(spark, d):
    return _shown(recsys.merge_full(transactions(spark, d), customers(spark, d), articles(spark, d)))


@query("q_merge_reduced", f"""
    SELECT t_dat::VARCHAR AS t_dat, customer_id, article_id, CAST(price AS DOUBLE) AS price, FN, Active, club_member_status,
           fashion_news_frequency, age, postal_code, {ARTICLE_COLS}
    FROM transactions LEFT JOIN customers USING (customer_id) LEFT JOIN articles USING (article_id)""",
       inputs=("transactions", "customers", "articles"))
def merge_reduced(spark, d):
    return _shown(recsys.merge_reduced(transactions(spark, d), customers(spark, d), articles(spark, d)))


SHARE = half_even("count(*) / (SELECT count(*) FROM goods0)::DOUBLE * 100 * 100") + " / 100"
PREPARED = {
    "filled": FILLED_CUSTOMERS_SQL,
    "people0": f"""SELECT * EXCLUDE (FN, Active, age), {AGE_SQL} AS age_group, age FROM
        (SELECT * EXCLUDE (age), CAST(trunc(coalesce(age, (SELECT avg(age) FROM filled))) AS INTEGER) AS age FROM filled)
        WHERE fashion_news_frequency <> 'None' OR club_member_status <> 'None'""",
    "people": f"""SELECT * EXCLUDE (size, pos) FROM
        (SELECT *, count(*) OVER (PARTITION BY age_group) AS size,
         row_number() OVER (PARTITION BY age_group ORDER BY {SHUFFLE_SQL.format("customer_id")}, customer_id) AS pos FROM people0)
        WHERE pos <= {half_even("size * 0.9::DOUBLE")}""",
    "goods0": """SELECT DISTINCT * EXCLUDE (detail_desc), coalesce(detail_desc, 'Not Available') AS detail_desc FROM articles
        WHERE garment_group_name IS DISTINCT FROM 'Unknown' AND perceived_colour_value_name IS DISTINCT FROM 'Unknown'
          AND perceived_colour_value_name IS DISTINCT FROM 'Undefined'""",
    "goods1": """SELECT * FROM goods0 WHERE product_type_name IN
        (SELECT product_type_name FROM goods0 GROUP BY 1 HAVING count(*) > 3)""",
    "goods2": """SELECT * FROM goods1 WHERE product_group_name IN
        (SELECT product_group_name FROM goods1 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)""",
    "goods": f"""SELECT * FROM goods2 WHERE product_type_name IN
        (SELECT product_type_name FROM goods0 GROUP BY 1 HAVING {SHARE} > 1)""",
    "windowed": """SELECT * FROM transactions WHERE (t_dat < DATE '1998-03-15' OR t_dat > DATE '1998-05-15')
        AND NOT (month(t_dat) = 12 AND day(t_dat) BETWEEN 10 AND 25)
        AND year(t_dat) < (SELECT year(max(t_dat)) FROM transactions)""",
    "sellers": f"""SELECT article_id FROM (SELECT article_id, row_number() OVER (PARTITION BY {ARTICLE_COLS}
        ORDER BY n DESC, article_id) AS rn FROM (SELECT {ARTICLE_COLS}, article_id, count(*) AS n
        FROM windowed JOIN goods USING (article_id) GROUP BY ALL)) WHERE rn = 1""",
    "bought": "SELECT * FROM windowed WHERE article_id IN (SELECT article_id FROM sellers)",
    "active": "SELECT * FROM bought WHERE customer_id IN (SELECT customer_id FROM bought GROUP BY 1 HAVING count(*) >= 4)",
    "recent": """SELECT DISTINCT article_id FROM active
        WHERE t_dat >= CAST((SELECT max(t_dat) FROM transactions) - INTERVAL 1 YEAR AS DATE)""",
    "kept": """SELECT * FROM active WHERE customer_id IN (SELECT customer_id FROM people)
        AND article_id IN (SELECT article_id FROM recent)"""}


def prepared(spark, d):
    return recsys.prepare(transactions(spark, d), customers(spark, d), articles(spark, d),
                          recsys.Windows(one_off=(date(1998, 3, 15), date(1998, 5, 15))),
                          sample_order=[shuffled("customer_id"), F.col("customer_id")])


@query("q_reco_prepared", f"""
    SELECT t_dat::VARCHAR AS t_dat, customer_id, article_id, CAST(price AS DOUBLE) AS price, club_member_status,
           fashion_news_frequency, age, postal_code, age_group, {ARTICLE_COLS}, product_group_name, detail_desc
    FROM kept LEFT JOIN people USING (customer_id) LEFT JOIN goods USING (article_id)""",
       inputs=("transactions", "customers", "articles"), ctes=PREPARED)
def reco_prepared(spark, d):
    return _shown(prepared(spark, d))


# -- metrics on given scores ------------------------------------------------------------------------------------------

def _sets(spark, d):
    s = cut(scored(spark, d))  # read three times
    return (s.select("user", "item", "score"), s.where("in_train = 1").select("user", "item"),
            s.where("in_test = 1").select("user", "item"))


METRICS = {
    "ranked": """SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rn FROM scored""",
    "per_user": """SELECT "user", sum(CASE WHEN rn <= 12 THEN in_test ELSE 0 END) / 12.0::DOUBLE AS p_test,
        sum(CASE WHEN rn <= 10 THEN in_test ELSE 0 END) / sum(in_test)::DOUBLE AS r_test, sum(in_test) AS n_test,
        sum(CASE WHEN rn <= 12 THEN in_train ELSE 0 END) / 12.0::DOUBLE AS p_train,
        CASE WHEN sum(in_train) > 0 THEN sum(CASE WHEN rn <= 10 THEN in_train ELSE 0 END) / sum(in_train)::DOUBLE END AS r_train,
        sum(in_train) AS n_train FROM ranked GROUP BY "user" """,
    "pairs_test": """SELECT a."user", avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END::DOUBLE) AS auc
        FROM scored a JOIN scored b ON a."user" = b."user" AND a.in_test = 1 AND b.in_test = 0 GROUP BY a."user" """,
    "pairs_train": """SELECT a."user", avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END::DOUBLE) AS auc
        FROM scored a JOIN scored b ON a."user" = b."user" AND a.in_train = 1 AND b.in_train = 0 GROUP BY a."user" """,
    "auc_test": """SELECT "user", coalesce(auc, 0.5) AS auc FROM (SELECT DISTINCT "user" FROM scored WHERE in_test = 1)
        LEFT JOIN pairs_test USING ("user")""",
    "auc_train": """SELECT "user", coalesce(auc, 0.5) AS auc FROM (SELECT DISTINCT "user" FROM scored WHERE in_train = 1)
        LEFT JOIN pairs_train USING ("user")"""}


@query("q_precision_at_k", "SELECT round(avg(p_test), 6) AS precision FROM per_user WHERE n_test > 0", inputs=("scored",), ctes=METRICS)
def precision_at_k(spark, d):
    scores, _, test = _sets(spark, d)
    return recsys.precision_at_k(scores, test, 12).select(F.round("precision", 6).alias("precision"))


@query("q_recall_at_k", "SELECT round(avg(r_test), 6) AS recall FROM per_user WHERE n_test > 0", inputs=("scored",), ctes=METRICS)
def recall_at_k(spark, d):
    scores, _, test = _sets(spark, d)
    return recsys.recall_at_k(scores, test, 10).select(F.round("recall", 6).alias("recall"))


@query("q_user_auc", """SELECT "user", auc FROM auc_test""", inputs=("scored",), ctes=METRICS)
def user_auc(spark, d):
    scores, _, test = _sets(spark, d)
    return recsys.auc_per_user(scores, test)


@query("q_eval_table", """
    SELECT 'train' AS set, round((SELECT avg(p_train) FROM per_user WHERE n_train > 0), 6) AS precision,
           round((SELECT avg(r_train) FROM per_user WHERE n_train > 0), 6) AS recall, round((SELECT avg(auc) FROM auc_train), 6) AS auc
    UNION ALL SELECT 'test', round((SELECT avg(p_test) FROM per_user WHERE n_test > 0), 6),
           round((SELECT avg(r_test) FROM per_user WHERE n_test > 0), 6), round((SELECT avg(auc) FROM auc_test), 6)""",
       inputs=("scored",), ctes=METRICS)
def eval_table(spark, d):
    out = recsys.evaluate(*_sets(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "auc")})


@query("q_overlap_pct", """
    SELECT "user", CAST(sum(in_train) AS BIGINT) AS n_known, sum(CASE WHEN rn <= 10 THEN in_train ELSE 0 END) * 100 / sum(in_train)::DOUBLE AS pct
    FROM ranked GROUP BY "user" HAVING sum(in_train) > 0""", inputs=("scored",), ctes=METRICS)
def overlap_pct(spark, d):
    from dataweft.operators.ordering import top_per_group
    scores, train, _ = _sets(spark, d)
    recs = top_per_group(scores, ["user"], [F.desc("score"), F.col("item")], 10)
    return recsys.overlap_pct(recs, train)


# -- vector scores ----------------------------------------------------------------------------------------------------

def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"), "label")


def profiles(spark, d):
    """One user per label: the mean of the vectors of that label."""
    parts = _vectors(spark, d).select(F.col("label").cast("bigint").alias("user"), F.posexplode("vec").alias("pos", "v"))
    means = parts.groupBy("user", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    # one value per dimension and user, so the list is as short as a vector
    return means.groupBy("user").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("e")).select("user", F.col("e.v").alias("vec"))


VECTOR_SCORES = {
    "cells": """SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings""",
    "profile": "SELECT label, pos, avg(v) AS v FROM cells GROUP BY label, pos"}


@query("q_dot_scores", """
    SELECT c.label::BIGINT AS "user", c.vec_id AS item, round(sum(c.v * p.v), 6) AS score FROM cells c JOIN profile p
    ON c.label = p.label AND c.pos = p.pos GROUP BY c.label, c.vec_id""", ctes=VECTOR_SCORES)
def dot_scores(spark, d):
    vecs = _vectors(spark, d)
    pairs = vecs.select(F.col("label").cast("bigint").alias("user"), "item")
    scores = recsys.score_pairs(pairs, profiles(spark, d), vecs)
    return scores.select("user", "item", F.round("score", 6).alias("score"))


@query("q_recommend_vectors", """
    SELECT "user", item, round(score, 6) AS score FROM
    (SELECT p.label::BIGINT AS "user", c.vec_id AS item, sum(c.v * p.v) AS score,
            row_number() OVER (PARTITION BY p.label ORDER BY sum(c.v * p.v) DESC, c.vec_id) AS rn
     FROM cells c JOIN profile p ON c.pos = p.pos GROUP BY p.label, c.vec_id) WHERE rn <= 12""", ctes=VECTOR_SCORES)
def recommend_vectors(spark, d):
    recs = recsys.recommend(profiles(spark, d), _vectors(spark, d).select("item", "vec"), 12)
    return recs.select("user", "item", F.round("score", 6).alias("score"))


@query("q_recommend_unknown", """
    SELECT "user", item, round(score, 6) AS score FROM
    (SELECT p.label::BIGINT AS "user", c.vec_id AS item, sum(c.v * p.v) AS score,
            row_number() OVER (PARTITION BY p.label ORDER BY sum(c.v * p.v) DESC, c.vec_id) AS rn
     FROM cells c JOIN profile p ON c.pos = p.pos WHERE c.label <> p.label GROUP BY p.label, c.vec_id) WHERE rn <= 5""", ctes=VECTOR_SCORES)
def recommend_unknown(spark, d):
    """Each profile's own vectors count as known and are left out."""
    vecs = _vectors(spark, d)
    known = vecs.select(F.col("label").cast("bigint").alias("user"), "item")
    recs = recsys.recommend(profiles(spark, d), vecs.select("item", "vec"), 5, known=known)
    return recs.select("user", "item", F.round("score", 6).alias("score"))


@query("q_recommend_pruned", """
    SELECT "user", item, round(score, 6) AS score FROM
    (SELECT p.label::BIGINT AS "user", c.vec_id AS item, sum(c.v * p.v) AS score,
            row_number() OVER (PARTITION BY p.label ORDER BY sum(c.v * p.v) DESC, c.vec_id) AS rn
     FROM cells c JOIN profile p ON c.pos = p.pos GROUP BY p.label, c.vec_id) WHERE rn <= 12""", ctes=VECTOR_SCORES)
def recommend_pruned(spark, d):
    """The same best items, blocks that are too short being skipped."""
    recs = topn.recommend_pruned(profiles(spark, d), _vectors(spark, d).select("item", "vec"), 12).recs
    return recs.select("user", "item", F.round("score", 6).alias("score"))


# -- factor model -----------------------------------------------------------------------------------------------------

def _sides(spark, d):
    """(training rows, training pairs, test pairs) of a leave-one-out split."""
    inter = cut(recsys.interactions(transactions(spark, d)))
    train, test = recsys.leave_one_out(inter, "user_idx", "item_idx", seed=3)
    train, test = cut(train), cut(test)
    as_pairs = lambda df: df.select(F.col("user_idx").cast("bigint").alias("user"), F.col("item_idx").cast("bigint").alias("item"))
    return inter.join(train, ["user_idx", "item_idx"], "left_semi"), as_pairs(train), as_pairs(test)


SIDES_SQL = {
    "pairs": "SELECT DISTINCT customer_id, article_id FROM transactions",
    "per_user": "SELECT customer_id, count(*) AS n FROM pairs GROUP BY customer_id"}


@query("q_als_topn", """
    SELECT CAST(count(*) AS BIGINT) AS n_users, CAST(12 AS BIGINT) AS least, CAST(12 AS BIGINT) AS most, CAST(0 AS BIGINT) AS n_repeated
    FROM per_user WHERE n > 1""", inputs=("transactions",), ctes=SIDES_SQL)
def als_topn(spark, d):
    """Users of the model, fewest and most recommendations of a user, items that a user gets twice."""
    rows, _, _ = _sides(spark, d)
    recs = recsys.recommend(*recsys.factor_vectors(recsys.fit_implicit(rows)), 12)
    each = recs.groupBy("user").agg(F.count("*").alias("n"), F.count_distinct("item").alias("k"))
    return each.agg(F.count("*").alias("n_users"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum(F.col("n") - F.col("k")).alias("n_repeated"))


@query("q_als_auc", "SELECT CAST(count(*) AS BIGINT) AS n_users, true AS in_range FROM per_user", inputs=("transactions",), ctes=SIDES_SQL)
def als_auc(spark, d):
    """No user of the test set is lost, not even without a vector."""
    rows, _, test = _sides(spark, d)
    auc = recsys.auc_all_items(test, *recsys.factor_vectors(recsys.fit_implicit(rows)))
    return auc.agg(F.count("*").alias("n_users"), F.bool_and(F.col("auc").between(0, 1)).alias("in_range"))


@query("q_model_eval", """
    SELECT 'train' AS set, CAST(count(*) AS BIGINT) AS n_users, true AS in_range FROM per_user WHERE n > 1
    UNION ALL SELECT 'test', CAST(count(*) AS BIGINT), true FROM per_user""", inputs=("transactions",), ctes=SIDES_SQL)
def model_eval(spark, d):
    rows, train, test = _sides(spark, d)
    metrics = recsys.evaluate_model(*recsys.factor_vectors(recsys.fit_implicit(rows)), train, test)
    fine = F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & F.col("auc").between(0, 1)
    return metrics.select("set", "n_users", fine.alias("in_range"))


SETTINGS = [{"rank": 30, "reg": 0.05, "iters": 10}, {"rank": 30, "reg": 0.001, "iters": 10}, {"rank": 44, "reg": 0.05, "iters": 10}]
# The loss, rate, factors, epochs and regularisation of each experiment, in its order.
RANKING = [{"loss": loss, "rate": rate, "factors": factors, "epochs": epochs, "reg": reg} for loss, rate, factors, epochs, reg in [
    ("warp", 0.05, 30, 10, 1e-4), ("bpr", 0.05, 30, 10, 1e-4), ("warp", 0.05, 30, 10, 1e-5), ("warp-kos", 0.05, 30, 10, 1e-8),
    ("warp", 0.1, 30, 10, 1e-8), ("warp", 0.01, 30, 10, 1e-8), ("warp", 0.05, 44, 30, 1e-8)]]


@query("q_factor_grid", "SELECT * FROM (VALUES " + ", ".join(
    f"({k}, {s['rank']}, '{part}', true)" for k, s in enumerate(SETTINGS) for part in ("train", "test")) + ") t(pos, rank, set, in_range)")
def factor_grid(spark, d):
    rows, train, test = _sides(spark, d)
    metrics = recsys.factor_grid(cut(rows), train, test, SETTINGS)
    fine = F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & F.col("auc").between(0, 1)
    return metrics.select("pos", "rank", "set", fine.alias("in_range"))


@query("q_ranking_grid")
def ranking_grid(spark, d):
    """Every experiment's loss and settings with its metrics; no SQL computes a fit, tests hold the losses against planted taste."""
    rows, train, test = _sides(spark, d)
    metrics = recsys.factor_grid(cut(rows), train, test, RANKING)
    return metrics.select("pos", *RANKING[0], "set", "n_users", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "auc")])
