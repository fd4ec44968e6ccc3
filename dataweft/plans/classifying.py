"""Queries on linear classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataweft.operators import classify
from dataweft.operators.classify import Line
from dataweft.plans.registry import query
from dataweft.sources.inputs import points, vectors

LINE = Line(1.5, -0.5, 0.02)
M = "label * (1.5 * x + -0.5 * y + 0.02)"
HINGE = f"greatest(0.0, 1 - {M})"


@query("q_margins", f"SELECT vec_id, round({M}, 6) AS margin FROM points", inputs=("points",))
def margins(spark, d):
    return classify.margins(points(spark, d), LINE).select("vec_id", F.round("margin", 6).alias("margin"))


def _loss(spark, d, kind):
    return classify.mean_loss(points(spark, d), LINE, kind).select(F.round("loss", 6).alias("loss"))


@query("q_hinge_loss", f"SELECT round(avg({HINGE}), 6) AS loss FROM points", inputs=("points",))
def hinge_loss(spark, d):
    return _loss(spark, d, "hinge")


@query("q_ramp_loss", f"SELECT round(avg(least(2.0, {HINGE})), 6) AS loss FROM points", inputs=("points",))
def ramp_loss(spark, d):
    return _loss(spark, d, "ramp")


@query("q_hard_margin_loss", f"SELECT round(avg(CASE WHEN {M} < 1 THEN 1.0 ELSE 0.0 END), 6) AS loss FROM points", inputs=("points",))
def hard_margin_loss(spark, d):
    return _loss(spark, d, "hard")


HEIGHT = "((-0.02 - 1.5 * x) / -0.5)"


@query("q_correct_count", f"""
    SELECT 'above' AS rule, CAST(count(CASE WHEN (label = -1 AND y <= {HEIGHT}) OR (label = 1 AND y >= {HEIGHT}) THEN 1 END) AS BIGINT)
           AS correct, CAST(count(*) AS BIGINT) AS total FROM points
    UNION ALL SELECT 'margin', CAST(count(CASE WHEN {M} > 0 THEN 1 END) AS BIGINT), CAST(count(*) AS BIGINT) FROM points""",
       inputs=("points",))
def correct_count(spark, d):
    p = points(spark, d)
    rows = [classify.correct_count(p, LINE, rule).withColumn("rule", F.lit(rule)) for rule in ("above", "margin")]
    return rows[0].unionByName(rows[1])


@query("q_svm_objective", f"""
    SELECT 'hinge' AS loss, 'sum' AS norm, round((1.5 - 0.5) / 2 + 10 * sum({HINGE}), 4) AS objective FROM points
    UNION ALL SELECT 'ramp', 'squared', round((1.5 * 1.5 + 0.5 * 0.5) / 2 + 10 * sum(least(2.0, {HINGE})), 4) FROM points
    UNION ALL SELECT 'hard', 'sum', round((1.5 - 0.5) / 2 + 20 * sum(CASE WHEN {M} < 1 THEN 1.0 ELSE 0.0 END), 4) FROM points""",
       inputs=("points",))
def svm_objective(spark, d):
    p = points(spark, d)
    rows = [classify.objective(p, LINE, 10, kind, norm).select(
        F.lit(kind).alias("loss"), F.lit(norm).alias("norm"), F.round("objective", 4).alias("objective"))
        for kind, norm in (("hinge", "sum"), ("ramp", "squared"), ("hard", "sum"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# Lines measured by the grid queries: one per loss and C.
CS = (0.1, 1.0, 10.0, 100.0)
GRID = [(kind, c, Line(1.0, 0.5 + 0.25 * i - 0.5 * j, 0.01 * j)) for i, kind in enumerate(classify.LOSSES) for j, c in enumerate(CS)]
GRID_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({n}, '{kind}', {c}::DOUBLE, {w.w0}::DOUBLE, {w.w1}::DOUBLE, {w.b}::DOUBLE)" for n, (kind, c, w) in enumerate(GRID)
) + ") t(pos, loss, c, w0, w1, b)"
RESULT_SQL = """
    SELECT pos, loss, c, CAST(count(CASE WHEN (label = -1 AND y <= h) OR (label = 1 AND y >= h) THEN 1 END) AS BIGINT) AS correct,
           avg(CASE loss WHEN 'hinge' THEN greatest(0.0, 1 - m) WHEN 'ramp' THEN least(2.0, greatest(0.0, 1 - m))
               ELSE CASE WHEN m < 1 THEN 1.0 ELSE 0.0 END END) AS mean_loss
    FROM (SELECT *, label * (w0 * x + w1 * y + b) AS m, CASE WHEN w1 <> 0 THEN (-b - w0 * x) / w1 ELSE 0.0 END AS h
          FROM points, lines) GROUP BY pos, loss, c"""


@query("q_grid", "SELECT pos, loss, c, correct, round(mean_loss, 6) AS mean_loss FROM results", inputs=("points",),
       ctes={"lines": GRID_SQL, "results": RESULT_SQL})
def grid(spark, d):
    return classify.grid(points(spark, d), GRID).withColumn("mean_loss", F.round("mean_loss", 6))


@query("q_grid_choice", """
    SELECT loss, c, correct, round(mean_loss, 6) AS mean_loss FROM
    (SELECT *, row_number() OVER (PARTITION BY loss ORDER BY correct DESC, pos) AS rn FROM results) WHERE rn = 1""",
       inputs=("points",), ctes={"lines": GRID_SQL, "results": RESULT_SQL})
def grid_choice(spark, d):
    return classify.choose(classify.grid(points(spark, d), GRID)).select("loss", "c", "correct", F.round("mean_loss", 6).alias("mean_loss"))


@query("q_best_loss", "SELECT loss, c, correct FROM results ORDER BY correct DESC, pos LIMIT 1", inputs=("points",),
       ctes={"lines": GRID_SQL, "results": RESULT_SQL})
def best_loss(spark, d):
    return classify.choose_loss(classify.grid(points(spark, d), GRID)).select("loss", "c", "correct")


PLANE = classify.Plane(tuple(round(0.5 - 0.03 * i, 2) for i in range(64)), 0.02)
WEIGHTS = "[" + ", ".join(map(str, PLANE.w)) + "]::DOUBLE[]"


@query("q_plane_margins", f"""
    SELECT vec_id, round((CASE WHEN label < 5 THEN 1 ELSE -1 END) * (list_inner_product(embedding::DOUBLE[], {WEIGHTS}) + 0.02), 6) AS margin
    FROM embeddings""")
def plane_margins(spark, d):
    """All 64 entries of every vector."""
    return classify.plane_margins(vectors(spark, d), PLANE).select("vec_id", F.round("margin", 6).alias("margin"))


def apart(spark, d):
    """The points moved apart by their label, so that a line separates them."""
    return points(spark, d).withColumn("x", F.col("x") + 3 * F.col("label"))


@query("q_svc_fit", "SELECT CAST(count(*) AS BIGINT) AS correct, CAST(count(*) AS BIGINT) AS total FROM points", inputs=("points",))
def svc_fit(spark, d):
    p = apart(spark, d)
    return classify.correct_count(p, classify.fit_linear_svc(p, 10.0), "margin")


@query("q_plane_fit", "SELECT CAST(count(*) AS BIGINT) AS total, true AS over_half FROM embeddings")
def plane_fit(spark, d):
    p = vectors(spark, d)
    m = classify.plane_margins(p, classify.fit_plane(p, 10.0))
    return m.agg(F.count("*").alias("total"), (F.count_if(F.col("margin") > 0) * 2 > F.count("*")).alias("over_half"))


@query("q_robust_fit", "SELECT CAST(count(*) AS BIGINT) AS correct, CAST(count(*) AS BIGINT) AS total FROM points", inputs=("points",))
def robust_fit(spark, d):
    p = apart(spark, d)
    return classify.correct_count(p, classify.fit_robust_svc(p, 10.0), "margin")


@query("q_fitted_grid", "SELECT * FROM (VALUES ('hinge', true, true), ('ramp', true, true), ('hard', true, true)) t(loss, known_c, over_half)")
def fitted_grid(spark, d):
    """Fit every (loss, C), then choose the C of each loss."""
    p = points(spark, d)
    best = classify.choose(classify.grid(p, classify.fit_grid(p, CS), rule="margin"))
    half = p.select(F.count("*") / 2).scalar()
    return best.select("loss", F.col("c").isin(*CS).alias("known_c"), (F.col("correct") >= half).alias("over_half"))


@query("q_refit", """
    SELECT loss, c, (SELECT CAST(count(*) AS BIGINT) FROM points) AS total, true AS finite FROM results ORDER BY correct DESC, pos LIMIT 1""",
       inputs=("points",), ctes={"lines": GRID_SQL, "results": RESULT_SQL})
def refit(spark, d):
    """The best configuration of the grid, fitted again."""
    p = points(spark, d)
    best = classify.choose_loss(classify.grid(p, GRID)).first()
    line = classify.refit(p, best["loss"], best["c"])
    finite = all(x == x and abs(x) < float("inf") for x in line)
    return classify.correct_count(p, line, "margin").select(F.lit(best["loss"]).alias("loss"), F.lit(best["c"]).alias("c"), "total", F.lit(finite).alias("finite"))
