"""Linear classification of points (x, y, label in -1, 1): margins, losses, counts, fits and grids."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataweft.operators.ordering import top_per_group
from dataweft.session import cut, setting

LOSSES = ("hinge", "ramp", "hard")


class Line(NamedTuple):
    """The line w0*x + w1*y + b = 0."""
    w0: float
    w1: float
    b: float


def margin(w0, w1, b) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.col("label") * (as_col(w0) * F.col("x") + as_col(w1) * F.col("y") + as_col(b))


def margins(points: DataFrame, line: Line) -> DataFrame:
    return points.withColumn("margin", margin(*line))


def loss(m: Column, kind: str) -> Column:
    """Loss of a margin: hinge; ramp = hinge cut at 2; hard = 1 when the margin is missed."""
    hinge = F.greatest(F.lit(0.0), 1 - m)
    if kind == "hinge":
        return hinge
    if kind == "ramp":
        return F.least(F.lit(2.0), hinge)
    if kind == "hard":
        return F.when(m < 1, 1.0).otherwise(0.0)
    raise ValueError(f"unknown loss {kind}")


def mean_loss(points: DataFrame, line: Line, kind: str) -> DataFrame:
    return points.agg(F.avg(loss(margin(*line), kind)).alias("loss"))


def placed_right(w0, w1, b, rule: str = "above") -> Column:
    """Whether a point is on its side. ``above`` looks at the height over the line only (0 for a vertical line)
    and so ignores the sign of w1; ``margin`` asks for a margin above 0."""
    if rule == "margin":
        return margin(w0, w1, b) > 0
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    w0, w1, b = as_col(w0), as_col(w1), as_col(b)
    height = F.when(w1 != 0, (-b - w0 * F.col("x")) / F.nullif(w1, F.lit(0.0))).otherwise(0.0)
    return ((F.col("label") == -1) & (F.col("y") <= height)) | ((F.col("label") == 1) & (F.col("y") >= height))


def correct_count(points: DataFrame, line: Line, rule: str = "above") -> DataFrame:
    return points.agg(F.count_if(placed_right(*line, rule)).alias("correct"), F.count("*").alias("total"))


def objective(points: DataFrame, line: Line, c: float, kind: str, norm: str = "sum") -> DataFrame:
    """Value to minimise: ``(w0 + w1) / 2`` (or half the squared norm) plus C times the summed loss; the hard loss
    weighs double."""
    size = (line.w0 + line.w1) / 2 if norm == "sum" else (line.w0 ** 2 + line.w1 ** 2) / 2
    weight = c * (2 if kind == "hard" else 1)
    return points.agg((F.lit(size) + weight * F.sum(loss(margin(*line), kind))).alias("objective"))


def grid(points: DataFrame, lines: Sequence[tuple[str, float, Line]], rule: str = "above") -> DataFrame:
    """Correct points and mean loss of each (loss, C, line), all from one pass over the points."""
    configs = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(kind).alias("loss"), F.lit(float(c)).alias("c"),
                                 F.lit(float(w.w0)).alias("w0"), F.lit(float(w.w1)).alias("w1"), F.lit(float(w.b)).alias("b"))
                        for i, (kind, c, w) in enumerate(lines)])
    rows = points.select("x", "y", "label", F.explode(configs).alias("k"))
    k = lambda n: F.col(f"k.{n}")
    m = margin(k("w0"), k("w1"), k("b"))
    value = F.when(k("loss") == "hinge", loss(m, "hinge")).when(k("loss") == "ramp", loss(m, "ramp")).otherwise(loss(m, "hard"))
    return rows.groupBy(k("pos").alias("pos"), k("loss").alias("loss"), k("c").alias("c")).agg(
        F.count_if(placed_right(k("w0"), k("w1"), k("b"), rule)).alias("correct"), F.avg(value).alias("mean_loss"))


def choose(results: DataFrame) -> DataFrame:
    """Per loss the C with most correct points (the first on ties)."""
    return top_per_group(results, ["loss"], [F.desc("correct"), F.col("pos")], 1)


def choose_loss(results: DataFrame) -> DataFrame:
    """The one (loss, C) with most correct points over all losses (the first on ties)."""
    return results.orderBy(F.desc("correct"), "pos").limit(1)


class Plane(NamedTuple):
    """The plane sum(w_i * v_i) + b = 0 over vectors of any length."""
    w: tuple[float, ...]
    b: float


def plane_margins(points: DataFrame, plane: Plane, vec: str = "vec") -> DataFrame:
    """Margin of every vector; ``label`` is -1 or 1. Entries without a partner count as 0."""
    weights = F.array(*[F.lit(float(x)) for x in plane.w])
    product = F.zip_with(F.col(vec).cast("array<double>"), weights, lambda a, b: F.coalesce(a, F.lit(0.0)) * F.coalesce(b, F.lit(0.0)))
    total = F.aggregate(product, F.lit(0.0), lambda s, x: s + x)
    return points.withColumn("margin", F.col("label") * (total + F.lit(float(plane.b))))


MAX_ITERS = 1000


def _vectors(points: DataFrame, vec: str | None = None) -> DataFrame:
    """(x, y, label, target, features), evaluated once: every step of a fit reads it."""
    from pyspark.ml.functions import array_to_vector
    features = F.array("x", "y") if vec is None else F.col(vec)
    kept = ["x", "y"] if vec is None else []
    rows = points.select(*kept, "label", F.when(F.col("label") == 1, 1.0).otherwise(0.0).alias("target"), features.cast("array<double>").alias("f"))
    return cut(rows).withColumn("features", array_to_vector("f")).drop("f")


def _svc(rows: DataFrame, c: float):
    """(weights, b) of the hinge loss, run to its tolerance; an error if it does not get there."""
    from pyspark.ml.classification import LinearSVC
    n = rows.count()
    model = LinearSVC(featuresCol="features", labelCol="target", regParam=1 / (c * n), maxIter=MAX_ITERS, tol=1e-5, standardization=False).fit(rows)
    found = [*map(float, model.coefficients), float(model.intercept)]
    if not all(map(math.isfinite, found)):
        raise ArithmeticError("the fit has no finite weights")
    if model.summary().totalIterations >= MAX_ITERS:
        raise RuntimeError(f"the fit has not settled after {MAX_ITERS} iterations")
    return tuple(found[:-1]), found[-1]


def _line(fitted) -> Line:
    return Line(*fitted[0], fitted[1])


def fit_linear_svc(points: DataFrame, c: float) -> Line:
    """Hinge-loss separating line for one C."""
    return _line(_svc(_vectors(points), c))


def fit_plane(points: DataFrame, c: float, vec: str = "vec") -> Plane:
    """Hinge-loss separating plane over all entries of the vectors."""
    return Plane(*_svc(_vectors(points, vec), c))


def fit_robust_svc(points: DataFrame, c: float, cut_off: float = -1.0, start: Line | None = None) -> Line:
    """Line for losses that stop growing: from the hinge line on, points with a margin below ``cut_off`` are left out
    until the set of them has been left out before; a set whose fit fails or that leaves one label keeps the line before."""
    return _robust(_vectors(points), c, cut_off, start)


def _robust(rows: DataFrame, c: float, cut_off: float, start: Line | None) -> Line:
    line, seen = start or _line(_svc(rows, c)), set()
    while True:
        low = margin(*line) < cut_off
        now = tuple(rows.agg(F.count_if(low), F.bit_xor(F.when(low, F.xxhash64("x", "y", "label"))), F.count_distinct(F.when(~low, F.col("label")))).first())
        if now in seen or now[2] < 2 or now[0] == 0:
            return line
        seen.add(now)
        try:
            line = _line(_svc(rows.where(~low), c))
        except ArithmeticError:
            return line


CUT_OFF = {"ramp": -1.0, "hard": 0.0}
#: Rounds after which a fit of several lines counts as not settled, its relative tolerance, and the least distance from the margin that a
#: point's weight takes as its own.
MAX_ROUNDS, TOLERANCE, LEAST = 300, 1e-6, 1e-6
#: A round tries each line's next step at these lengths.
LENGTHS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)


def _sums(rows: DataFrame, tried: Sequence[tuple[int, float, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each (number, cap, line): the summed capped hinge loss, and the matrix and right side of its next least squares.

    One pass over the points for all lines: each task sums its own rows, ten numbers a line leave it.
    """
    lines = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(cap).alias("cap"), *[F.lit(float(v)).alias(n) for n, v in zip(("w0", "w1", "b"), w, strict=True)])
                      for k, cap, w in tried])
    each = rows.select("x", "y", "label", F.explode(lines).alias("l"))
    gap = 1 - F.col("label") * (F.col("l.w0") * F.col("x") + F.col("l.w1") * F.col("y") + F.col("l.b"))
    each = each.select("l.k", "l.cap", "x", "y", "label", gap.alias("gap"))
    hinge = F.greatest(F.lit(0.0), F.col("gap"))
    near = F.greatest(F.abs("gap"), F.lit(LEAST))
    # hinge(g) = (g + |g|) / 2, and |g| lies under (g^2 / d + d) / 2 with d = |g| now; a capped point stays at its cap.
    weight = F.when(hinge < F.col("cap"), 1 / near).otherwise(0.0)
    pull = F.when(hinge < F.col("cap"), (1 / near + 1) * F.col("label")).otherwise(0.0)
    sums = {"loss": F.least(hinge, F.col("cap")), "n": F.lit(1.0), "sw": weight, "sx": weight * F.col("x"), "sy": weight * F.col("y"), "sxx": weight * F.col("x") * F.col("x"),
            "sxy": weight * F.col("x") * F.col("y"), "syy": weight * F.col("y") * F.col("y"), "p": pull, "px": pull * F.col("x"), "py": pull * F.col("y")}
    with setting(rows.sparkSession, "spark.sql.adaptive.enabled", "false"):  # a row per line: one job without plans in between
        found = each.groupBy("k").agg(*[F.sum(e).alias(n) for n, e in sums.items()]).collect()
    out: list = [None] * len(tried)
    for r in found:
        out[r["k"]] = (r["loss"], np.array([[r["sxx"], r["sxy"], r["sx"]], [r["sxy"], r["syy"], r["sy"]], [r["sx"], r["sy"], r["sw"]]]), np.array([r["px"], r["py"], r["p"]]))
    return out


def _fit_lines(rows: DataFrame, settings: Sequence[tuple[float, float]], start: Sequence[Line] | None = None) -> list[Line]:
    """The line of each (C, cap): half its squared slope plus C times the summed hinge loss, cut at the cap, is brought down until it stays.

    All settings move together, one job a round. A round replaces each loss by the parabola that touches it from above (a constant for
    points beyond the cap), whose minimum never raises the objective, and also tries longer steps in that direction.
    """
    slope = np.diag([1.0, 1.0, 0.0])
    n = len(settings)
    tried = [np.zeros((1, 3)) if start is None else np.array([start[k]]) for k in range(n)]
    line, value, calm = [t[0] for t in tried], [math.inf] * n, [0] * n
    for _ in range(MAX_ROUNDS):
        going = [k for k in range(n) if calm[k] < 2]
        if not going:
            return [Line(*map(float, w)) for w in line]
        flat = [(k, w) for k in going for w in tried[k]]
        sums = _sums(rows, [(i, settings[k][1], w) for i, (k, w) in enumerate(flat)])
        if not any(sums):
            raise ValueError("no points to fit")
        for k in going:
            c = settings[k][0]
            mine = [(w @ slope @ w / 2 + c * s[0], i) for i, ((j, w), s) in enumerate(zip(flat, sums, strict=True)) if j == k]
            if not all(math.isfinite(v) for v, _ in mine):
                raise ArithmeticError("the fit has no finite weights")
            best, at = min(mine)
            calm[k] = calm[k] + 1 if best >= value[k] - TOLERANCE * max(1.0, abs(value[k])) else 0
            if best < value[k]:
                value[k], line[k] = best, flat[at][1]
            matrix, side = sums[at][1:]
            target = np.linalg.lstsq(slope + c / 2 * matrix, c / 2 * side, rcond=None)[0]
            tried[k] = np.array([flat[at][1] + t * (target - flat[at][1]) for t in LENGTHS])
    raise RuntimeError(f"the fit has not settled after {MAX_ROUNDS} rounds")


def fit_grid(points: DataFrame, cs: Sequence[float], losses: Sequence[str] = LOSSES) -> list[tuple[str, float, Line]]:
    """One fitted line per (loss, C), ready for ``grid``, all of them in the same rounds over the points.

    The hinge line of a C is where its other losses start; those leave points out beyond a margin of ``CUT_OFF``, as ``fit_robust_svc``.
    """
    rows = cut(points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("label").cast("double").alias("label")))
    hinge = _fit_lines(rows, [(c, math.inf) for c in cs])
    lines = {("hinge", c): w for c, w in zip(cs, hinge, strict=True)}
    other = [(kind, k) for kind in losses if kind != "hinge" for k in range(len(cs))]
    capped = _fit_lines(rows, [(cs[k], 1 - CUT_OFF[kind]) for kind, k in other], [hinge[k] for _, k in other]) if other else []
    lines |= {(kind, cs[k]): w for (kind, k), w in zip(other, capped, strict=True)}
    return [(kind, c, lines[kind, c]) for kind in losses for c in cs]


def refit(points: DataFrame, kind: str, c: float) -> Line:
    """The chosen configuration fitted again, as a rule on a larger set, by the rounds of ``fit_grid``: a job each, as few on many points."""
    return fit_grid(points, (c,), (kind,))[0][2]
