"""Mixing sources to target weights, as a curriculum over training time. DataFrame functions only.

Every source has a weight and a ramp: at training time t in [0, 1] it is asked for with density
``1 + ramp * (2 t - 1)`` of its target. The integral of that density is its cumulative demand in words. The
documents of a source stand in the order of a digest of their ids; a copy that starts after x words of its source is
due when the demand has reached the middle of the copy, so its position is the inverse of the demand there. Documents
range-sorted by position are the training order.

Defined results: a NULL or empty text has size 0 and takes 0 words; a NULL source is a source of its own and comes
last; rows without an id share the empty id; repeated rows count as often as they occur; an empty table gives an empty
result. Other columns of ``docs`` pass through unless they bear the name of a column made here, which then wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataweft.llm.common import WORD, id_text
from dataweft.session import cut

#: Rows that share the longest prefix of the digest, and digits by which a prefix grows from level to level.
ROWS_PER_PREFIX, DIGITS = 32, 2
MADE = ("size", "source_size", "target", "taken", "copies", "last_words", "positions", "position")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), ramps: Sequence[float] = (-0.5, 0.0, 0.5),
            cap: int = 3) -> DataFrame:
    """(source, source_size) -> also ``target`` in words and ``ramp``; one row per source.

    Weights and ramps go to the sources in code-point order, repeating. All sizes together are shared out by weight; a
    source stops at ``cap`` times its size, and what is left over is shared by weight among the others until none is
    above. That fixed point fills the sources in the order of cap / weight, so one pass over the sorted sources
    finds it. The two windows see one row per source.
    """
    pick = lambda xs, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in xs]), ((F.col("rank") - 1) % len(xs) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name))
    ranked = ranked.select("source", "source_size", pick(weights, "double").alias("weight"), pick(ramps, "double").alias("ramp"),
                           "rank", (F.col("source_size") * cap).alias("most"))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest)
    # The first source that doesn't reach its cap fixes the words per weight of all that follow.
    short = F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level"))
    all_by_room = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.withColumn("level", level).withColumn("level", F.first(short, ignorenulls=True).over(all_by_room))
    target = F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level") * F.col("weight")).otherwise(F.col("most").cast("double"))
    return filled.select("source", "source_size", target.alias("target"), "ramp")


def _words_before(rows: DataFrame, digits: int) -> DataFrame:
    """(source, prefix of ``digits``) -> words of its source in smaller prefixes.

    A running total over a whole source would be one task; here totals go up by ``DIGITS`` digits of the prefix and
    the sums of the parts before come down, so that no window sees more than 16 ** DIGITS rows.
    """
    prefix = lambda n: F.substring("digest", 1, n)
    level = rows.groupBy("source", prefix(digits).alias("digest")).agg(F.sum("size").alias("size"))
    parts = []
    for n in range(digits, 0, -DIGITS):
        parts.append(level)
        level = level.groupBy("source", prefix(n - DIGITS).alias("digest")).agg(F.sum("size").alias("size"))
    found = None
    for n, part in zip(range(DIGITS, digits + 1, DIGITS), reversed(parts), strict=True):
        inside = Window.partitionBy("source", "up").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
        part = part.withColumn("up", prefix(n - DIGITS)).withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        if found is not None:
            up = found.select(F.col("source").alias("s"), F.col("digest").alias("up"), F.col("before").alias("more"))
            part = part.join(up, F.col("source").eqNullSafe(F.col("s")) & (part["up"] == up["up"])).select(
                "source", "digest", (F.col("before") + F.col("more")).alias("before"))
        found = part.select("source", "digest", "before")
    return found


def _digest() -> Column:
    return F.md5(id_text().cast("binary"))


def _check(docs: DataFrame) -> None:
    if lost := {"doc_id", "source", "text"} - set(docs.columns):
        raise ValueError(f"columns {sorted(lost)} are missing")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), ramps: Sequence[float] = (-0.5, 0.0, 0.5), cap: int = 3) -> DataFrame:
    """One row per document without its text, range-sorted by its first position.

    Adds ``size``, ``source_size``, ``target``, ``taken`` (words taken, repeats counted), ``copies`` (whole copies),
    ``last_words`` (words of a further copy that is cut, or 0), ``positions`` (one per copy) and ``position``. The
    target is met to the word: one document of a source may end in a cut copy.
    """
    _check(docs)
    keep = [c for c in docs.columns if c != "text" and c not in MADE]
    rows = cut(docs.select(F.struct(*keep).alias("row"), "doc_id", "source", words(F.col("text")).alias("size"), _digest().alias("digest")))
    placed = _place(rows, rows, weights, ramps, cap)
    return placed.orderBy(F.col("position").asc_nulls_last(), "digest").select("row.*", *MADE)


def training_order(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), ramps: Sequence[float] = (-0.5, 0.0, 0.5),
                   cap: int = 3) -> DataFrame:
    """The mixed corpus: one row per copy with the columns of ``docs``, range-sorted by position. The last copy taken
    of a source may hold only the first words of its document. Texts move twice, by prefix and by position."""
    _check(docs)
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), "doc_id", "source", words(F.col("text")).alias("size"), _digest().alias("digest"))
    stats = cut(rows.drop("row"))
    placed = _place(rows, stats, weights, ramps, cap)
    copies = placed.select("row", "digest", "copies", "last_words", F.posexplode("positions").alias("copy", "position"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1,
                                 F.col("last_words").cast("int")), "")
    text = F.when(F.col("copy") < F.col("copies"), F.col("row.text")).otherwise(first)
    ordered = copies.withColumn("row", F.col("row").withField("text", text)).orderBy("position", "digest", "copy")
    return ordered.select("row.*")


def _place(rows: DataFrame, stats: DataFrame, weights: Sequence[float], ramps: Sequence[float], cap: int) -> DataFrame:
    """``rows`` with their targets, copies and positions; ``stats`` has the same rows and is evaluated several times."""
    n, digits = stats.count(), DIGITS
    while 16**digits * ROWS_PER_PREFIX < n and digits < 30:
        digits += DIGITS
    goal = targets(stats.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ramps, cap)
    start = _words_before(stats, digits).select(F.col("source").alias("s"), F.col("digest").alias("p"), "before")
    start = start.join(goal.withColumnRenamed("source", "g"), F.col("s").eqNullSafe(F.col("g")))
    rows = rows.withColumn("prefix", F.substring("digest", 1, digits))
    inside = Window.partitionBy("source", "prefix").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(start, F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("copies", whole).withColumn("at", F.col("before") + F.col("inside"))
    left = F.floor(F.col("target") + 0.5).cast("long") - F.col("copies") * F.col("source_size") - F.col("at")
    rows = rows.withColumn("part", F.least(F.greatest(left, F.lit(0)), F.col("size")))
    full = (F.col("part") > 0) & (F.col("part") == F.col("size"))
    rows = rows.withColumn("copies", F.col("copies") + full.cast("long")).withColumn("last_words", F.when(full, 0).otherwise(F.col("part")))
    rows = rows.withColumn("taken", F.col("copies") * F.col("size") + F.col("last_words"))
    every = F.col("copies") + (F.col("last_words") > 0).cast("long")

    def due(i: Column) -> Column:
        half = F.when(i < F.col("copies"), F.col("size")).otherwise(F.col("last_words")) / 2
        y = F.when(F.col("target") > 0, F.least((i * F.col("source_size") + F.col("at") + half) / F.col("target"), F.lit(1.0))).otherwise(0.0)
        a = F.col("ramp")
        # The root of a t^2 + (1 - a) t = y in a form that also holds for a = 0.
        return F.when(y > 0, 2 * y / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * y))).otherwise(0.0)

    spots = F.when(every > 0, F.transform(F.sequence(F.lit(0).cast("long"), every - 1), due)).otherwise(F.array().cast("array<double>"))
    return rows.withColumn("positions", spots).withColumn("position", F.try_element_at("positions", F.lit(1)))
