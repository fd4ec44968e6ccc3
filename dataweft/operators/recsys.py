"""Recommender preparation, splits, factor models, scoring and ranking metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from datetime import date
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataweft.functions.scalars import dot
from dataweft.operators import clean, rel
from dataweft.operators.ordering import running_total, top_per_group
from dataweft.operators.profile import date_span
from dataweft.operators.ranking import Setting, fit_rankings
from dataweft.session import cut, shared_dir, shuffles_go, sweep, swept

# Columns whose combination makes articles interchangeable.
ARTICLE_GROUP = ["product_type_name", "index_group_name", "garment_group_name", "department_name",
                 "perceived_colour_value_name"]
# The age groups.
AGE_EDGES = [20, 25, 30, 40, 50]
AGE_LABELS = ["<20", "20-25", "25-30", "30-40", "40-50", "50+"]
#: Blocks of users and of items that a product of all with all is cut into, and the least and most rows of a block.
USER_BLOCKS, ITEM_BLOCKS, LEAST_ROWS, MOST_ROWS = 32, 4, 4096, 500_000
#: Blocks of either side in a fit, at least, and the bytes that a task of it holds, about.
FIT_BLOCKS, FIT_BYTES = 10, 400 << 20
#: Users and items whose scores a task holds at a time.
TILE_USERS, TILE_ITEMS = 32, 8192
#: True items of a user that go in one row, and true items up to which scores are counted without a sort.
OWN_SLICE, FEW = 1000, 2


# -- features ---------------------------------------------------------------------------------------------------------

def customer_recency(tx: DataFrame) -> DataFrame:
    """First day, last day and number of distinct days per customer."""
    days = tx.groupBy("customer_id", "t_dat").agg(F.lit(1).alias("_d"))
    return days.groupBy("customer_id").agg(F.min("t_dat").alias("t_dat_min"), F.max("t_dat").alias("t_dat_max"),
                                           F.sum("_d").cast("int").alias("ct_carts"))


def _mean(c: str) -> Column:
    """Mean of exact decimals: one division of two exact numbers, whatever the order of rows."""
    return F.sum(c).cast("double") / F.count(c)


def price_stats(tx: DataFrame) -> DataFrame:
    return tx.groupBy("customer_id").agg(F.min("price").cast("double").alias("price_min"), _mean("price").alias("price_mean"),
                                         F.max("price").cast("double").alias("price_max"))


def basket_stats(tx: DataFrame) -> DataFrame:
    """Least, mean and largest basket, a basket being a customer's purchases of one day."""
    baskets = tx.groupBy("customer_id", "t_dat").agg(F.sum("price").alias("v"))
    return baskets.groupBy("customer_id").agg(
        F.min("v").cast("double").alias("cart_value_min"), _mean("v").alias("cart_value_mean"),
        F.max("v").cast("double").alias("cart_value_max"))


def customer_features(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """Recency, price and basket features per customer, 0 baskets for customers without purchases.

    All features come from one reduction to customer-days and one to customers, so purchases travel once.
    """
    days = tx.groupBy("customer_id", "t_dat").agg(
        F.min("price").alias("lo"), F.max("price").alias("hi"), F.sum("price").alias("v"), F.count("price").alias("n"))
    stats = days.groupBy("customer_id").agg(
        F.min("t_dat").alias("t_dat_min"), F.max("t_dat").alias("t_dat_max"), F.count("*").cast("int").alias("ct_carts"),
        F.min("lo").cast("double").alias("price_min"), (F.sum("v").cast("double") / F.sum("n")).alias("price_mean"),
        F.max("hi").cast("double").alias("price_max"), F.min("v").cast("double").alias("cart_value_min"),
        (F.sum("v").cast("double") / F.count("v")).alias("cart_value_mean"), F.max("v").cast("double").alias("cart_value_max"))
    return customers.join(stats, "customer_id", "left").fillna({"ct_carts": 0})


def merge_full(tx: DataFrame, customers: DataFrame, articles: DataFrame) -> DataFrame:
    """Purchases with all customer and article columns."""
    return rel.enrich(tx, {"customer_id": customers, "article_id": articles})


def merge_reduced(tx: DataFrame, customers: DataFrame, articles: DataFrame,
                  article_cols: Sequence[str] = ARTICLE_GROUP) -> DataFrame:
    """Purchases with all customer columns and the grouping columns of the article."""
    return merge_full(tx, customers, articles.select("article_id", *article_cols))


# -- preparation ------------------------------------------------------------------------------------------------------

def best_sellers(tx: DataFrame, articles: DataFrame, keys: Sequence[str] = ARTICLE_GROUP) -> DataFrame:
    """The most bought article of each group, the smallest id on ties. Sales are counted before the join."""
    sold = tx.groupBy("article_id").agg(F.count("*").alias("transaction_count"))
    counts = sold.join(articles.select("article_id", *keys), "article_id").dropna(subset=list(keys))
    best = F.min_by(F.struct("article_id", "transaction_count"), F.struct(-F.col("transaction_count"), "article_id"))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def recent_items(tx: DataFrame, last_day: Column | date) -> DataFrame:
    """Articles bought within one year before ``last_day``."""
    last_day = F.lit(last_day) if isinstance(last_day, date) else last_day
    return tx.where(F.col("t_dat") >= F.add_months(last_day, -12)).select("article_id").distinct()


class Windows(NamedTuple):
    """Calendar windows to leave out."""
    one_off: tuple[date, date] = (date(2020, 3, 15), date(2020, 5, 15))
    yearly: tuple[tuple[int, int], tuple[int, int]] = ((12, 10), (12, 25))


def fill_customers(customers: DataFrame) -> DataFrame:
    """No gaps in the flags, one spelling of a flag that is not set."""
    df = clean.fill(customers, {"FN": 0.0, "club_member_status": "None"})
    df = clean.replace_values(df, "fashion_news_frequency", {"NONE": "None"})
    return clean.fill(df, {"fashion_news_frequency": "None"})


def clean_customers(customers: DataFrame) -> DataFrame:
    """Fill, unify and derive customer columns."""
    df = clean.impute_mean(fill_customers(customers), "age")
    return df.withColumn("age_group", clean.bucket("age", AGE_EDGES, AGE_LABELS))


def clean_articles(articles: DataFrame) -> DataFrame:
    df = clean.fill(clean.dedupe(articles), {"detail_desc": "Not Available"})
    return clean.drop_sentinels(df, {"garment_group_name": ["Unknown"],
                                     "perceived_colour_value_name": ["Unknown", "Undefined"]})


def frequent_articles(articles: DataFrame, min_rows: int = 3, top_groups: int = 10, min_share: float = 1.0) -> DataFrame:
    """Articles of frequent types in the largest groups; shares count all rows of the input."""
    kept = rel.keep_frequent(articles, "product_type_name", min_rows)
    kept = rel.keep_top(kept, "product_group_name", top_groups)
    return rel.keep_share(kept, articles, "product_type_name", min_share)


def prepare(tx: DataFrame, customers: DataFrame, articles: DataFrame, windows: Windows = Windows(),
            sample: float = 0.9, sample_order: Sequence[str | Column] | None = None, min_purchases: int = 4) -> DataFrame:
    """The whole preparation of purchases, in its order of steps."""
    tx = cut(clean.drop_null_keys(tx, ["customer_id", "article_id", "t_dat"]))  # the facts are read once
    last = date_span(tx, "t_dat").select("last").scalar()
    windowed = clean.exclude_window(tx, "t_dat", *windows.one_off)
    windowed = clean.exclude_yearly(windowed, "t_dat", *windows.yearly, span=tx)

    people = clean.keep_any(clean_customers(customers), ["fashion_news_frequency", "club_member_status"]).drop("FN", "Active")
    order = sample_order or [F.xxhash64("customer_id", F.lit(1)), F.col("customer_id")]
    people = rel.stratified_sample(people, "age_group", sample, order)
    goods = cut(frequent_articles(cut(clean_articles(articles))))

    sellers = best_sellers(windowed, goods).select("article_id")
    bought = cut(rel.semi(windowed, sellers, "article_id"))  # used three times below
    active = rel.keep_active(bought, "customer_id", min_purchases)
    recent = recent_items(active, last)
    kept = rel.semi(active, people.select("customer_id"), "customer_id")
    return merge_full(rel.semi(kept, recent, "article_id"), people, goods)


# -- interactions and splits ------------------------------------------------------------------------------------------

def interactions(tx: DataFrame, user: str = "customer_id", item: str = "article_id") -> DataFrame:
    """Purchases per (user, item) with dense ids; repeated purchases add up."""
    pairs = cut(tx.groupBy(user, item).agg(F.count("*").alias("n")))
    return clean.dense_ids(pairs, {user: "user_idx", item: "item_idx"})


def interaction_shape(tx: DataFrame, user: str = "customer_id", item: str = "article_id") -> DataFrame:
    """Users, items, filled cells and density of the user-item table, which itself is never built."""
    one = tx.agg(F.countDistinct(user).alias("n_users"), F.countDistinct(item).alias("n_items"),
                 F.countDistinct(user, item).alias("n_pairs"))
    return one.withColumn("density", F.col("n_pairs") / (F.col("n_users") * F.col("n_items")))


def random_split(df: DataFrame, test_fraction: float, keys: Sequence[str], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a seeded hash of the keys: the same rows on every run and after a lost task."""
    draw = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000))
    limit = int(round(test_fraction * 1_000_000))
    return df.where(draw >= limit), df.where(draw < limit)


def leave_one_out(pairs: DataFrame, user: str, item: str, order: Sequence[str | Column] | None = None,
                  seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): one item per user goes to test; a user's only item too. ``pairs`` are distinct."""
    order = order or [F.xxhash64(user, item, F.lit(seed)), F.col(item)]
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    picked = F.min(F.struct(*[k.alias(f"_o{i}") for i, k in enumerate(keys)], F.col(item).alias("_item")))
    test = pairs.groupBy(user).agg(picked.alias("_p")).select(user, F.col("_p._item").alias(item))
    return pairs.select(user, item).join(test, [user, item], "left_anti"), test


# -- model and scores -------------------------------------------------------------------------------------------------

def _fit_blocks(n_pairs: int, n_users: int, n_items: int, rank: int) -> int:
    """Blocks of either side in a fit, so that what a task holds, a block's pairs and the other side's vectors that they name, stays near ``FIT_BYTES``."""
    blocks = FIT_BLOCKS
    while 60 * n_pairs / blocks + (4 * rank + 24) * min(n_pairs / blocks, max(n_users, n_items)) > FIT_BYTES:
        blocks += max(1, blocks // 10)
    return blocks


def fit_implicit(train: DataFrame, rank: int = 16, reg: float = 0.05, alpha: float = 10.0, iters: int = 10, seed: int = 0):
    """Factor model of implicit feedback over (user_idx, item_idx, n).

    Every round cuts the lineage and the driver collects its garbage meanwhile, as shuffle files of rounds stay until then.
    """
    from pyspark.ml.recommendation import ALS
    shared_dir(train.sparkSession)  # without a folder rounds have no checkpoints
    n_pairs, n_users, n_items = train.agg(F.count("*"), F.approx_count_distinct("user_idx"), F.approx_count_distinct("item_idx")).first()
    blocks = _fit_blocks(n_pairs, n_users, n_items, rank)
    als = ALS(userCol="user_idx", itemCol="item_idx", ratingCol="n", implicitPrefs=True, rank=rank, regParam=reg, alpha=alpha, maxIter=iters, seed=seed,
              coldStartStrategy="drop", numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=1)
    with swept(train.sparkSession):
        return als.fit(train)


def score_pairs(pairs: DataFrame, user_vecs: DataFrame, item_vecs: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """Dot product for the given (user, item) pairs; vectors are in column ``vec``."""
    u = user_vecs.select(user, F.col("vec").alias("_u"))
    i = item_vecs.select(item, F.col("vec").alias("_i"))
    return pairs.join(u, user).join(i, item).withColumn("score", dot(F.col("_u"), F.col("_i"))).drop("_u", "_i")


def _n_blocks(n: int, block: int | None, most: int) -> int:
    """Number of blocks of ``n`` rows: by ``block`` if given, else ``most`` of them unless they get too small or too large."""
    return max(1, math.ceil(n / (block or min(MOST_ROWS, max(LEAST_ROWS, math.ceil(n / most))))))


def _dealt(left: DataFrame, left_key: str, right: DataFrame, right_key: str, block: int | None) -> tuple[DataFrame, DataFrame, int, int]:
    """``_cells`` and the number of blocks of either side."""
    n_left = _n_blocks(left.count(), block, USER_BLOCKS)
    n_right = _n_blocks(right.count(), block, ITEM_BLOCKS)

    def cells(df, key, own, other, n_own, n_other):
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    return cells(left, left_key, "_lb", "_rb", n_left, n_right), cells(right, right_key, "_rb", "_lb", n_right, n_left), n_left, n_right


def _cells(left: DataFrame, left_key: str, right: DataFrame, right_key: str, block: int | None) -> tuple[DataFrame, DataFrame]:
    """Both sides cut into blocks of about ``block`` rows, every row once for each block of the other side.

    Without ``block`` their number stays as the tables grow, so that what travels grows no faster than they do.
    """
    return _dealt(left, left_key, right, right_key, block)[:2]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _first(row: np.ndarray, ids: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best of each row, best first, equal scores by id."""
    order = np.lexsort((ids, -score, row))
    own = row[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < n]


class Goods:
    """A block of items, their vectors as columns."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray):
        self.ids, self.sort = ids, np.argsort(ids, kind="stable")
        self.columns = np.ascontiguousarray(vecs.T)

    def place(self, items: np.ndarray) -> np.ndarray:
        """Where the items stand, -1 for those of other blocks."""
        place = self.sort[np.minimum(np.searchsorted(self.ids, items, sorter=self.sort), len(self.ids) - 1)]
        return np.where(self.ids[place] == items, place, -1)


class Own(NamedTuple):
    """True scores of the rows of a tile side by side: their number in each row, scores and items."""
    sizes: np.ndarray
    score: np.ndarray
    item: np.ndarray


def _survey(goods: Goods, x: np.ndarray, n: int, known: tuple[np.ndarray, np.ndarray] | None = None,
            own: Own | None = None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """((row, place, score) of the ``n`` best items of each row of ``x`` without those at ``known`` (row, place),
    twice the items below each of the true scores, a draw counting once and the true item itself not at all).

    Products are made once, in tiles of items. They are sorted in single precision, as rounding keeps their order; what rounds to the
    same as a true score is compared in double precision.
    """
    n_users, n_items = len(x), len(goods.ids)
    wins, most = np.zeros(0 if own is None else len(own.score), np.int64), 0
    if own is not None:
        row, ends, most = np.repeat(np.arange(n_users), own.sizes), np.cumsum(own.sizes), own.sizes.max(initial=0)
        order = np.lexsort((own.score, row))  # sorted keys are found faster
        score = own.score[order]
        slack = 1e-12 + 1e-9 * np.abs(score)
        low, high = score - slack, score + slack
        place = goods.place(own.item[order]) if n_items else np.full(len(row), -1)
        with np.errstate(over="ignore"):
            below, above = low.astype(np.float32), high.astype(np.float32)
            over = np.where(above < np.inf, np.nextafter(above, np.float32(np.inf)), np.float32(np.nan))  # the next larger key, beyond infinity NaN
        keys = [np.concatenate((below[e - m:e], over[e - m:e])) for e, m in zip(ends, own.sizes, strict=True)] if most > FEW else []
    best, new = (np.zeros(0, int), np.zeros(0, int), np.zeros(0)), []
    least = np.full(n_users, -np.inf)
    tiles = range(0, n_items, TILE_ITEMS)
    for k, at in enumerate(tiles):
        s = x @ goods.columns[:, at:at + TILE_ITEMS]
        small = None
        if most > FEW:
            with np.errstate(over="ignore"):
                small = s.astype(np.float32)
            small.sort(axis=1)
        if n:
            some = np.arange(n_users)
            if known is not None:
                here = (known[1] >= at) & (known[1] < at + s.shape[1])
                s[known[0][here], known[1][here] - at] = -np.inf
            elif small is not None:  # rows that hold nothing new are passed over
                if k == 0 and s.shape[1] > n:
                    least = np.nextafter(small[:, -n], np.float32(-np.inf)).astype(np.float64)
                some = np.flatnonzero(~(small[:, -1] < least.astype(np.float32)))
            if small is None and k == 0 and s.shape[1] > n:
                least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
            r, c = np.divmod(np.flatnonzero((s if len(some) == n_users else s[some]) >= least[some, None]), s.shape[1])
            r = some[r]
            found = s[r, c]
            fine = found > -np.inf
            new.append((r[fine], c[fine] + at, found[fine]))
            if k & (k + 1) == 0 or k == len(tiles) - 1:  # after 1, 2, 4, ... tiles
                r, c, found = (np.concatenate(p) for p in zip(best, *new, strict=True))
                kept, new = _first(r, goods.ids[c], found, n), []
                best = r[kept], c[kept], found[kept]
                full = np.flatnonzero(np.bincount(best[0], minlength=n_users) == n)
                least[full] = best[2][np.searchsorted(best[0], full, side="right") - 1]
        if not most:
            continue
        here = np.flatnonzero((place >= at) & (place < at + s.shape[1]))
        self_ = s[row[here], place[here] - at]  # a true item is not compared with itself
        if small is None:
            for j in range(most):
                some = np.flatnonzero(own.sizes > j)
                i = ends[some] - own.sizes[some] + j
                part = s if len(some) == n_users else s[some]
                wins[i] += np.count_nonzero(part < low[i, None], axis=1) + np.count_nonzero(part <= high[i, None], axis=1)
            wins[here] -= (self_ < low[here]).astype(int) + (self_ <= high[here])
            continue
        less, more = np.empty(len(wins), np.int64), np.empty(len(wins), np.int64)
        for z, key, e, m in zip(small, keys, ends.tolist(), own.sizes.tolist(), strict=True):
            got = z.searchsorted(key)
            less[e - m:e], more[e - m:e] = got[:m], got[m:]
        wins += 2 * less
        between = more - less  # items that round to a true score or lie as near
        between[here[(between[here] == 1) & (self_ >= low[here]) & (self_ <= high[here])]] = 0  # the true item alone
        for i in np.flatnonzero(between).tolist():
            z = s[row[i]]
            wins[i] += np.count_nonzero(z < low[i]) + np.count_nonzero(z <= high[i]) - 2 * less[i]
            if at <= place[i] < at + s.shape[1]:
                z = z[place[i] - at]
                wins[i] -= int(z < low[i]) + int(z <= high[i])
    if own is not None:
        wins[order] = wins.copy()
    return best, wins


def _known(goods: Goods, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the known items that are in the block."""
    rows = np.repeat(np.arange(len(own)), [len(k) for k in own])
    place = goods.place(np.concatenate(own)) if len(goods.ids) else np.full(len(rows), -1)
    return rows[place >= 0], place[place >= 0]


def best_items(n: int):
    """Best items of each user of one block among the items of another, without those in ``_known``."""
    def best(users: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        found = []
        goods = Goods(items["item"].to_numpy(), _matrix(items["vec"])) if len(items) else None
        for at in range(0, len(users) if goods else 0, TILE_USERS):
            chunk = users.iloc[at:at + TILE_USERS]
            known = None
            if "_known" in users:
                known = _known(goods, [np.asarray([] if k is None else k, goods.ids.dtype) for k in chunk["_known"]])
            (row, col, score), _ = _survey(goods, _matrix(chunk["vec"]), n, known)
            found.append((chunk["user"].to_numpy()[row], goods.ids[col], score))
        parts = zip(*found, strict=True) if found else ([], [], [])
        return pd.DataFrame({c: np.concatenate(p) if found else p for c, p in zip(("user", "item", "score"), parts, strict=True)})
    return best


def _wins(key: tuple, left: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
    """For each row of a user's true scores: twice the items of a block below them, a draw counting once, and in the first block their number."""
    goods = Goods(items["item"].to_numpy(), _matrix(items["vec"])) if len(items) else None
    wins = np.zeros(len(left), np.int64)
    for at in range(0, len(left) if goods else 0, TILE_USERS):
        chunk = left.iloc[at:at + TILE_USERS]
        own = Own(np.array([len(o) for o in chunk["scores"]]), np.concatenate(list(chunk["scores"])), np.concatenate(list(chunk["items"])))
        _, each = _survey(goods, _matrix(chunk["vec"]), 0, own=own)
        wins[at:at + len(chunk)] = np.bincount(np.repeat(np.arange(len(chunk)), own.sizes), each, len(chunk))
    n = [len(o) if key[1] == 0 else 0 for o in left["scores"]]
    return pd.DataFrame({"user": left["user"].to_numpy(), "wins": wins, "p": np.array(n, np.int64)})


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, entries side by side) of a column of lists, NULL counting as empty."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _vectors(column: pa.Array) -> np.ndarray:
    sizes, flat = _lists(column)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return flat.astype(np.float64).reshape(len(sizes), -1)


def _meet(n: int, n_sets: int):
    """Work of one cell: its items come first, then its users in batches, each of which leaves as one row.

    A row holds the ``n`` best items with score and the sets that they are in, and for each set twice the items below its true items.
    """
    def rows(goods: Goods, batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        x = _vectors(batch.column("vec"))
        sizes, ids = _lists(batch.column("items"))
        masks = _lists(batch.column("sets"))[1] if n_sets else None
        known = own = None
        if n_sets:
            own = Own(sizes, _lists(batch.column("scores"))[1].astype(np.float64), ids)
        elif len(ids):
            known = _known(goods, np.split(ids, np.cumsum(sizes)[:-1]))
        (row, col, score), each = _survey(goods, x, n, known, own)
        of = np.repeat(np.arange(len(x)), sizes)
        mark = np.zeros(len(row), np.int64)
        if n_sets and len(row):  # the true items of a row are in it, those of a user's other rows are marked there
            place = goods.place(ids)
            key = of[place >= 0] * len(goods.ids) + place[place >= 0]
            order = np.argsort(key)
            want = row * len(goods.ids) + col
            if len(key):
                at = order[np.minimum(np.searchsorted(key, want, sorter=order), len(key) - 1)]
                mark = np.where(key[at] == want, masks[place >= 0][at], 0)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(x))))).astype(np.int32)
        lists = lambda values, at, kind: pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
        per_set = np.stack([np.bincount(of, each * (masks >> k & 1), len(x)) for k in range(n_sets)], 1).ravel().astype(np.int64) if n_sets else []
        kinds = {f.name: f.type for f in schema}
        return pa.RecordBatch.from_arrays([batch.column("user"), lists(goods.ids[col], offsets, kinds["item"]), lists(score, offsets, pa.float64()), lists(mark, offsets, pa.int64()),
                                           lists(per_set, np.arange(len(x) + 1, dtype=np.int32) * n_sets, pa.int64())], names=["user", "items", "scores", "sets", "wins"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, goods = [], [], None
        for batch in batches:
            is_item = pc.equal(batch.column("kind"), 0)
            items = batch.filter(is_item)
            if items.num_rows:
                ids.append(items.column("item").to_numpy(zero_copy_only=False))
                vecs.append(_vectors(items.column("vec")))
            users = batch.filter(pc.invert(is_item)) if items.num_rows else batch
            if users.num_rows and ids and goods is None:
                goods = Goods(np.concatenate(ids), np.concatenate(vecs))
                vecs.clear()
            for at in range(0, users.num_rows if goods else 0, TILE_USERS):
                yield rows(goods, users.slice(at, TILE_USERS), batch.schema)
    return work


def _all_scored(users: DataFrame, items: DataFrame, n: int, n_sets: int, block: int | None, user_type: str = "bigint", item_type: str = "bigint") -> DataFrame:
    """``users`` (user, vec, items and with sets scores and sets) against all of ``items`` (item, vec): a row of ``_meet`` per row and block of items.

    Every cell of a user block and an item block is a task of its own, which holds the items and reads the users in batches. Each user travels
    once per block of items and each item once per block of users; without ``block`` (rows of a block) there are at most
    ``ITEM_BLOCKS`` and ``USER_BLOCKS`` of them until blocks have ``MOST_ROWS`` rows.
    """
    kind = "array<float>" if all(dict(df.dtypes)["vec"] == "array<float>" for df in (users, items)) else "array<double>"
    key = "row" if "row" in users.columns else "user"
    a, b, n_left, n_right = _dealt(users, key, items.select("item", "vec"), "item", block)
    cell = (F.col("_lb") * n_right + F.col("_rb")).alias("cell")
    lists = {"items": f"array<{item_type}>", "scores": "array<double>", "sets": "array<int>"}
    # empty lists instead of NULL: Arrow's writer goes through all NULL lists of a batch again with every row
    empty = lambda t: F.array().cast(t)
    given = lambda c, t: (F.coalesce(F.col(c).cast(t), empty(t)) if c in users.columns else empty(t)).alias(c)
    a = a.select(cell, F.lit(1).alias("kind"), F.col("user").cast(user_type), F.lit(None).cast(item_type).alias("item"), F.col("vec").cast(kind), *[given(c, t) for c, t in lists.items()])
    b = b.select(cell, F.lit(0).alias("kind"), F.lit(None).cast(user_type).alias("user"), F.col("item").cast(item_type), F.col("vec").cast(kind), *[empty(t).alias(c) for c, t in lists.items()])
    met = b.unionByName(a).repartitionById(n_left * n_right, F.col("cell")).sortWithinPartitions("kind").drop("cell")
    return met.mapInArrow(_meet(n, n_sets), f"user {user_type}, items array<{item_type}>, scores array<double>, sets array<bigint>, wins array<bigint>")


def _rows_of(met: DataFrame, *names: str) -> DataFrame:
    """The lists of the best items as rows."""
    return met.select("user", F.inline(F.arrays_zip(*names)))


def recommend(user_vecs: DataFrame, item_vecs: DataFrame, n: int, known: DataFrame | None = None,
              block: int | None = None, user_type: str = "bigint", item_type: str = "bigint") -> DataFrame:
    """The ``n`` best items of each user over all items, by a matrix product per pair of blocks.

    A task returns ``n`` rows per user, so the full score table never exists. ``known`` (user, item) pairs travel with their user and are
    masked in the blocks of their items.
    """
    users = user_vecs.select("user", "vec")
    if known is not None:
        lists = known.select("user", "item").distinct().groupBy("user").agg(F.collect_list("item").alias("items"))
        users = users.join(lists, "user", "left")
    met = _all_scored(users, item_vecs, n, 0, block, user_type, item_type)
    found = _rows_of(met, "items", "scores").toDF("user", "item", "score").repartition("user")
    return top_per_group(found, ["user"], [F.desc("score"), F.col("item")], n)


def _surveyed(pairs: DataFrame, user_vecs: DataFrame, item_vecs: DataFrame, n: int, n_sets: int, block: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows of ``_meet``, users with ``wins_k`` and the number ``p_k`` of scored items of each set) for distinct true (user, item, sets): bit k of ``sets`` says that a pair is in the k-th set.

    A user's true items travel together, in rows of about ``OWN_SLICE`` of them. The items' vectors meet the pairs before the users' do, so that
    what is then dealt by user stays so.
    """
    vecs = user_vecs.select("user", "vec")
    slices = pairs.groupBy("user").agg(F.count("*").alias("_all")).where(F.col("_all") > OWN_SLICE).select(
        "user", F.ceil(F.col("_all") / OWN_SLICE).alias("_slices"))
    near = pairs.join(item_vecs.select("item", F.col("vec").alias("_i")), "item").join(vecs, "user").join(slices, "user", "left")
    part = F.coalesce(F.pmod(F.xxhash64("item"), F.col("_slices")), F.lit(0))
    own = near.select("user", "vec", part.alias("_slice"), F.struct("item", dot(F.col("vec"), F.col("_i")).alias("score"), "sets").alias("_own")) \
        .groupBy("user", "_slice").agg(F.first("vec").alias("vec"), F.collect_list("_own").alias("_own"))
    rows = cut(own.select("user", "vec", F.xxhash64("user", "_slice").alias("row"), F.col("_own.item").alias("items"),
                          F.col("_own.score").alias("scores"), F.col("_own.sets").alias("sets")))
    met = cut(_all_scored(rows, item_vecs, n, n_sets, block))
    number = rows.groupBy("user").agg(*[F.sum(F.size(F.filter("sets", lambda b: _in_set(b, k)))).alias(f"p_{k}") for k in range(n_sets)])  # noqa: B023
    return met, met.groupBy("user").agg(*[F.sum(F.col("wins")[k]).alias(f"wins_{k}") for k in range(n_sets)]).join(number, "user")


def _in_set(sets: Column, k: int) -> Column:
    return sets.bitwiseAND(F.lit(1 << k)) != 0


def _sets_of(*sets: DataFrame) -> DataFrame:
    """(user, item, sets): distinct pairs, bit k being set for those of the k-th frame."""
    parts = [df.select(F.col("user").cast("bigint"), F.col("item").cast("bigint"), F.lit(1 << k).alias("sets")) for k, df in enumerate(sets)]
    return reduce(DataFrame.unionByName, parts).groupBy("user", "item").agg(F.bit_or("sets").alias("sets"))


def _auc_of(wins: Column, p: Column, asked: Column, n_items: int) -> Column:
    """AUC of a user by twice the items below the ``p`` true ones that have a score; the other of those ``asked`` for count as draws.

    The wins among a user's own positives add up to p(p-1)/2.
    """
    n = F.lit(n_items) - p
    auc = F.when(n > 0, (wins / 2 - p * (p - 1) / 2) / (p * n)).otherwise(0.5)
    return (F.coalesce(auc * p, F.lit(0.0)) + 0.5 * (asked - F.coalesce(p, F.lit(0)))) / asked


def auc_all_items(positives: DataFrame, user_vecs: DataFrame, item_vecs: DataFrame, block: int | None = None) -> DataFrame:
    """(user, auc, unscored): AUC per user of positive (user, item) pairs against all other items with a vector.

    A positive whose user or item has no vector is unscored and counts as a draw, 0.5; no user is lost.
    """
    pairs = _sets_of(positives)
    _, per_user = _surveyed(pairs, user_vecs, item_vecs, 0, 1, block)
    asked = pairs.groupBy("user").agg(F.count("*").alias("_all")).join(per_user, "user", "left")
    unscored = F.col("_all") - F.coalesce("p_0", F.lit(0))
    return asked.select("user", _auc_of(F.col("wins_0"), F.col("p_0"), F.col("_all"), item_vecs.count()).alias("auc"), unscored.alias("unscored"))


def overlap_pct(recs: DataFrame, known: DataFrame) -> DataFrame:
    """Share of each user's known items found among the recommended ones, in percent; users need both."""
    known = known.select("user", "item").distinct()
    hits = recs.select("user", "item").distinct().join(known, ["user", "item"]).groupBy("user").agg(F.count("*").alias("hits"))
    sizes = rel.semi(known, recs.select("user"), "user").groupBy("user").agg(F.count("*").alias("n_known"))
    return sizes.join(hits, "user", "left").select(
        "user", "n_known", (F.coalesce("hits", F.lit(0)) * 100 / F.col("n_known")).alias("pct"))


def overlap_mean(recs: DataFrame, known: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Mean of ``overlap_pct`` over the chosen users, all of them by default."""
    rows = overlap_pct(recs, known)
    rows = rows if users is None else rel.semi(rows, users, "user")
    return rows.agg(F.avg("pct").alias("mean_pct"), F.count("*").alias("n_users"))


# -- ranking metrics --------------------------------------------------------------------------------------------------

def _hits_at_k(scores: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per user with truth: number of true items and how many are among the first ``k``."""
    ranked = top_per_group(scores.select("user", "item", "score"), ["user"], [F.desc("score"), F.col("item")], k)
    hits = rel.semi(ranked, truth, ["user", "item"]).groupBy("user").agg(F.count("*").alias("hits"))
    sizes = truth.select("user", "item").distinct().groupBy("user").agg(F.count("*").alias("n_true"))
    return sizes.join(hits, "user", "left").fillna({"hits": 0})


def precision_at_k(scores: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean over users with truth of (true items in the first k) / k."""
    return _hits_at_k(scores, truth, k).agg(F.avg(F.col("hits") / k).alias("precision"))


def recall_at_k(scores: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean over users with truth of (true items in the first k) / (true items)."""
    return _hits_at_k(scores, truth, k).agg(F.avg(F.col("hits") / F.col("n_true")).alias("recall"))


def auc_per_user(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Chance per user that a true item outscores another one, ties counting half; 0.5 without other items.

    Rows shrink to one per (user, score); a user with many scores is spread by the running total.
    """
    flagged = scores.select("user", "item", "score").join(
        truth.select("user", "item").distinct().withColumn("_pos", F.lit(1)), ["user", "item"], "left")
    levels = flagged.groupBy("user", "score").agg(
        F.count("_pos").alias("pos"), (F.count("*") - F.count("_pos")).alias("neg"))
    ranked = running_total(levels, ["user"], ["score"], "neg", "cum")
    wins = F.sum(F.col("pos") * (F.col("cum") - F.col("neg") / 2))
    totals = ranked.groupBy("user").agg(wins.alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).where("p > 0")
    return totals.select("user", F.when(F.col("n") > 0, F.col("wins") / (F.col("p") * F.col("n"))).otherwise(0.5).alias("auc"))


def _shares(hits: DataFrame, truth: DataFrame, name: str, k_precision: int, k_recall: int) -> Column:
    """Mean precision and recall over the users with truth, as one scalar; ``hits`` holds each user's hits of the set ``name``."""
    sizes = truth.select("user", "item").distinct().groupBy("user").agg(F.count("*").alias("n_true"))
    share = lambda c, of: F.avg(F.coalesce(F.col(f"{c}_{name}"), F.lit(0)) / of)
    both = sizes.join(hits, "user", "left").agg(
        share("first_p", F.lit(k_precision)).alias("precision"), share("first_r", F.col("n_true")).alias("recall"))
    return both.select(F.struct("precision", "recall")).scalar()


def _hits(scores: DataFrame, names: Sequence[str], k_precision: int, k_recall: int) -> DataFrame:
    """Per user the hits among the first items for each set of ``names``, whose true rows are marked in the column of that name."""
    w = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    ranked = scores.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(k_precision, k_recall))
    return ranked.groupBy("user").agg(*[F.count_if(F.col(name).isNotNull() & (F.col("_rn") <= k)).alias(f"{c}_{name}")
                                        for name in names for c, k in (("first_p", k_precision), ("first_r", k_recall))])


def _marked(scores: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """Scores with a column for each set that is 1 in its rows."""
    for name, truth in sets.items():
        scores = scores.join(truth.select("user", "item").distinct().withColumn(name, F.lit(1)), ["user", "item"], "left")
    return scores


def evaluate(scores: DataFrame, train: DataFrame, test: DataFrame, k_precision: int = 12, k_recall: int = 10,
             mask_train: bool = False) -> DataFrame:
    """One row per set (train, test) with precision, recall and AUC; known items stay in unless masked.

    The sets are marked in the scores, which are then ranked once for both and go through one running total.
    """
    sets = {"train": train, "test": test}
    marked = cut(_marked(scores.select("user", "item", "score"), sets))
    counted = {"train": F.lit(True), "test": F.col("train").isNull() if mask_train else F.lit(True)}
    hits = {name: cut(_hits(marked.where(counted[name]), names, k_precision, k_recall))
            for name, names in ({"train": ["train"], "test": ["test"]} if mask_train else {"train": [*sets]}).items()}
    levels = marked.groupBy("user", "score").agg(
        *[F.count_if(counted[s] & F.col(s).isNotNull()).alias(f"pos_{s}") for s in sets],
        *[F.count_if(counted[s] & F.col(s).isNull()).alias(f"neg_{s}") for s in sets])
    ranked = running_total(levels, ["user"], ["score"], [f"neg_{s}" for s in sets], [f"cum_{s}" for s in sets])
    col = lambda c, s: F.col(f"{c}_{s}")
    totals = ranked.groupBy("user").agg(*[e for s in sets for e in (
        F.sum(col("pos", s) * (col("cum", s) - col("neg", s) / 2)).alias(f"wins_{s}"), F.sum(f"pos_{s}").alias(f"p_{s}"), F.sum(f"neg_{s}").alias(f"n_{s}"))])
    each = {s: F.when(col("n", s) > 0, col("wins", s) / (col("p", s) * col("n", s))).otherwise(0.5) for s in sets}
    aucs = cut(totals.agg(*[F.avg(F.when(col("p", s) > 0, each[s])).alias(s) for s in sets]))
    rows = []
    for name, truth in sets.items():
        shares = _shares(hits.get(name, hits["train"]), truth, name, k_precision, k_recall)
        rows.append(aucs.select(F.lit(name).alias("set"), shares["precision"].alias("precision"), shares["recall"].alias("recall"), F.col(name).alias("auc")))
    return rows[0].unionByName(rows[1])


def evaluate_model(user_vecs: DataFrame, item_vecs: DataFrame, train: DataFrame, test: DataFrame, k_precision: int = 12, k_recall: int = 10) -> DataFrame:
    """One row per set (train, test) with precision, recall, AUC and the number of users of a factor model.

    Every user meets every item once: the same products give the best items and the places of the true ones of both sets.
    """
    sets = {"train": 0, "test": 1}
    with shuffles_go(user_vecs.sparkSession):
        user_vecs, item_vecs = cut(user_vecs), cut(item_vecs)
        pairs = _sets_of(train, test)
        sizes = cut(pairs.groupBy("user").agg(*[F.count_if(_in_set(F.col("sets"), k)).alias(f"n_{k}") for k in sets.values()]))
        met, per_user = _surveyed(pairs, user_vecs, item_vecs, max(k_precision, k_recall), len(sets), None)
        # the rows of a user with very many true items all find the same best ones, each marks its own
        found = _rows_of(met, "items", "scores", "sets").toDF("user", "item", "score", "sets").repartition("user")
        found = found.groupBy("user", "item").agg(F.max("score").alias("score"), F.bit_or("sets").alias("sets"))
        hits = _hits(found.withColumns({s: F.when(_in_set(F.col("sets"), k), 1) for s, k in sets.items()}), [*sets], k_precision, k_recall)
        each = sizes.join(per_user, "user", "left").join(hits, "user", "left")
        n_items, figures = item_vecs.count(), []
        for name, k in sets.items():
            true, hit = F.col(f"n_{k}"), lambda c: F.coalesce(F.col(f"{c}_{name}"), F.lit(0))  # noqa: B023
            of = {"precision": hit("first_p") / k_precision, "recall": hit("first_r") / true, "auc": _auc_of(F.col(f"wins_{k}"), F.nullif(f"p_{k}", F.lit(0)), true, n_items)}
            figures += [F.avg(F.when(true > 0, c)).alias(f"{m}_{name}") for m, c in of.items()] + [F.count_if(true > 0).alias(f"n_users_{name}")]
        one = cut(each.agg(*figures))
    rows = [one.select(F.lit(name).alias("set"), *[F.col(f"{c}_{name}").alias(c) for c in ("precision", "recall", "auc", "n_users")]) for name in sets]
    return rows[0].unionByName(rows[1])


def factor_vectors(model, user: str = "user", item: str = "item") -> tuple[DataFrame, DataFrame]:
    """(user, vec) and (item, vec) of a fitted model."""
    pick = lambda df, name: df.select(F.col("id").cast("bigint").alias(name), F.col("features").alias("vec"))
    return pick(model.userFactors, user), pick(model.itemFactors, item)


def _metrics(users: DataFrame, items: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    rows = cut(evaluate_model(users, items, train, test))
    sweep(train.sparkSession)
    return rows


def fit_settings(inter: DataFrame, settings: Sequence[dict]) -> Iterator[tuple[int, tuple[DataFrame, DataFrame]]]:
    """The place of each setting with (user, vec) and (item, vec): those that name a loss are fitted together by ``fit_rankings``, any other by ``fit_implicit``.

    One model of the latter exists at a time, so that what it left on disk may go.
    """
    ranking = [k for k, setting in enumerate(settings) if "loss" in setting]
    for k, setting in enumerate(settings):
        if k not in ranking:
            yield k, factor_vectors(fit_implicit(inter, **setting))
    if ranking:
        yield from zip(ranking, fit_rankings(inter, [Setting(**settings[k]) for k in ranking]), strict=True)


def factor_grid(inter: DataFrame, train: DataFrame, test: DataFrame, settings: Sequence[dict]) -> DataFrame:
    """One row per setting of ``fit_settings`` and set with the metrics of the fitted model, numbered by ``pos``.

    ``inter`` are the training rows (user_idx, item_idx, n); ``train`` and ``test`` are (user, item) pairs.
    """
    rows = {pos: _metrics(*vecs, train, test) for pos, vecs in fit_settings(inter, settings)}
    out = None
    for pos, setting in enumerate(settings):
        one = rows[pos].select(F.lit(pos).alias("pos"), *[F.lit(v).alias(k) for k, v in setting.items()], *rows[pos].columns)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def best_setting(grid: DataFrame, metric: str = "auc") -> DataFrame:
    """The test row of the best setting, the first on ties."""
    return grid.where("set = 'test'").orderBy(F.desc(metric), "pos").limit(1)
