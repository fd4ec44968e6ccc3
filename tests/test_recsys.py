import random
from datetime import date
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from dataweft.operators import recsys


def scores(spark):
    return spark.createDataFrame([(1, i, s) for i, s in ((1, .9), (2, .8), (3, .7), (4, .6))]
                                 + [(2, i, s) for i, s in ((1, .5), (2, .5), (3, .4))] + [(3, 1, .3)], "user int, item int, score double")


def test_ranking_metrics_by_hand(spark):
    s = scores(spark)
    truth = spark.createDataFrame([(1, 1), (1, 3), (2, 2)], "user int, item int")
    assert np.isclose(recsys.precision_at_k(s, truth, 2).first()[0], (0.5 + 0.5) / 2)
    assert np.isclose(recsys.recall_at_k(s, truth, 2).first()[0], (0.5 + 1.0) / 2)
    assert rows(recsys.auc_per_user(s, truth)) == [(1, 0.75), (2, 0.75)]
    recs = s.where("item <= 2")
    assert rows(recsys.overlap_pct(recs, truth)) == [(1, 2, 50.0), (2, 1, 100.0)]
    table = recsys.evaluate(s, truth, spark.createDataFrame([(1, 2)], "user int, item int"), 2, 2)
    assert rows(table, "set", "auc") == [("test", 2 / 3), ("train", 0.75)]
    masked = recsys.evaluate(s, truth, spark.createDataFrame([(1, 2)], "user int, item int"), 2, 2, mask_train=True)
    assert rows(masked, "set", "auc") == [("test", 1.0), ("train", 0.75)]


def test_auc_without_other_items(spark):
    truth = spark.createDataFrame([(3, 1)], "user int, item int")
    assert rows(recsys.auc_per_user(scores(spark), truth)) == [(3, 0.5)]


def test_splits_are_disjoint_complete_and_stable(spark):
    df = spark.range(5000).select((F.col("id") % 50).alias("u"), F.col("id").alias("i"))
    train, test = recsys.random_split(df, 0.2, ["u", "i"], 3)
    a, b = set(rows(train)), set(rows(test))
    assert not a & b and len(a | b) == 5000 and abs(len(b) - 1000) < 120
    assert b == set(rows(recsys.random_split(df.repartition(3), 0.2, ["u", "i"], 3)[1]))


def test_leave_one_out(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 9)], "u int, i int")
    train, test = recsys.leave_one_out(df, "u", "i")
    a, b = rows(train), rows(test)
    assert len(a) == 2 and len(b) == 2 and sorted(a + b) == rows(df) and (2, 9) in b


@pytest.mark.parametrize("block", [3, 1000])
def test_recommend_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    u, v = rng.integers(-3, 4, (7, 4)).astype(float), rng.integers(-3, 4, (20, 4)).astype(float)  # many ties
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "user bigint, vec array<double>")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item bigint, vec array<double>")
    s = u @ v.T
    best = {(i, j) for i in range(7) for j in sorted(range(20), key=lambda j: (-s[i, j], j))[:5]}
    assert set(rows(recsys.recommend(users, items, 5, block=block), "user", "item")) == best
    known = [(i, j) for i in range(7) for j in range(i)]
    k = spark.createDataFrame(known, "user bigint, item bigint")
    best = {(i, j) for i in range(7) for j in sorted((j for j in range(20) if (i, j) not in known), key=lambda j: (-s[i, j], j))[:5]}
    assert set(rows(recsys.recommend(users, items, 5, known=k, block=block), "user", "item")) == best


@pytest.mark.parametrize("block", [3, 1000])
def test_auc_over_all_items_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    u, v = rng.integers(-2, 3, (5, 3)).astype(float), rng.integers(-2, 3, (15, 3)).astype(float)
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "user bigint, vec array<double>")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item bigint, vec array<double>")
    pos = [(i, j) for i in range(5) for j in range(0, 15, i + 2)]
    s, want = u @ v.T, {}
    for i in range(5):
        p = [j for a, j in pos if a == i]
        wins = [float(s[i, a] > s[i, b]) + 0.5 * (s[i, a] == s[i, b]) for a in p for b in range(15) if b not in p]
        want[i] = np.mean(wins)
    auc = recsys.auc_all_items(spark.createDataFrame(pos, "user bigint, item bigint"), users, items, block)
    got = dict(rows(auc, "user", "auc"))
    assert got.keys() == want.keys() and all(np.isclose(got[i], want[i]) for i in want)
    cold = spark.createDataFrame([*pos, (0, 99), (7, 1)], "user bigint, item bigint")  # an item and a user without vector
    rows_ = {r.user: r for r in recsys.auc_all_items(cold, users, items, block).collect()}
    n = sum(a == 0 for a, _ in pos)
    assert rows_.keys() == {*want, 7} and rows_[7].auc == 0.5 and rows_[7].unscored == 1
    assert rows_[0].unscored == 1 and np.isclose(rows_[0].auc, (n * want[0] + 0.5) / (n + 1))


def test_recommend_moves_each_row_once_per_block(spark):
    users = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "user bigint, vec array<double>")
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "item bigint, vec array<double>")
    a, b = recsys._cells(users, "user", items, "item", 10)
    assert a.count() == 40 * 3 and b.count() == 30 * 4


def test_model_evaluation_and_grid(spark):
    users = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "user bigint, vec array<double>")
    items = spark.createDataFrame([(i, [float(i % 2 == 0) * (10 - i), float(i % 2) * (10 - i)]) for i in range(10)], "item bigint, vec array<double>")
    train = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "user bigint, item bigint")
    test = spark.createDataFrame([(0, 4), (1, 0)], "user bigint, item bigint")
    got = {r.set: r for r in recsys.evaluate_model(users, items, train, test, 2, 3).collect()}
    assert got["train"].precision == (2 / 2 + 1 / 2) / 2 and got["train"].recall == 1.0 and got["train"].auc == 1.0
    assert got["test"].recall == 0.5 and np.isclose(got["test"].auc, (7 / 9 + 2 / 9) / 2) and got["test"].n_users == 2
    inter = spark.createDataFrame([(u, i, 1) for u in range(6) for i in range(8) if (u + i) % 2], "user_idx int, item_idx int, n int")
    pairs = inter.selectExpr("CAST(user_idx AS BIGINT) AS user", "CAST(item_idx AS BIGINT) AS item")
    grid = recsys.factor_grid(inter, pairs, pairs, [{"rank": 2, "iters": 3}, {"rank": 4, "iters": 3}])
    assert rows(grid, "pos", "rank", "set") == [(0, 2, "test"), (0, 2, "train"), (1, 4, "test"), (1, 4, "train")]
    assert recsys.best_setting(grid).first().auc == max(r.auc for r in grid.collect())


def test_overlap_mean(spark):
    recs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "user bigint, item bigint")
    known = spark.createDataFrame([(1, 1), (1, 9), (2, 5), (3, 1)], "user bigint, item bigint")
    assert recsys.overlap_mean(recs, known).first().mean_pct == 25.0
    assert recsys.overlap_mean(recs, known, recs.where("user = 1").select("user")).first().mean_pct == 50.0


def tx(spark):
    data = [(date(2020, 1, 1), "u1", "a", "1.10"), (date(2020, 1, 1), "u1", "b", "2.20"), (date(2020, 1, 5), "u1", "a", "1.10"),
            (date(2020, 2, 1), "u2", "b", "5.00")]
    return spark.createDataFrame([(d, u, a, Decimal(p)) for d, u, a, p in data], "t_dat date, customer_id string, article_id string, price decimal(12,2)")


def test_customer_features(spark):
    people = spark.createDataFrame([("u1",), ("u2",), ("cold",)], "customer_id string")
    got = {r.customer_id: r for r in recsys.customer_features(tx(spark), people).collect()}
    assert got["cold"].ct_carts == 0 and got["cold"].price_min is None
    r = got["u1"]
    assert (r.ct_carts, r.price_min, r.price_max, r.cart_value_min, r.cart_value_max) == (2, 1.1, 2.2, 1.1, 3.3)
    assert np.isclose(r.price_mean, 4.4 / 3) and np.isclose(r.cart_value_mean, 2.2)
    apart = recsys.customer_recency(tx(spark)).join(recsys.price_stats(tx(spark)), "customer_id").join(recsys.basket_stats(tx(spark)), "customer_id")
    assert rows(apart) == rows(recsys.customer_features(tx(spark), people.limit(2)).select(*apart.columns))


def test_recent_items_and_best_sellers(spark):
    assert rows(recsys.recent_items(tx(spark), date(2021, 1, 10))) == [("b",)]
    goods = spark.createDataFrame([("a", *"pqrst"), ("b", *"pqrst"), ("c", None, *"qrst")], "article_id string, " + ", ".join(f"{c} string" for c in recsys.ARTICLE_GROUP))
    best = recsys.best_sellers(tx(spark), goods)
    assert rows(best, "article_id", "transaction_count") == [("a", 2)]  # ties go to the smaller id


def test_interactions(spark):
    assert rows(recsys.interactions(tx(spark)), "customer_id", "article_id", "n", "user_idx", "item_idx") == [
        ("u1", "a", 2, 0, 0), ("u1", "b", 1, 0, 1), ("u2", "b", 1, 1, 1)]
    assert rows(recsys.interaction_shape(tx(spark))) == [(2, 2, 3, 0.75)]


def test_factor_model_beats_popularity(spark):
    """Two tastes: users buy within their own half of the items; popularity cannot tell the halves apart."""
    rng = random.Random(3)
    data = {(u, 2 * rng.randrange(20) + u % 2) for u in range(60) for _ in range(12)}
    inter = spark.createDataFrame([(u, i, 1) for u, i in data], "user_idx int, item_idx int, n int")
    train, test = recsys.leave_one_out(inter, "user_idx", "item_idx", seed=1)
    model = recsys.fit_implicit(train.withColumn("n", F.lit(1)), rank=4, iters=5)
    users = model.userFactors.select(F.col("id").cast("bigint").alias("user"), F.col("features").alias("vec"))
    items = model.itemFactors.select(F.col("id").cast("bigint").alias("item"), F.col("features").alias("vec"))
    pos = test.select(F.col("user_idx").cast("bigint").alias("user"), F.col("item_idx").cast("bigint").alias("item"))
    auc = recsys.auc_all_items(pos, users, items).agg(F.avg("auc")).first()[0]
    counts = train.groupBy(F.col("item_idx").cast("bigint").alias("item")).agg(F.array(F.count("*").cast("double")).alias("vec"))
    flat = users.select("user", F.array(F.lit(1.0)).alias("vec"))
    popular = recsys.auc_all_items(pos, flat, counts).agg(F.avg("auc")).first()[0]
    assert auc > 0.55 and auc > popular


def test_copies_of_rows_do_not_grow_with_the_tables(spark, monkeypatch):
    """Without a block size a user travels at most once for each of a fixed number of blocks of items, an item for one of users."""
    monkeypatch.setattr(recsys, "LEAST_ROWS", 2)
    users = spark.createDataFrame([(i, [1.0]) for i in range(200)], "user bigint, vec array<double>")
    items = spark.createDataFrame([(i, [1.0]) for i in range(90)], "item bigint, vec array<double>")
    a, b = recsys._cells(users, "user", items, "item", None)
    assert a.count() <= 200 * recsys.ITEM_BLOCKS and b.count() <= 90 * recsys.USER_BLOCKS


@pytest.mark.parametrize("few", [0, 8])
def test_tiles_of_a_block(monkeypatch, few):
    """Best items and wins of a block that is larger than a tile, ties and known items included, as by hand."""
    for name, value in (("TILE_USERS", 4), ("TILE_ITEMS", 7), ("FEW", few)):
        monkeypatch.setattr(recsys, name, value)
    rng = np.random.default_rng(5)
    u, v, ids = rng.integers(-2, 3, (11, 3)).astype(float), rng.integers(-2, 3, (60, 3)).astype(float), rng.permutation(200)[:60]
    items, s = pd.DataFrame({"item": ids, "vec": list(v)}), u @ v.T
    known = [ids[rng.permutation(60)[:k]].tolist() + [999] if k else None for k in range(11)]
    got = recsys.best_items(5)(pd.DataFrame({"user": range(11), "vec": list(u), "_known": known}), items)
    want = {(i, ids[j]) for i in range(11) for j in sorted((j for j in range(60) if ids[j] not in (known[i] or [])), key=lambda j: (-s[i, j], ids[j]))[:5]}
    assert set(zip(got["user"], got["item"], strict=True)) == want
    own = [sorted(rng.permutation(60)[:k + 1]) for k in range(8)]
    left = pd.DataFrame({"user": range(8), "vec": list(u[:8]), "items": [ids[o] for o in own], "scores": [s[i, o] for i, o in enumerate(own)]})
    left.loc[0, "items"][0] = 998  # an item of another block
    wins = [sum(2 * (s[i, a] > s[i, b]) + (s[i, a] == s[i, b]) for a in o for b in range(60) if b != a or i == 0) for i, o in enumerate(own)]
    for key, n in ((0, [len(o) for o in own]), (1, [0] * 8)):
        out = recsys._wins((3, key), left, items)
        assert out["wins"].tolist() == wins and out["p"].tolist() == n


def test_both_sets_are_ranked_once(spark, monkeypatch):
    """The scores of both sets go through one numbering of ranges, masked or not, with the figures of each set alone."""
    rng = random.Random(2)
    s = spark.createDataFrame([(u, i, float(rng.randrange(6))) for u in range(9) for i in range(20)], "user int, item int, score double")
    train, test = (spark.createDataFrame([(u, rng.randrange(25)) for u in range(k, 10) for _ in range(4)], "user int, item int") for k in (0, 2))
    totals, real = [], recsys.running_total
    monkeypatch.setattr(recsys, "running_total", lambda *a: (totals.append(a), real(*a))[1])
    got = {r.set: r for r in recsys.evaluate(s, train, test, 3, 5).collect()}
    assert len(totals) == 1
    masked = recsys.evaluate(s, train, test, 3, 5, mask_train=True).where("set = 'test'").first()
    for row, used, truth in ((got["train"], s, train), (got["test"], s, test), (masked, s.join(train, ["user", "item"], "left_anti"), test)):
        assert np.isclose(row.precision, recsys.precision_at_k(used, truth, 3).first()[0])
        assert np.isclose(row.recall, recsys.recall_at_k(used, truth, 5).first()[0])
        assert np.isclose(row.auc, recsys.auc_per_user(used, truth).agg(F.avg("auc")).first()[0])


def test_a_model_is_evaluated_in_one_pass(spark, monkeypatch):
    """Both sets and the best items come from one product of all with all, as by hand; users with many true items have several rows."""
    passes, real = [], recsys._all_scored
    monkeypatch.setattr(recsys, "_all_scored", lambda *a, **k: (passes.append(a), real(*a, **k))[1])
    monkeypatch.setattr(recsys, "OWN_SLICE", 4)
    monkeypatch.setattr(recsys, "LEAST_ROWS", 5)
    rng = np.random.default_rng(4)
    u, v = rng.integers(-2, 3, (12, 3)).astype(float), rng.integers(-2, 3, (25, 3)).astype(float)
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "user bigint, vec array<float>")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item bigint, vec array<float>")
    truth = {"train": [(i, int(j)) for i in range(12) for j in rng.permutation(25)[:1 + i]], "test": [(i, int(j)) for i in range(3, 14) for j in rng.permutation(27)[:2]]}
    got = {r.set: r for r in recsys.evaluate_model(users, items, *[spark.createDataFrame(t, "user bigint, item bigint") for t in truth.values()], 3, 5).collect()}
    assert len(passes) == 1
    s = u @ v.T
    for name, pairs in truth.items():
        own = {i: [j for a, j in pairs if a == i] for i in {a for a, _ in pairs}}
        top = {i: sorted(range(25), key=lambda j: (-s[i, j], j)) if i < 12 else [] for i in own}
        want = [[], [], []]
        for i, p in own.items():
            scored = [j for j in p if i < 12 and j < 25]
            wins = [(s[i, a] > s[i, b]) + 0.5 * (s[i, a] == s[i, b]) for a in scored for b in range(25) if b not in p]
            auc = np.mean(wins) if wins else 0.5
            for x, y in zip(want, (len(set(top[i][:3]) & set(p)) / 3, len(set(top[i][:5]) & set(p)) / len(p), (auc * len(scored) + 0.5 * (len(p) - len(scored))) / len(p)), strict=True):
                x.append(y)
        assert got[name].n_users == len(own) and np.allclose([got[name].precision, got[name].recall, got[name].auc], [np.mean(x) for x in want])


def test_near_scores_are_told_apart():
    """Scores that are equal in single precision are compared in double; zeros, ties and huge products too."""
    rng = np.random.default_rng(6)
    for scale in (1.0, 1e-30, 1e25):
        v = np.concatenate([rng.normal(0, 1, (40, 2)), [[1, 0]] * 5, [[1 + k * 1e-8, 0] for k in range(1, 6)], [[0, 0]]]) * scale
        x = np.array([[1.0, 0.0], [0.0, 0.0], [-1.0, 0.5], [1.0, -1.0]]) * scale
        ids, s = rng.permutation(100)[:len(v)], x @ v.T
        own = [list(range(38, 51)), [0, 3, 50], [41, 46, 47], list(range(0, 50, 7))]
        given = recsys.Own(np.array([len(o) for o in own]), np.concatenate([s[i, o] for i, o in enumerate(own)]), ids[np.concatenate(own)])
        (row, col, _), wins = recsys._survey(recsys.Goods(ids, v), x, 4, None, given)
        near = lambda a, b: abs(a - b) <= 1e-12 + 1e-9 * abs(a)
        want = [sum(1 if near(s[i, a], s[i, b]) else 2 * (s[i, a] > s[i, b]) for b in range(len(v)) if b != a) for i, o in enumerate(own) for a in o]
        assert wins.tolist() == want
        assert [(i, c) for i, c in zip(row, col, strict=True)] == [(i, j) for i in range(4) for j in sorted(range(len(v)), key=lambda j: (-s[i, j], ids[j]))[:4]]


def test_fits_leave_nothing_on_disk(spark, monkeypatch):
    """Every round of a fit is a checkpoint, and after each model of a grid the driver collects its garbage, so that no shuffle files stay."""
    seen, swept, fit, sweep = [], [], ALS.fit, recsys.sweep
    monkeypatch.setattr(ALS, "fit", lambda als, df: (seen.append(als.getCheckpointInterval()), fit(als, df))[1])
    monkeypatch.setattr(recsys, "sweep", lambda s: (swept.append(s), sweep(s))[1])
    inter = spark.createDataFrame([(u, i, 1) for u in range(6) for i in range(8) if (u + i) % 2], "user_idx int, item_idx int, n int")
    pairs = inter.selectExpr("CAST(user_idx AS BIGINT) AS user", "CAST(item_idx AS BIGINT) AS item")
    grid = recsys.factor_grid(inter, pairs, pairs, [{"rank": 2, "iters": 2}, {"rank": 3, "iters": 2}])
    assert grid.count() == 4 and seen == [1, 1] and len(swept) == 2
    assert spark.sparkContext.getCheckpointDir() is not None


def test_blocks_of_a_fit_stay_small(spark, monkeypatch):
    """A fit has the more blocks the more pairs there are, so that a task's pairs and the vectors that they name keep their size."""
    for n, users, items, rank in ((1000, 50, 60, 16), (36_000_000, 900_000, 1_200_000, 44), (216_000_000, 5_400_000, 7_200_000, 16), (216_000_000, 5_400_000, 7_200_000, 44)):
        b = recsys._fit_blocks(n, users, items, rank)
        assert b >= recsys.FIT_BLOCKS and 60 * n / b + (4 * rank + 24) * min(n / b, items) <= recsys.FIT_BYTES
    assert recsys._fit_blocks(1000, 50, 60, 16) == recsys.FIT_BLOCKS
    monkeypatch.setattr(recsys, "FIT_BYTES", 200)
    seen, fit = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda als, df: (seen.append((als.getNumUserBlocks(), als.getNumItemBlocks())), fit(als, df))[1])
    inter = spark.createDataFrame([(u, i, 1) for u in range(6) for i in range(8) if (u + i) % 2], "user_idx int, item_idx int, n int")
    assert recsys.fit_implicit(inter, rank=2, iters=2).userFactors.count() == 6
    assert seen[0][0] == seen[0][1] > recsys.FIT_BLOCKS


def test_a_cell_reads_its_users_in_batches():
    """A task holds its items; users leave in the rows that they came in, in tiles."""
    from itertools import count

    import pyarrow as pa
    lists = lambda x, kind: pa.array(x, pa.list_(kind))
    batch = lambda kind, ids, vecs: pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(ids), pa.int32()), pa.array(ids if kind else [None] * len(ids), pa.int64()), pa.array([None] * len(ids) if kind else ids, pa.int64()),
         lists(vecs, pa.float32()), lists([[]] * len(ids), pa.int64()), lists([[]] * len(ids), pa.float64()), lists([[]] * len(ids), pa.int32())],
        names=["kind", "user", "item", "vec", "items", "scores", "sets"])
    read = count()
    users = (batch(1, [10 * k, 10 * k + 1], [[1.0, 0.0], [0.0, 1.0]]) for k in range(50) if next(read) >= 0)
    out = recsys._meet(1, 0)(x for part in ([batch(0, [1, 2], [[1, 0], [0, 1]]), batch(0, [3], [[2, 0]])], users) for x in part)
    first = next(out)
    assert first.column("user").to_pylist() == [0, 1] and first.column("items").to_pylist() == [[3], [2]] and next(read) == 1
    assert sum(b.num_rows for b in out) == 98
