"""Hard negatives against brute force; the scan's stopping rule."""

import numpy as np
import pytest

from dataweft.llm import threshold

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, rank int, part string, windows string, shard int"
MORE = ("c", 1, "x", "y", 2)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    labels = rng.choice(4, 330, p=[0.55, 0.25, 0.15, 0.05])
    x = rng.normal(0, 0.3, (330, 12)) + np.eye(12)[labels] + 0.4
    x[40:70] = x[9]  # one vector many times, under several labels
    x[71] = -x[9]
    out = [(i, v.tolist(), int(c), *MORE) for i, (v, c) in enumerate(zip(x, labels, strict=True))]
    out += [(400, None, 1, *MORE), (410, [], 1, *MORE), (420, [1.0, None], 1, *MORE), (430, [float("nan")] * 12, 1, *MORE), (440, [float("inf")] + [0.0] * 11, 1, *MORE),
            (450, [0.0] * 12, 1, *MORE), (460, [2.0, -1.0], 0, *MORE), (None, [1.0] * 12, 1, *MORE), (470, [1.0] * 12, None, *MORE), (480, [0.5] * 12, 9, *MORE), out[3], out[30]]
    return out


def brute(rows, every, k=5, n=3):
    use = {}
    for i, v, c, *_ in rows:
        if i is not None and c is not None and v and all(x is not None and np.isfinite(x) for x in v):
            use[i] = ((c + 1) % 10 if i % 7 == 0 else c, np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, 12 - len(v)))))
    out = []
    for a in (i for i in use if i % every == 0):
        scored = sorted((-int(use[a][1] @ v), i, c) for i, (c, v) in use.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == use[a][0]][:k]:
            fit = [(-t, j) for t, j, c in scored if c != use[a][0] and 50 * -s <= 100 * -t <= 95 * -s][:n]
            out += [(a, p, r, j, -s, t) for r, (t, j) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(2048, 256), (16, 4)])
def test_hard_negatives(spark, rows, monkeypatch, shard, block):
    monkeypatch.setattr(threshold, "SHARD", shard)
    monkeypatch.setattr(threshold, "BLOCK", block)
    got = sorted(tuple(r) for r in threshold.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), every=10).collect())
    want = brute(rows, 10)
    assert len(want) > 100 and got == want


def test_few_or_no_rows(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert threshold.hard_negatives(frame.limit(0)).count() == 0
    assert threshold.hard_negatives(frame.where("vec_id = 50")).count() == 0
    some = [r for r in rows if r[0] in (50, 51, 52, 100, 480)]
    got = threshold.hard_negatives(frame.where("vec_id in (50, 51, 52, 100, 480)")).collect()
    assert sorted(tuple(r) for r in got) == brute(some, 50)


def test_scan_is_exact_and_stops_early():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (600, 4)) * rng.lognormal(0, 1, 600)[:, None]
    x[100:120] = x[3]
    lists, looked = threshold.sorted_lists(x), 0
    for _ in range(60):
        q = rng.normal(0, 1, 4) * rng.integers(0, 2, 4)
        own = np.zeros(600, bool)
        own[rng.integers(600)] = True
        score = np.where(own, -np.inf, x @ q)
        high = float(np.sort(score)[-rng.integers(1, 80)])
        low = high - rng.random() * 3
        s = threshold.scan(q, x, lists, own, np.array([low]), np.array([high]), 3)
        at, found = s.found()
        assert np.array_equal(found, x[at] @ q)
        inside = np.flatnonzero((score >= low) & (score <= high))
        kth = np.sort(score[inside])[-3] if len(inside) >= 3 else low
        assert set(inside[score[inside] >= kth]) <= set(at)  # ties of the third too
        looked += len(at) * (q != 0).any() / 600
    assert looked < 30
