"""Ranked search against brute force; bounds of lists and blocks."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from llm_rows import corpus, docs, no_docs  # noqa: F401

from dataweft.llm import maxscore

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id bigint, text string, doc_id string, score int, rank string, item string"


def words(text):
    return PATTERN.findall(text.translate(LOWER)) if text else []


def brute(docs, items, k=20):
    held = [(i, Counter(words(t)), len(words(t))) for i, t in docs if words(t)]
    n, total, df = len(held), sum(x for _, _, x in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in held:
            m = 75 + (25 * size * n) // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in Counter(words(text)).items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "shard", "items"), [(128, 1 << 15, 1024), (4, 8, 3)])
def test_ranks(spark, docs, corpus, monkeypatch, block, shard, items):  # noqa: F811
    monkeypatch.setattr(maxscore, "BLOCK", block)
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "ITEMS", items)
    texts = [corpus[0][1], corpus[1][1][:30] + " " + corpus[60][1], "x x A", corpus[44][1], "ÜNÏ ünï 12 nothing-there", "", None, "zzz"]
    asked = [(i, t) for i, t in enumerate(texts)] + [(1, texts[0]), (None, texts[2])]
    frame = spark.createDataFrame([(i, t, "c", 1, "r", "i") for i, t in asked], ITEMS)
    got = sorted((tuple(r) for r in maxscore.rank(docs, frame).collect()), key=str)
    want = brute([(r[0], r[1]) for r in corpus], asked)
    assert len(want) > 60 and got == want


def test_nothing(spark, docs, no_docs):  # noqa: F811
    frame = spark.createDataFrame([(1, "ka lo", "c", 1, "r", "i")], ITEMS)
    assert maxscore.rank(no_docs, frame).count() == 0
    assert maxscore.rank(docs, frame.limit(0)).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(maxscore, "PIECE", 7)
    text = ("Ab,c1 ßé-" * 50 + "longer" * 9).encode()
    assert [t.decode() for part in maxscore.terms(text) for t in part] == words(text.decode())


def test_blocks_are_skipped_and_large_numbers_stay_whole(monkeypatch):
    """Bounds hold, weak lists are decoded in part, and sizes whose product exceeds 64 bits are computed exactly."""
    monkeypatch.setattr(maxscore, "BLOCK", 8)
    rng, vocabulary = np.random.default_rng(0), maxscore.Vocabulary({b"rare": 0, b"often": 1})
    shard, texts = maxscore.Shard(), []
    for i in range(600):
        texts.append("often " * rng.integers(0, 3) + "rare " * (400 if i == 77 else 3 if i in (5, 6) else 0) + "other " * rng.integers(1, 60))
        shard.add(i, texts[-1].encode(), vocabulary)
    row = shard.row()
    total = row["n_terms"]
    row = {c: np.frombuffer(v, np.uint8) if c == "postings" else v if c == "n_docs" else np.array(v) for c, v in row.items()}
    weights = np.array([maxscore.weight(600, int(d)) for d in row["df"]])
    lists = maxscore.Lists(row, 600, total, weights)
    for k in range(2):
        d, s = lists.decode(k)
        assert (s <= lists.maxima(k)[d // 8]).all() and s.max() <= lists.most[k]
        assert [int(x) for x in lists.decode(k, np.arange(75) < 20)[0]] == [int(x) for x in d if x < 160]
    all_blocks, lists.decoded = lists.decoded, 0
    best = maxscore.Best(2)
    best.add(np.array([0, 1]), np.array([1, 1]) * int(lists.decode(0)[1].min()), list(range(600)))
    lists.decoded = 0
    maxscore.search_shard(lists, [(0, 1), (1, 1)], best, list(range(600)))
    assert lists.decoded < all_blocks / 4
    assert {d for d, _ in best.rows()} == {i for _, _, i, _ in brute(list(enumerate(texts)), [(0, "rare often")], 2)}
    huge = np.array([5, 10**8])
    assert maxscore.normalisers(huge, 10**11, 10**14).tolist() == [75 + (25 * int(x) * 10**11) // 10**14 for x in huge]
