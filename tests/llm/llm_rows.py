"""Rows of documents that the tests of this folder share."""

import random

import pytest

DOCS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size int, score double, n_tokens string, "
                          "key string, anchor string, position string, row string, node string, taken string, held_out string")


@pytest.fixture(scope="module")
def corpus():
    """Rows of documents: copies, near copies, shared passages, NULLs, empty and long texts, repeated rows."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "tu", "re", "sö", "na"]) for _ in range(rnd.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(120)]
    texts = [" ".join(word() for _ in range(rnd.randint(5, 120))) for _ in range(40)]
    texts += [texts[0]] * 4 + [texts[1].upper(), f"{texts[2]} {passage} {texts[3]}", f"{texts[4]} {passage}", f"{passage} {texts[5]} {passage}"]
    for k in range(30):  # near copies of one text, each with its own few changes
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [None, "", " \t\n ", "a", "A b", "a b c", "ab" * 400, "x " * 500, "Ünï 12,3 'tis\n\nit's  ok !", " ".join(word() for _ in range(9000))]
    rows = [(i, t, "xx", [None, "s1", "s2", "s0"][min(3, i % 7)], len(t or ""), 1, 2.0, *["c"] * 8) for i, t in enumerate(texts)]
    rows.append(rows[3])
    rows += [(None, texts[6], None, None, None, None, None, *[None] * 8), (None, None, None, "s1", None, None, None, *[None] * 8)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
