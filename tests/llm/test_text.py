"""Mixing, similarity join, substring deduplication, toxicity and page texts."""

import collections
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import plan
from llm_rows import corpus, docs, no_docs  # noqa: F401
from pyspark.sql import functions as F

from dataweft.llm import common, html_text, induced, mixing, parity_join, substrings, toxicity


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(full.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > cap * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full |= {s: cap * sizes[s] for s in over}


def test_mix_reaches_its_targets(spark, docs, no_docs, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_PREFIX", 0.2)  # several levels of prefixes
    sizes = Counter()
    for r in corpus:
        sizes[r[3]] += len((r[1] or "").encode().split())
    goal = brute_targets(sizes)
    got = mixing.mix(docs).collect()
    taken, last = Counter(), -1.0
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        assert r.taken == r.copies * r.size + r.last_words and len(r.positions) == r.copies + (r.last_words > 0)
        if r.position is not None:
            assert 0 <= r.position <= 1 and r.position >= last
            last = r.position
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal) and len(got) == len(corpus)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(no_docs).count() == 0


def test_training_order_holds_the_words_taken(spark, docs, corpus):
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken
    out = mixing.training_order(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len((r.text or "").encode().split())
    assert got == +want
    assert "ArrowEvalPython" not in plan(out) and "BatchEvalPython" not in plan(out) and "MapInArrow" not in plan(out)


def brute_components(corpus, words, percent):
    sets = []
    for r in corpus:
        w = (r[1] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    part = list(range(len(sets)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                part[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(sets)):
        if corpus[i][0] is not None:
            least[find(i)].append(corpus[i][0])
    return [(len(s), min(least[find(i)], default=None) if s else corpus[i][0]) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("words", "percent", "few", "block"), [(3, 90, 16, 1024), (5, 80, 16, 1024), (1, 60, 2, 4)])
def test_components_equal_brute_force(spark, docs, corpus, monkeypatch, words, percent, few, block):
    monkeypatch.setattr(parity_join, "FEW", few)
    monkeypatch.setattr(parity_join, "BLOCK", block)
    got = parity_join.components(docs, words, percent).collect()
    want = [(r[0], *x) for r, x in zip(corpus, brute_components(corpus, words, percent), strict=True)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_components_of_nothing(no_docs):
    assert parity_join.components(no_docs).count() == 0


def test_texts_of_one_template_hardly_meet(spark, monkeypatch):
    """Texts that share most words but differ by some of their own: crowded words, no links, under a tenth of all pairs in blocks.

    A pair that meets in several words counts once; the 60 linked texts meet each other.
    """
    rnd = random.Random(2)
    base, rows = [f"t{i}" for i in range(80)], []
    for k in range(600):
        w = list(base)
        for j, at in enumerate((rnd.randrange(5, 25), rnd.randrange(30, 50), rnd.randrange(55, 75))):
            w[at] = f"own{k}x{j}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join([*base[:79], f"last{k}"])) for k in range(60)]  # these are linked with each other
    met, made = set(), parity_join.block_pairs

    def spy(*args):
        out = made(*args).cache()
        for left, right in out.collect():
            met.update((min(x.node, y.node), max(x.node, y.node)) for x in left for y in right if x.part != y.part and x.most >= y.n and y.most >= x.n)
        return out

    monkeypatch.setattr(parity_join, "block_pairs", spy)
    got = parity_join.components(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80).collect()
    want = [(r[0], *x) for r, x in zip(rows, brute_components([(i, t) for i, t in rows], 5, 80), strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert 0 < len(met) < len(rows) ** 2 / 20


def test_near_copies_do_not_become_all_their_pairs(spark, monkeypatch):
    """500 texts of one template with twelve places of two choices: thousands of links, of which few times as many go out as there are texts."""
    rnd = random.Random(5)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for k in range(500):
        w = list(base)
        for at in range(5, 149, 12):
            w[at] += rnd.choice("xy")
        rows.append((k, " ".join(w)))
    out, made, verify = [], parity_join.block_links, parity_join.verified
    monkeypatch.setattr(parity_join, "block_links", lambda *args: (out.append((x := made(*args).cache()).count()), x)[1])
    monkeypatch.setattr(parity_join, "verified", lambda pairs, *args: (out.append((x := pairs.cache()).count()), verify(x, *args))[1])
    got = parity_join.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [(r[0], *x) for r, x in zip(rows, brute_components(rows, 3, 90), strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(out) < 4 * len(rows)


def test_sketches_bound_the_difference():
    rng, bands = np.random.default_rng(3), parity_join.Bands(80)
    for _ in range(200):
        n = int(rng.integers(10, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[int(rng.integers(0, 10)) :], rng.integers(0, 2**63, int(rng.integers(0, 10))).astype(np.uint64))))
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 80 * (len(a) + len(b) - shared):
            top = max(bands.of(len(a)), bands.of(len(b)))
            assert top in bands.places(len(a)) and top in bands.places(len(b))
            u, v = (np.frombuffer(bands.sketch(x, top), np.uint8) for x in (a, b))
            assert np.bitwise_count(u ^ v).sum() <= len(a) + len(b) - 2 * shared
            assert bands.pieces(top)[0] == 0 or np.intersect1d(bands.words(a, top), bands.words(b, top)).size


@pytest.mark.parametrize(("memory", "base"), [(1 << 22, 1 << 22), (8, 1 << 22), (1 << 22, 2)])
def test_suffix_array(tmp_path, monkeypatch, memory, base):
    monkeypatch.setattr(induced, "MEMORY", memory)
    monkeypatch.setattr(induced, "BASE", base)
    rnd = random.Random(3)
    for k in range(300):
        s = rnd.choice([1, 2, 3, 5])
        t = [rnd.randrange(s) for _ in range(rnd.randint(0, 60))]
        t = (t[: len(t) // 3 + 1] * 4)[: len(t)] if k % 3 == 0 else t
        for kind in (np.uint8, np.int64):
            order, common = induced.suffix_array(np.array(t, kind), s, 200, str(tmp_path))
            want = sorted(range(len(t)), key=lambda i: t[i:])
            assert order.tolist() == want
            for i in range(1, len(t)):
                a, b = t[want[i - 1] :], t[want[i] :]
                assert common[i] == next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("group", [2 << 20, 100])
def test_repeats_equal_brute_force(spark, docs, no_docs, corpus, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "SHARD", 5000)
    length, count = 40, Counter()
    raw = [(r[0], (r[1] or "").encode()) for r in corpus]
    for _, b in raw:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    want = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append(str((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    got = substrings.remove_repeats(docs, length, ("doc_id", "key")).drop("key").collect()
    assert sorted(want) == sorted(str(tuple(r)) for r in got)
    assert substrings.remove_repeats(no_docs).count() == 0


def labelled(n=600, seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("bcdfglmnrst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(10, 80))]
        bad = i % 7 == 0
        for _ in range(max(2, len(w) // 40) if bad else 0):
            w[rnd.randrange(len(w))] = rnd.choice(["zorkhead", "plonker", "zorkface", "wazzock"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark, docs, no_docs):
    rows = labelled()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = frame.select("doc_id", "toxic").union(spark.createDataFrame([(9999, 1), (None, 1), (3, None)], "doc_id bigint, toxic int"))
    model = toxicity.fit(frame, labels, F.col("doc_id") % 5 != 0, per_class=100)
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert np.mean([got[i].predicted == y for i, _, y in held]) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    assert all(e.toxic in (0, 1) and e.doc_id % 5 for r in got.values() for e in r.evidence)
    plain = toxicity.score(docs, model, ["doc_id", "position"])  # NULL, empty and long texts, other columns
    assert plain.count() == docs.count()
    assert toxicity.score(no_docs, model).count() == 0
    unlearnt = toxicity.fit(frame, labels.where("toxic = 0"), F.lit(True))
    assert {round(r.score, 9) for r in toxicity.score(frame, unlearnt).collect()} == {round(unlearnt.probability(0.0), 9)}


def test_a_text_inside_a_kept_row_travels_once(spark, docs):
    frame = spark.createDataFrame(labelled(), "doc_id bigint, text string, toxic int")
    model = toxicity.fit(frame, frame.select("doc_id", "toxic"), F.lit(True), per_class=100)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    out = toxicity.score(rows, model, ["row"], "row.text")
    assert "__text" not in plan(out)
    got = sorted((r.row.doc_id is not None, r.row.doc_id or 0, r.row.text or "", round(r.score, 9)) for r in out.collect())
    assert got == sorted((r.doc_id is not None, r.doc_id or 0, r.text or "", round(r.score, 9)) for r in toxicity.score(docs, model, ["doc_id", "text"]).collect())


def test_nearest_examples_are_exact(spark):
    rng = np.random.default_rng(2)
    n, v = 300, 40
    vectors = [{0: 1.0} | {int(t): float(rng.random()) for t in rng.choice(np.arange(1, v), rng.integers(0, 8), replace=False)} for _ in range(n)]
    model = toxicity.Model.build([str(i) for i in range(v)], vectors, rng.integers(0, 2, n).tolist(), list(range(n)), 9)
    dense = np.zeros((n, v))
    for i, x in enumerate(vectors):
        for t, r in x.items():
            dense[i, t] = np.log1p(r / toxicity.RATE) * model.idf[t]
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    for i in range(0, n, 3):
        place, cos = model.nearest(vectors[i], i)
        want = np.round(dense @ dense[i], 12)
        want[i] = -1
        order = np.lexsort((np.arange(n), -want))[:9]
        assert np.allclose(cos, want[order], atol=1e-9)


PAGES = [
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><article><header><h1>Head</h1></header><p>A &amp; <b>b</b>old&nbsp;c<br>d"
     "<div class='share'>no <div>no</div> no</div>tail</p><!-- x --><script>var t='</p>';</script></article><footer>&copy; f</footer></body></html>", "Head A & bold c d tail"),
    ("<main>x<div class='comments'><div>y</div>z</div> w<form>f<input></form></main>out", "x w"),
    ("<body><div id=cookie-notice>c</div><p class=ad>gone<p>stay</body>", "stay"),
    ("a < b and <i>c</i>d <p>e", "a < b and cd e"),
    ("<article><p>one<p>two<aside>s</aside></article", "one two"),
    ("", ""), (None, ""), ("<nav>only", ""), ("<ul><li hidden>h</li><li>shown</li></ul>", "shown"),
]


def test_page_texts(spark):
    rows = [(i, f"http://solo{i}.x/p", h, "c", "d") for i, (h, _) in enumerate(PAGES)]
    rnd = random.Random(1)
    menu, want = " ".join(f"menu{i}" for i in range(20)), {i: t for i, (_, t) in enumerate(PAGES)}
    for i in range(100, 160):
        body = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(50))
        rows.append((i, f"http://h{i % 2}.x/{i}", f"<html><body><div>{menu}</div><p>{body}</p></body></html>", "c", "d"))
        want[i] = body
    rows.append((200, "http://h0.x/copy", rows[len(PAGES)][2], "c", "d"))  # a copy doesn't wipe out its original
    want[200] = want[100]
    rows.append((201, None, f"<div>{menu}</div>", "c", "d"))  # no other page of its host
    want[201] = menu
    frame = spark.createDataFrame([*rows, rows[0]], "page_id bigint, url string, html string, text string, key string")
    got = html_text.main_text(frame).collect()
    assert len(got) == len(rows) + 1 and {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert html_text.main_text(frame.limit(0)).count() == 0


@pytest.mark.parametrize("wrapper", ["div class='layout with-sidebar'", "div class='content no-sidebar'", "div class=has-cookie-notice", "div id=page-hidden-menu", "div class=share-enabled",
                                     "div class='post-comments-open'", "div class='layout sidebar'", "form id=f", "div class=menu-wrapper"])
def test_articles_in_wrappers(wrapper):
    name, inside = wrapper.split()[0], "<article>a<div>b<div>c</div></div> d<div class=share-buttons>no</div></article>"
    assert html_text.read(f"<body><nav>n</nav><{wrapper}>{inside}</{name}><p>out</body>") == (True, ["a", "b", "c", "d"])
    assert html_text.read(f"<main>x<{wrapper}>{inside}</{name}>y</main>z") == (True, ["x", "a", "b", "c", "d", "y"])


def test_articles_of_others_stay_out():
    assert html_text.read("<article>a</article><div class=sidebar><article>teaser</article></div>") == (True, ["a"])
    assert html_text.read("<main>x<div id=comments><article>c</article></div><aside><article>t</article>u</aside>y</main>") == (True, ["x", "y"])
    assert html_text.read("<div class=with-sidebar><p>b</div><div class=comment-list><article>c</article></div>") == (False, ["b"])
    assert html_text.read("<div role=main>x<div>y</div>z</div>w") == (True, ["x", "y", "z"])


@pytest.mark.parametrize("name", "post-comments reader-comments user-comments comment-thread responses related-posts related-articles more-stories article-share sticky-share inline-ad google-ad "
                                 "top-ad author-box".split())
def test_chrome_inside_the_article_goes(name):
    assert html_text.read(f"<article><p>a</p><div class='{name}'><p>x</p></div><p>b</p></article>") == (True, ["a", "b"])


@pytest.mark.parametrize("name", ["site-header", "main-menu", "page-footer", "post-comments"])
def test_chrome_of_unmarked_pages_goes(name):
    assert html_text.read(f"<body><p>a</p><div class='{name}'><p>x</p></div><p>b</p></body>") == (False, ["a", "b"])


def test_comments_and_teasers_that_are_articles_go():
    story = "a long story of so many words that no other text is as long as this"
    assert html_text.read(f"<article><p>{story}</p><section><article>a reader says</article></section>end</article>") == (True, [story, "end"])
    assert html_text.read(f"<article>teaser</article><main>x<article>{story}</article></main><article>more</article>") == (True, ["x", story])
    assert html_text.read(f"<article>teaser<article>{story}</article></article>") == (True, ["teaser", story])
    assert html_text.read(f"<article>{story}</article><article>{story[:50]}</article>") == (True, [story, story[:50]])


def words(rnd, n):
    return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))


def test_hosts_decide_by_share(spark):
    """A story on two of eight pages stays, a short menu on all goes; so do lines that marked articles of a host share."""
    rnd = random.Random(3)
    story, menu, line = words(rnd, 40), "home news sport shop help about terms privacy", "Sign up for the letter and never miss a story again, free of charge"
    rows, want = [], {}
    for i in range(8):
        body = story + (" more" if i == 1 else "") if i < 2 else words(rnd, 50)
        rows.append((i, f"http://a.x/{i}", f"<body><div>{menu}</div><p>{body}</p></body>"))
        want[i] = body
    for i in range(10, 20):
        body = words(rnd, 30)
        rows.append((i, f"http://b.x/{i}", f"<article><p>{body}</p><p>{line}</p><div>Read on</div></article>"))
        want[i] = body
    for i in range(30, 36):  # all that these hold is shared: what structure calls an article is never emptied
        rows.append((i, f"http://c.x/{i}", f"<article>{line}<p>{'x' * i} page</p></article>" if i < 35 else f"<article>{line}</article>"))
        want[i] = f"{'x' * i} page" if i < 35 else line
    for i in range(40, 46):  # near copies are one page: the story stays
        near = story.split()
        near[i - 40] = "z"
        rows.append((i, "http://d.x/", f"<p>{' '.join(near)}</p>" if i < 44 else f"<p>{words(rnd, 30)}</p>"))
        want[i] = rows[-1][2][3:-4]
    frame = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id bigint, url string, html string, host string, key string")
    got = {r.page_id: r.text for r in html_text.main_text(frame).collect()}
    assert {k: v for k, v in got.items() if k < 40} == {k: v for k, v in want.items() if k < 40}
    assert sum(got[i] == want[i] for i in range(40, 46)) == 6


def test_shared_strings_equal_brute_force(spark):
    """Streams of few different tokens: what goes is what a plain search for shared strings finds."""
    rnd = random.Random(11)
    rows = [(i, f"http://h{i % 2}.x/", "<p>" + " ".join(rnd.choice("abc") for _ in range(rnd.randint(5, 160))) + ("" if i % 3 else " <p>a b c") + "</p>") for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    length = 6
    got = {r.page_id: r.text for r in html_text.main_text(frame, length=length, size=60).collect()}
    blocks = {i: html_text.read(h)[1] for i, _, h in rows}
    for h in (0, 1):
        own = {i: b for i, b in blocks.items() if i % 2 == h}
        distinct = {tuple(b) for b in own.values()}
        flat = {b: [w for x in b for w in x.split()] for b in distinct}
        strings, shorts = collections.Counter(), collections.Counter()
        for b in distinct:
            strings.update({tuple(flat[b][k:k + length]) for k in range(len(flat[b]) - length + 1)})
            shorts.update({x for x in b if len(x.split()) < length})
        enough = max(html_text.PAGES, html_text.SHARE * len(distinct))
        for i, b in own.items():
            w, gone = flat[tuple(b)], set()
            for k in range(len(w) - length + 1):
                if strings[tuple(w[k:k + length])] >= enough:
                    gone |= set(range(k, k + length))
            at = 0
            for x in b:
                n = len(x.split())
                if n < length and shorts[x] >= enough:
                    gone |= set(range(at, at + n))
                at += n
            assert got[i] == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_shared_strings_share_an_anchor():
    rng = np.random.default_rng(6)
    for _ in range(200):
        shared = " ".join(map(str, rng.integers(0, 9, 12)))
        a, b = (html_text.stream([" ".join(map(str, rng.integers(0, 9, rng.integers(0, 30)))), shared, "end"], 5) for _ in range(2))
        assert set(html_text.anchors(a, 12)) & set(html_text.anchors(b, 12))
    assert len(html_text.anchors(html_text.stream(["a b c"], 1), 12)) == 0


def test_batches_of_texts_stay_small_in_both_directions(monkeypatch):
    texts = [f"{k} " * 40_000 for k in range(30, 50)]  # 2.4 MB
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "text": texts, "hash": list(range(20)), "node": list(range(20)), "n": [1] * 20,
                                        "set": [xxhash.xxh3_128_digest(parity_join.shingles(t, 5).tobytes()) for t in texts]})
    for work in (parity_join._sets(5, 80), parity_join._details(5, 80)):
        got = list(work(iter([batch])))
        assert len(got) > 1 and pa.Table.from_batches(got).equals(pa.Table.from_batches([b for i in range(20) for b in work(iter([batch.slice(i, 1)]))]).combine_chunks())
    data = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([t.encode() for t in texts]), pa.nulls(20, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))], names=["row", "data", "found"])
    got = list(substrings._removed(200, ["row"], True)(iter([data])))
    assert len(got) > 1 and pa.Table.from_batches(got).column("c5").to_pylist() == texts


def test_a_worker_forgets_what_other_operators_remembered():
    forgot = []
    for operator in ("one", "one", "two"):
        with common.remembering(operator, lambda operator=operator: forgot.append(operator)):
            assert forgot == (["one"] if operator == "two" else [])
    parity_join.WORDS[b"word"] = 1
    list(parity_join._sets(5, 80)(iter([])))
    with common.remembering("three", list):
        assert not parity_join.WORDS
