"""Byte-level BPE, token counts and the language model."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_rows import corpus, docs, no_docs  # noqa: F401
import tiktoken
from tokenizers import Tokenizer

from dataweft.llm import attention_lm, byte_bpe, classes, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n=3000, seed=1):
    rnd = random.Random(seed)
    letters = [chr(i) for i in range(0x250)] + list("\u0558\u058b\u088f\u208f\u209e\u2c2f\ua7cb\U0001df40\U00011de3\U00031350") + list("\x1c\x85\xa0 ​　\U0001f600́٠中İΣẞ가가") + [
        "<|endoftext|>", "<|startoftext|>", "'S", "'ll", "  "]
    return ["".join(rnd.choice(letters if k % 2 else list(" \n\t'sat1é!re")) for _ in range(rnd.randint(0, 40))) for k in range(n)]


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return byte_bpe.Codec(f.read(), public_tokenizers.PATTERN, classes.differences(classes.tiktoken_characters))


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(codec):
    keys = [f"k{i}".encode() for i in range(5000)]
    found = byte_bpe.PerfectHash(keys).find(keys)
    assert sorted(found) == list(range(5000))


def test_encoding_equals_the_library(codec, reference, corpus):
    for t in [r[1] or "" for r in corpus] + odd_texts():
        got = codec.encode([t])[0]
        assert got == reference.encode_ordinary(t) and codec.decode(got) == t.encode()


def test_every_character_splits_as_in_the_library(codec, reference):
    """One text for each character of a stretch that holds differences, and for a sample of all others."""
    chars = [chr(i) for r in ((0x540, 0x5a0), (0x880, 0x8a0), (0x2080, 0x20a0), (0xa7c0, 0xa7e0), (0x1df00, 0x1df60), (0x31340, 0x313a0)) for i in range(*r)]
    chars += random.Random(2).sample([c for c in classes.ALL if ord(c) > 0xff], 3000)
    for c in chars:
        t = f"a{c}'t 1{c} {c}{c}"
        assert codec.encode([t])[0] == reference.encode_ordinary(t), hex(ord(c))


def test_long_texts_are_cut_where_no_token_crosses(codec, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", 50)
    text = " ".join(odd_texts(60, 3)) + " end of it " * 40
    n, ids, decoded, _ = next(codec.digests([text]))
    want = reference.encode_ordinary(text)
    assert n == len(want) and ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert decoded == hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_of_a_table(spark, docs, no_docs, corpus, reference):
    got = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "n_chars"), with_ids=True).collect()
    want = sorted((str(r[0]), reference.encode_ordinary(r[1] or "")) for r in corpus)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert all(r.decoded_sha256 in {hashlib.sha256((c[1] or "").encode()).hexdigest() for c in corpus} and r.n_tokens == len(r.ids) for r in got)
    assert byte_bpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_counts_equal_the_library(spark, docs, no_docs, corpus):
    library = Tokenizer.from_file(WORDS)
    with open(WORDS, encoding="utf-8") as f:
        own = token_counts.counter(f.read(), None, classes.differences(classes.tokenizers_characters))
    texts = odd_texts()
    assert own.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    single = random.Random(2).sample(sorted(own.single), 500)
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in single)
    got = token_counts.count_tokens(docs, WORDS, limit=100).collect()
    want = [(str(r[0]), len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 100) for r in corpus]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(want)
    assert token_counts.count_tokens(no_docs, WORDS).count() == 0


def test_every_id_is_scored_in_one_window():
    rng = np.random.default_rng(0)
    seqs = [rng.integers(0, 1000, n).astype(np.int32) for n in (1, 7, 8, 9, 31, 32, 33, 57, 400)]
    source, target, counted, owner = attention_lm.windows(seqs)
    for i, s in enumerate(seqs):
        mine = owner == i
        assert target[mine][counted[mine]].tolist() == s.tolist()
        assert source[mine][counted[mine]].tolist() == [attention_lm.END, *s[:-1].tolist()]


def test_gradient_and_normalisation():
    rng = np.random.default_rng(0)
    tables = attention_lm.Tables(rng.integers(0, 50, attention_lm.SUBWORDS**2))
    flat = attention_lm.start().astype(np.float64)
    flat[-1024:] += rng.normal(0, 0.3, 1024)
    source, target = rng.integers(0, 1024, (2, 3, attention_lm.WINDOW))
    counted = rng.random(source.shape) < 0.8
    _, g = attention_lm.gradient(flat, tables, source, target, counted)
    for i in rng.integers(attention_lm.SUBWORDS * attention_lm.WIDTH, attention_lm.WEIGHTS, 12).tolist() + [int(source[0, 0]) * attention_lm.WIDTH + 3]:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        slope = (attention_lm.gradient(up, tables, source, target, counted)[0] - attention_lm.gradient(down, tables, source, target, counted)[0]) / 2e-4
        assert slope == pytest.approx(g[i], rel=1e-3, abs=1e-6)
    w, one = attention_lm.unpack(flat), np.ones((attention_lm.SUBWORDS, attention_lm.WINDOW), bool)
    same = np.broadcast_to(source[0], one.shape).copy()
    last = np.broadcast_to(target[0], one.shape).copy()
    last[:, -1] = np.arange(attention_lm.SUBWORDS)
    p = attention_lm.logs(attention_lm.Reader(w), tables, same, last, one).reshape(one.shape)[:, -1]
    assert np.exp(p).sum() == pytest.approx(1, abs=1e-4)
    assert np.allclose(attention_lm.Reader(w).hidden(source), attention_lm.attend(w, source)[0], atol=1e-4)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    seqs = [np.tile(rng.integers(0, 900, 5), 40).astype(np.int32) for _ in range(60)]  # what counts of pairs can't tell apart fully
    tables = attention_lm.Tables(np.ones(attention_lm.SUBWORDS**2))
    before = attention_lm.score_sequences(attention_lm.unpack(attention_lm.start()), tables, seqs).sum()
    flat, seen = attention_lm.train(attention_lm.start(), tables, iter([seqs] * 3))
    assert seen == 3 * sum(map(len, seqs))
    assert attention_lm.score_sequences(attention_lm.unpack(flat), tables, seqs).sum() > before + 100


def test_language_model_scores(spark, docs, no_docs, corpus, monkeypatch):
    monkeypatch.setattr(attention_lm, "BUCKET", 20_000)
    got = attention_lm.score(docs, RANKS).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter()
    for r in corpus:
        if not held(r[0]):
            count.update([*(r[1] or "").encode().lower().split(), b""])
    total, low = sum(count.values()), sum(count.values()) + len(count) + 1
    want = {}
    for r in corpus:
        tokens = [*(r[1] or "").encode().lower().split(), b""]
        want.setdefault(str(r[0]), []).append((len(tokens), sum(count[t] > 0 for t in tokens), sum(math.log10((count[t] + 1) / low) for t in tokens)))
    assert len(got) == len(corpus)
    for r in got:
        assert r.train_tokens == total and r.held_out == held(r.doc_id) and r.score < 0
        assert any(r.n_tokens == a and r.n_known == b and r.base_score == pytest.approx(c) for a, b, c in want[str(r.doc_id)])
    assert attention_lm.score(no_docs, RANKS).count() == 0


def test_weights_learn_from_every_training_document(spark, docs, corpus):
    with open(RANKS, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    own = attention_lm.encoder(ranks.value)
    tables = attention_lm.Tables(np.ones(attention_lm.SUBWORDS**2))
    flat, seen = attention_lm.fit(docs.select("doc_id", "text"), ranks, tables)
    assert seen == sum(len(attention_lm.ids(own, attention_lm.words(r[1]))) for r in corpus)
    assert attention_lm.CONTEXT >= 8 and not np.array_equal(flat, attention_lm.start())


def test_scores_equal_a_loop_over_ids():
    rng = np.random.default_rng(8)
    lm = attention_lm
    tables = lm.Tables(rng.integers(0, 9, lm.SUBWORDS**2))
    w = lm.unpack((lm.start() + rng.normal(0, 0.1, lm.WEIGHTS)).astype(np.float32))
    seqs = [np.append(rng.integers(0, lm.END, n), lm.END).astype(np.int32) for n in (0, 1, 7, 31, 32, 33, 90)]

    def part(z, pick):
        return z[pick] - np.log(np.exp(z - z.max()).sum()) - z.max()

    want = []
    for seq in seqs:
        total, start, done = 0.0, 0, 0
        while done < len(seq):
            given = [lm.END, *seq.tolist()]
            for t in range(done - start, min(lm.WINDOW, len(seq) - start)):
                e = np.array([w["e"][given[start + j]] + w["p"][j] for j in range(t + 1)])
                q, k, v = e[t] @ w["q"] / np.sqrt(lm.WIDTH), e @ w["k"], e @ w["v"]
                a = np.exp(k @ q)
                h = e[t] + (a / a.sum()) @ v @ w["o"]
                x, (hi, lo) = given[start + t], divmod(int(seq[start + t]), lm.HALF)
                total += part(tables.upper[x] + h @ w["u"], hi) + part(tables.lower[x * lm.HALF + hi] + h @ w["l"], lo)
            done = start + min(lm.WINDOW, len(seq) - start)
            start += lm.STRIDE
        want.append(total / np.log(10))
    assert np.allclose(lm.score_sequences(w, tables, seqs), want, rtol=1e-4)


def test_words_met_again_have_the_ids_of_whole_texts(corpus, monkeypatch):
    with open(RANKS, "rb") as f:
        own = attention_lm.encoder(f.read())
    plain = own.encoding
    texts = [attention_lm.words(r[1]) for r in corpus] + [attention_lm.words("naïve Ünï 12,3  x y 'tis")]
    want = [[*(plain.encode_ordinary(b"".join(b" " + w for w in t).decode()) if t else []), attention_lm.END] for t in texts]
    for memo in (attention_lm.MEMO, 0):  # with and without room
        monkeypatch.setattr(attention_lm, "MEMO", memo)
        assert [attention_lm.ids(own, t).tolist() for t in texts] == want
    assert own.held < 1 << 20


def test_context_alone_is_not_asked():
    rng = np.random.default_rng(3)
    lm = attention_lm
    tables = lm.Tables(rng.integers(0, 9, lm.SUBWORDS**2))
    flat = (lm.start() + rng.normal(0, 0.1, lm.WEIGHTS)).astype(np.float64)
    source, target, counted, _ = lm.windows([rng.integers(0, 1000, n).astype(np.int32) for n in (5, 40, 300, 900)])
    batches = lm.pieces(counted, rng.permutation(len(source)))
    assert sorted(np.concatenate(batches).tolist()) == list(range(len(source))) and {lm.from_place(counted[b]) for b in batches} == {0, lm.CONTEXT}
    later = np.flatnonzero(~counted[:, 0])
    whole = lm.Reader(lm.unpack(flat)).grid(tables, source[later], target[later], 0)
    assert np.allclose(whole[:, lm.CONTEXT :], lm.Reader(lm.unpack(flat)).grid(tables, source[later], target[later], lm.CONTEXT), atol=1e-4)
    one = lm.gradient(flat, tables, source[later], target[later], counted[later])
    both = [lm.gradient(flat, tables, source[b], target[b], counted[b]) for b in (later[:7], later[7:])]
    share = [np.count_nonzero(counted[b]) / np.count_nonzero(counted[later]) for b in (later[:7], later[7:])]
    assert one[0] == pytest.approx(sum(x[0] * y for x, y in zip(both, share, strict=True))) and np.allclose(one[1], sum(x[1] * y for x, y in zip(both, share, strict=True)))
