"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Fitting takes a bounded sample of labelled texts (``per_class`` of each label, those whose ids have the least digests).
Terms are lower-case words and their first four and five letters; those whose share of texts differs between the labels
by at least ``least_z`` standard errors make the vocabulary, at most ``max_terms`` of them; one more term stands for any
word. A term's frequency is ``log(1 + rate / RATE)``, its rate being its count over the text's words and ``PRIOR`` more: insults are
told from chance by how dense they are. The sample's TF-IDF vectors over the vocabulary go into an inverted index in blocks, with the largest weight of every term per block. A text's bound for a block is
the product of its weights with those maxima; the blocks of the best bounds give a k-th best cosine, and every other block whose
bound reaches it is scored too, so the k nearest are exact. Their votes, weighted by cosine, go through a logistic
curve that is fitted on the sample with every example left out of its own neighbours.

Defined results: a NULL or empty text counts as one neutral word, whose nearest examples are those without other terms; labels that are
NULL or of unknown documents are not learnt from, a document with both labels counts as toxic; if no label of one kind is there
or no term tells them apart, every score is the smoothed share of toxic labels; repeated rows give repeated results; an empty table an empty result. Labels,
language, source and ids never enter a score; ids only pick the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataweft.llm.common import id_text, lengths, remembering, schema, slices
from dataweft.session import cut

WORDS = re.compile(r"[^\W\d_]+").findall
#: Distinct words after which a worker's memo starts anew.
MEMO = 400_000
BLOCK = 32
#: Rate that counts as one, and words that every text is taken to have besides its own.
RATE, PRIOR = 0.005, 40
ANY = 0  # the term of any word


def terms(word: str) -> set[str]:
    return {word, *(f"{word[:n]}^" for n in (4, 5) if len(word) >= n)}


@dataclass
class Model:
    """The block-max index of the examples and the curve; its size is bounded by the sample."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    example_ids: np.ndarray
    toxic: np.ndarray
    start: np.ndarray  # of the postings of (term, block), flat
    place: np.ndarray  # example of each posting
    weight: np.ndarray
    most: np.ndarray  # largest weight of a term in a block
    k: int
    slope: float = 1.0
    shift: float = 0.0
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)
    plain: tuple[np.ndarray, np.ndarray] | None = None  # neighbours of a text without any other term

    @property
    def blocks(self) -> int:
        return self.most.shape[1]

    @classmethod
    def build(cls, vocabulary: list[str], vectors: list[dict[int, float]], toxic: list[int], ids: list[int], k: int) -> Model:
        """``vocabulary`` begins with the term of any word."""
        n = len(vectors)
        df = np.bincount([t for v in vectors for t in v], minlength=len(vocabulary))
        idf = np.log1p(n / np.maximum(df, 1))
        rows = [(t, i, np.log1p(rate / RATE) * idf[t]) for i, v in enumerate(vectors) for t, rate in v.items()]
        t, i = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        w = np.array([r[2] for r in rows], np.float64)
        norm = np.sqrt(np.bincount(i, w * w, minlength=n))
        w = w / norm[i] if len(i) else w
        blocks = max(1, -(-n // BLOCK))
        cell = t * blocks + i // BLOCK
        order = np.argsort(cell, kind="stable")
        most = np.zeros(len(vocabulary) * blocks)
        np.maximum.at(most, cell, w)
        start = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=len(vocabulary) * blocks))))
        return cls({x: j for j, x in enumerate(vocabulary)}, idf, np.array(ids, np.int64), np.array(toxic, np.int64),
                   start.astype(np.int64), i[order], w[order], most.reshape(len(vocabulary), blocks), k)

    def rates(self, text: str | None) -> dict[int, float]:
        """Vocabulary terms of a text and their rates."""
        memo, found, words = self.memo, Counter(), WORDS((text or "").lower())
        for w in words:
            ids = memo.get(w)
            if ids is None:
                if len(memo) > MEMO:
                    memo.clear()
                ids = memo[w] = tuple(self.vocabulary[t] for t in terms(w) if t in self.vocabulary)
            if ids:
                found.update(ids)
        found[ANY] = max(1, len(words))
        return {t: n / (len(words) + PRIOR) for t, n in sorted(found.items())}

    def score_blocks(self, t: np.ndarray, q: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact cosines of the examples of some blocks that share a term with the text."""
        cell = (t[:, None] * self.blocks + blocks[None, :]).ravel()
        a, n = self.start[cell], self.start[cell + 1] - self.start[cell]
        total = int(n.sum())
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(total)
        place, inverse = np.unique(self.place[at], return_inverse=True)
        return place, np.bincount(inverse, self.weight[at] * np.repeat(np.repeat(q, len(blocks)), n), minlength=len(place))

    def nearest(self, rates: dict[int, float], without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples and their cosines; ties to the earlier example."""
        if not rates:
            return np.arange(0), np.zeros(0)
        plain = without < 0 and len(rates) == 1 and ANY in rates
        if plain and self.plain is not None:
            return self.plain
        t = np.fromiter(rates, np.int64, len(rates))
        q = np.log1p(np.fromiter(rates.values(), np.float64, len(rates)) / RATE) * self.idf[t]
        q /= np.sqrt(q @ q)
        bound = q @ self.most[t]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        k, first = self.k + (without >= 0), 2
        place, cos = self.score_blocks(t, q, order[:first])
        least = np.partition(cos, len(cos) - k)[len(cos) - k] if len(cos) > k else 0.0
        rest = order[first:]
        rest = rest[bound[rest] >= least - 1e-12]
        if len(rest):
            more = self.score_blocks(t, q, rest)
            place, cos = np.concatenate((place, more[0])), np.concatenate((cos, more[1]))
        cos = np.minimum(np.round(cos, 12), 1.0)  # equal vectors tie whatever the order of their sums
        keep = place != without
        place, cos = place[keep], cos[keep]
        top = np.lexsort((place, -cos))[: self.k]
        if plain:
            self.plain = place[top], cos[top]
        return place[top], cos[top]

    def vote(self, place: np.ndarray, cos: np.ndarray) -> float:
        return float(((2 * self.toxic[place] - 1) * cos).sum()) / self.k

    def probability(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.shift, -30, 30))))

    def calibrate(self, vectors: list[dict[int, float]], share: float) -> None:
        """Ridge logistic regression of the labels on the left-out votes, classes weighed to ``share`` of toxic labels."""
        x = np.array([[self.vote(*self.nearest(v, i)), 1.0] for i, v in enumerate(vectors)])
        y = self.toxic.astype(float)
        weight = np.where(y == 1, share / max(1.0, y.sum()), (1 - share) / max(1.0, (1 - y).sum())) * len(y)
        beta, ridge = np.zeros(2), np.diag([0.01, 0.01])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
            beta += step / max(1.0, np.abs(step).max() / 5)
            if np.abs(step).max() < 1e-10:
                break
        self.slope, self.shift = map(float, beta)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, texts, toxic texts) of each batch."""
    for batch in batches:
        n, bad = Counter(), Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = set().union(*map(terms, set(WORDS((text or "").lower()))))
            n.update(found)
            if toxic:
                bad.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([bad[t] for t in n], pa.int64())],
                                         names=["term", "n", "bad"])


def fit(documents: DataFrame, labels: DataFrame, train: Column, per_class: int = 1500, k: int = 9, least_z: float = 4.0, max_terms: int = 20_000) -> Model:
    """Learn from the labels whose rows fulfil ``train`` (a condition on doc_id), at most ``per_class`` of each kind."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(train)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    digest = F.md5(id_text().cast("binary"))
    sample = [known.where(F.col("toxic") == c).orderBy(digest).limit(per_class) for c in (0, 1)]
    share, total = known.agg(F.avg("toxic"), F.count("*")).first()
    share = ((share or 0.0) * total + 0.5) / (total + 1)
    picked = F.broadcast(sample[0].unionByName(sample[1]))  # 2 * per_class rows at most
    texts = documents.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    texts = cut(texts)
    sizes = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    empty = Model.build([""], [], [], [], k)
    empty.shift = float(np.log(share / (1 - share)))
    if not n0 or not n1:
        return empty
    counts = texts.select("text", "toxic").mapInArrow(_term_counts, "term string, n long, bad long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    p = F.col("n") / (n0 + n1)
    z = (F.col("bad") / n1 - (F.col("n") - F.col("bad")) / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    chosen = counts.where((F.col("n") > 1) & (F.col("n") < n0 + n1)).withColumn("z", F.abs(z)).where(F.col("z") >= least_z)
    vocabulary = [""] + sorted(r[0] for r in chosen.orderBy(F.desc("z"), "term").limit(max_terms).select("term").collect())
    if len(vocabulary) == 1:
        return empty
    bc = texts.sparkSession.sparkContext.broadcast(Model.build(vocabulary, [], [], [], k))  # at most max_terms terms

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [list(bc.value.rates(t).items()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([[x[0] for x in g] for g in got], pa.list_(pa.int32())),
                                              pa.array([[x[1] for x in g] for g in got], pa.list_(pa.float64()))], names=["doc_id", "toxic", "terms", "rates"])

    rows = texts.mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, rates array<double>").collect()  # the sample
    rows.sort(key=lambda r: (r["toxic"], r["doc_id"]))
    found = [dict(zip(r["terms"], r["rates"], strict=True)) for r in rows]
    model = Model.build(vocabulary, found, [r["toxic"] for r in rows], [r["doc_id"] for r in rows], k)
    model.calibrate(found, share)
    return model


def score(docs: DataFrame, model: Model, keep: Iterable[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``score``, ``predicted`` and ``evidence`` (nearest examples, their cosines and labels).

    ``text`` may be a field of a kept struct ("row.text"): such a text travels once.
    """
    keep = list(keep)
    first, *fields = text.split(".")
    at = keep.index(first) if fields and first in keep else -1
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bc.value
        with remembering("toxicity", own.memo.clear):
            for batch in batches:
                texts = batch.column(batch.num_columns - 1) if at < 0 else pc.struct_field(batch.column(at), fields)
                for a, b in slices(lengths(texts)):
                    scores, evidence = [], []
                    for t in texts.slice(a, b - a).to_pylist():
                        place, cos = own.nearest(own.rates(t))
                        scores.append(own.probability(own.vote(place, cos)))
                        evidence.append([{"doc_id": int(own.example_ids[i]), "cosine": float(c), "toxic": int(own.toxic[i])} for i, c in zip(place, cos, strict=True)])
                    kept = [batch.column(c).slice(a, b - a) for c in range(len(keep))]
                    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, kind)],
                                                     names=[*keep, "score", "predicted", "evidence"])

    src = docs.select(*keep, docs[text].alias("__text")) if at < 0 else docs.select(*keep)
    return src.mapInArrow(work, schema(docs, keep, "score double, predicted int, evidence array<struct<doc_id: bigint, cosine: double, toxic: int>>"))
