"""Ranked lexical search with Block-Max MaxScore over shards of an inverted index.

The index covers every document and the terms of the stated items. A shard holds the documents of one stretch of a partition in
blocks of ``BLOCK`` documents; a term's postings in a block are one byte for the place and one for the frequency (larger ones
stand apart), beside the block's greatest frequency and least document length. From these and the statistics of all documents
follow upper bounds of a term's score for the whole shard and for each block.

A shard is searched item by item. The lists whose bounds together stay under the k-th best score so far are non-essential: a document
that only they hold can't enter. Essential lists are decoded and summed; what is left of the candidates meets the
non-essential lists, strongest first, and a candidate whose sum and block maxima stay under the k-th best score goes before the
block is decoded. Heaps live through the shards of a task; Spark merges the tasks' heaps, so the result is exact.

Statistics and scores: N counts the documents with a term, L their terms; weights are floors of doubles, all else is 64-bit
integers (exact Python integers for products beyond). Items come in blocks that bound what a task is sent.

Defined results: NULL or empty texts hold no terms, neither documents nor items then take part; repeated rows are documents of their own;
documents without an id rank after all others of their score, with a NULL id; items that repeat an id are ranked each for itself;
an empty table on either side gives no rows. Other columns don't travel.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dataweft.llm.common import lengths, slices
from dataweft.llm.vectors import small_batches
from dataweft.operators.ordering import with_row_id
from dataweft.session import cut, work_path

#: Documents in a block; documents and terms after which a shard ends; bytes of a text taken at once.
BLOCK, SHARD, SHARD_TERMS, PIECE = 128, 1 << 15, 4 << 20, 1 << 20
#: Bytes of item texts and items in a block of items.
ITEM_BYTES, ITEMS = 1 << 20, 1024
# Constants of the score.
K, B, SCALE, WEIGHT = 12, 25, 1_000_000_000, 1000

#: ASCII letters in lower case, digits and all bytes of other characters stay, every other byte parts terms.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about ``PIECE`` bytes."""
    if len(text) <= PIECE:
        yield text.translate(TERMS).split()
        return
    text, at = text.translate(TERMS), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class Vocabulary(dict):
    """Numbers of the items' terms, -1 for any other."""

    def __missing__(self, term: bytes) -> int:
        return -1


# -- index ------------------------------------------------------------------------------------------------------------

INDEX = ("n_docs long, n_terms long, ids array<long>, sizes array<long>, terms array<int>, df array<int>, starts array<int>, blocks array<int>, "
         "counts array<int>, most array<long>, least array<long>, postings binary, large array<long>")


class Shard:
    """Collects documents and turns them into a row of the index."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.docs: list[np.ndarray] = []
        self.found: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, text: bytes, vocabulary: Vocabulary) -> None:
        size, ids = 0, []
        for part in terms(text):
            size += len(part)
            known = np.fromiter(map(vocabulary.__getitem__, part), np.int32, len(part))
            ids.append(known[known >= 0])
        if not size:
            return
        known = np.concatenate(ids)
        self.found.append(known)
        self.docs.append(np.full(len(known), len(self.ids), np.int32))
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.held += len(known) + 1

    def full(self) -> bool:
        return len(self.ids) >= SHARD or self.held >= SHARD_TERMS

    def row(self) -> dict:
        n, sizes = len(self.ids), np.array(self.sizes, np.int64)
        key, tf = np.unique(np.concatenate(self.found).astype(np.int64) * n + np.concatenate(self.docs), return_counts=True)
        term, doc = key // n, key % n
        cell = term * (-(-n // BLOCK)) + doc // BLOCK  # a term's block
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        begins = np.flatnonzero(np.diff(term, prepend=-1))
        listed = np.searchsorted(first, begins)
        large = np.flatnonzero(tf > 255)
        postings = np.stack([(doc % BLOCK).astype(np.uint8), np.where(tf > 255, 0, tf).astype(np.uint8)], axis=1)
        some = len(first) > 0
        return {"n_docs": n, "n_terms": int(sizes.sum()), "ids": self.ids, "sizes": self.sizes, "terms": term[begins], "df": np.diff(begins, append=len(term)),
                "starts": np.append(listed, len(first)), "blocks": doc[first] // BLOCK, "counts": np.diff(first, append=len(term)),
                "most": np.maximum.reduceat(tf, first) if some else tf, "least": np.minimum.reduceat(sizes[doc], first) if some else tf, "postings": postings.tobytes(),
                "large": np.stack([large, tf[large]], axis=1).ravel()}


def _row_batch(row: dict) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
    names = [c.split()[0] for c in INDEX.split(", ")]
    wide = {n: kinds[c.split()[1]] for n, c in zip(names, INDEX.split(", "), strict=True)}
    return pa.RecordBatch.from_arrays([pa.array([row[n]], wide[n]) for n in names], names=names)


def build_index(docs: DataFrame, words: Sequence[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per shard: every document with a term, postings of the given terms only."""
    vocabulary = Vocabulary((w, k) for k, w in enumerate(words))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            for start, end in slices(lengths(texts)):
                for k, value in zip(range(start, end), texts.slice(start, end - start).to_pylist(), strict=True):
                    if value:
                        shard.add(ids[k], value, vocabulary)
                        if shard.full():
                            yield _row_batch(shard.row())
                            shard = Shard()
        if shard.ids:
            yield _row_batch(shard.row())

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(work, INDEX)


# -- search -----------------------------------------------------------------------------------------------------------

def weight(n: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n + 2) / (2 * df + 1)))


def normalisers(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents of the given sizes."""
    if len(sizes) and B * int(sizes.max()) * n >= 1 << 63:
        return np.array([100 - B + (B * int(x) * n) // total for x in sizes], np.int64)
    return 100 - B + (B * sizes * n) // total


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (WEIGHT * tf + K * m)


class Lists:
    """The lists of a shard with their bounds, decoded block by block."""

    def __init__(self, row: dict, n: int, total: int, weights: np.ndarray):
        self.n_docs = row["n_docs"]
        self.n_blocks = -(-self.n_docs // BLOCK)
        self.m = normalisers(row["sizes"], n, total)
        self.place = {int(t): k for k, t in enumerate(row["terms"])}
        self.weight = weights[row["terms"]]
        self.starts, self.blocks, self.counts = row["starts"], row["blocks"], row["counts"]
        self.first = np.cumsum(self.counts) - self.counts
        pairs = np.frombuffer(row["postings"], np.uint8).reshape(-1, 2)
        self.offset, self.tf = pairs[:, 0], pairs[:, 1]
        self.large = dict(row["large"].reshape(-1, 2).tolist())
        cells = impact(row["most"], normalisers(row["least"], n, total))
        self.bound = cells * np.repeat(self.weight, np.diff(self.starts))
        self.most = np.maximum.reduceat(self.bound, self.starts[:-1]) if len(self.bound) else self.bound
        self.decoded = 0

    def maxima(self, k: int) -> np.ndarray:
        """The block maxima of a list, 0 for blocks without postings."""
        out = np.zeros(self.n_blocks, np.int64)
        span = slice(self.starts[k], self.starts[k + 1])
        out[self.blocks[span]] = self.bound[span]
        return out

    def decode(self, k: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of a list, of the wanted blocks (a mask) only."""
        cells = np.arange(self.starts[k], self.starts[k + 1])
        if wanted is not None:
            cells = cells[wanted[self.blocks[cells]]]
        counts = self.counts[cells]
        self.decoded += len(cells)
        total = int(counts.sum())
        at = np.repeat(self.first[cells] - np.cumsum(counts) + counts, counts) + np.arange(total)
        docs = np.repeat(self.blocks[cells].astype(np.int64) * BLOCK, counts) + self.offset[at]
        tf = self.tf[at].astype(np.int64)
        for i in np.flatnonzero(tf == 0):
            tf[i] = self.large[int(at[i])]
        return docs, impact(tf, self.m[docs]) * self.weight[k]


class Best:
    """The k best (score, id) of one item; documents without an id come after the others of their score."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def least(self) -> int:
        """A document of a lower score can't enter."""
        return self.heap[0][0] if len(self.heap) >= self.k else 1

    def add(self, docs: np.ndarray, scores: np.ndarray, ids: Sequence[int | None]) -> None:
        keep = scores >= self.least()
        docs, scores = docs[keep], scores[keep]
        if len(scores) > self.k:  # ties of the k-th stay
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            docs, scores = docs[keep], scores[keep]
        for d, s in zip(docs.tolist(), scores.tolist(), strict=True):
            i = ids[d]
            entry = (s, i is not None, 0 if i is None else -i)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)

    def rows(self) -> Iterable[tuple[int | None, int]]:
        return ((-i if named else None, s) for s, named, i in self.heap)


def search_shard(lists: Lists, item: Sequence[tuple[int, int]], best: Best, ids: Sequence[int | None]) -> None:
    """Enter the shard's documents into ``best``; ``item`` holds (term, repeats)."""
    mine = [(int(lists.most[k]) * r, k, r) for k, r in ((lists.place.get(t), r) for t, r in item) if k is not None]
    if not mine:
        return
    mine.sort()
    theta, bounds = best.least(), np.cumsum([b for b, _, _ in mine])
    split = int(np.searchsorted(bounds, theta, side="left"))  # so many lists together stay under theta
    if split == len(mine):
        return
    score, met = np.zeros(lists.n_docs, np.int64), np.zeros(lists.n_docs, bool)
    for _, k, r in mine[split:]:
        docs, s = lists.decode(k)
        score[docs] += s * r
        met[docs] = True
    cand = np.flatnonzero(met)
    rest = np.zeros(lists.n_blocks, np.int64)
    maxima = [lists.maxima(k) * r for _, k, r in mine[:split]]
    for x in maxima:
        rest += x
    for j in range(split - 1, -1, -1):
        cand = cand[score[cand] + rest[cand // BLOCK] >= theta]
        if not len(cand):
            return
        wanted = np.zeros(lists.n_blocks, bool)
        wanted[cand // BLOCK] = True
        docs, s = lists.decode(mine[j][1], wanted)
        score[docs] += s * mine[j][2]  # of documents that aren't candidates the sum is never read
        rest -= maxima[j]
    best.add(cand, score[cand], ids)


def _search(items: dict[int, list[tuple[int, int]]], weights: np.ndarray, n: int, total: int, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {i: Best(k) for i in items}
        for batch in batches:
            for at in range(batch.num_rows):
                cells = {c: batch.column(c)[at] for c in batch.schema.names}
                row = {c: x.values.to_numpy(zero_copy_only=False) for c, x in cells.items() if pa.types.is_list(x.type) and c != "ids"}
                row |= {"n_docs": cells["n_docs"].as_py(), "postings": cells["postings"].as_buffer()}
                lists, ids = Lists(row, n, total, weights), cells["ids"].as_py()
                for i, item in items.items():
                    search_shard(lists, item, heaps[i], ids)
        found = [(i, d, s) for i, best in heaps.items() for d, s in best.rows()]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], names=["item", "doc_id", "score"])
    return work


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The numbered items in blocks of at most ``ITEMS`` items and about ``ITEM_BYTES`` bytes."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append((row["item"], bytes(row["text"] or b"")))
        size += len(block[-1][1])
        if len(block) >= ITEMS or size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def rank(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item, of scores above 0."""
    spark: SparkSession = docs.sparkSession
    path = work_path(spark, "items")
    with_row_id(items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("text")), ["item_id", "text"], "item").write.parquet(path)
    numbered = spark.read.parquet(path)
    out = None
    for block in _blocks(numbered.select("item", "text").orderBy("item")):
        asked = {i: Counter(t for part in terms(x) for t in part) for i, x in block}
        words = sorted({t for c in asked.values() for t in c})
        if not words:
            continue
        shards = work_path(spark, "index")
        build_index(docs, words, doc_id, text).write.parquet(shards)
        index = spark.read.parquet(shards)
        n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        if not n:
            break
        df = np.zeros(len(words), np.int64)
        listed = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df"))
        for t, c in listed.collect():  # one row per term of the block
            df[t] = c
        number = {t: i for i, t in enumerate(words)}
        weights = np.array([weight(n, int(x)) for x in df], np.int64)
        lists = {i: sorted((number[t], r) for t, r in c.items() if weights[number[t]] > 0) for i, c in asked.items()}
        with small_batches(spark):  # a row is a whole shard
            found = cut(index.mapInArrow(_search({i: x for i, x in lists.items() if x}, weights, n, total, k), "item long, doc_id long, score long"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item long, doc_id long, score long")
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
