"""Byte-level BPE encoding and decoding with two tiers.

A text is split by the tokenizer's pattern. A pre-token whose bytes are in the vocabulary is found through a minimal
perfect hash and is one token. Every other pre-token is merged with a heap over linked bytes. Distinct pre-tokens
of a slice of texts are resolved together and remembered in a bounded memo.

Defined results: a NULL text counts as empty and has no ids; texts of any length are taken whole, long ones
in slices that end where no pre-token can cross; repeated rows give repeated results; an empty table an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from dataweft.llm.classes import Splitter, differences, tiktoken_characters
from dataweft.llm.common import lengths, remembering, schema, slices

#: Distinct pre-tokens after which a worker's memo starts anew (the last one is kept beside it), and characters of a text taken at a time.
MEMO, SLICE = 200_000, 1 << 20
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: levels of bit arrays, each keeping the keys alone in their slot.

    A key's index is the number of set bits before its slot. Strings outside the set get some index or -1, so the
    caller compares the stored string.
    """

    def __init__(self, keys: list[bytes], spread: float = 2.0):
        left = self.digest(keys)
        if len(np.unique(left)) != len(keys):
            raise ValueError("equal keys or digests")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0
        while len(left):
            size = max(64, int(len(left) * spread))
            slot = self._slot(left, len(self.levels), size)
            bits = np.bincount(slot, minlength=size) == 1
            self.levels.append((bits, total + np.cumsum(bits) - bits))
            total += int(bits.sum())
            left = left[~bits[slot]]

    @staticmethod
    def digest(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    @staticmethod
    def _slot(digest: np.ndarray, level: int, size: int) -> np.ndarray:
        x = digest + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        digest = self.digest(keys)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, before) in enumerate(self.levels):
            slot = self._slot(digest[open_], level, len(bits))
            hit = bits[slot]
            out[open_[hit]] = before[slot[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of least rank, the leftmost of equals, is joined until no pair has a rank."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    heap = []
    for i in range(n - 1):
        if (r := ranks.get(word[i : i + 2])) is not None:
            heap.append(r * n + i)
    heapq.heapify(heap)
    alive = bytearray(b"\1" * n)
    while heap:
        r, i = divmod(heapq.heappop(heap), n)
        if not alive[i] or (j := after[i]) >= n:
            continue
        end = after[j]
        if ranks.get(word[i:end]) != r:  # the pair that stood here has changed since
            continue
        alive[j] = 0
        after[i] = end
        if end < n:
            before[end] = i
            if (s := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(heap, s * n + i)
        if (p := before[i]) >= 0 and (s := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, s * n + p)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder of one rank file (lines of a base64 token and its rank) and one splitting pattern."""

    def __init__(self, content: bytes, pattern: str, different: dict[str, tuple[str, str]] | None = None):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.vocabulary = {i: t for t, i in self.ranks.items()}
        self.text_of = {i: str(i) for i in self.vocabulary}
        self.hash = PerfectHash(list(self.ranks))
        self.stored: list[bytes] = [b""] * len(self.ranks)
        for t, i in zip(self.ranks, self.hash.find(list(self.ranks)), strict=True):
            self.stored[i] = t
        self.split = Splitter(pattern, different or {})
        less = (different or {}).get(r"\p{L}", ("", ""))[1]  # letters here that the library doesn't know
        self.cut = regex.compile(rf"(?V1)(?<=\S) (?=[\p{{L}}--[{less}]])" if less else r"(?<=\S) (?=\p{L})")
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def resolve(self, tokens: set[str]) -> None:
        memo, older = self.memo, self.older
        if len(memo) > MEMO:
            memo, older = {}, memo
            self.memo, self.older = memo, older
        memo.update((t, older[t]) for t in tokens if t not in memo and t in older)
        new = [t for t in tokens if t not in memo]
        raw = [t.encode() for t in new]
        for t, b, i in zip(new, raw, self.hash.find(raw).tolist(), strict=True):
            memo[t] = (self.ranks[b],) if i >= 0 and self.stored[i] == b else tuple(merge(b, self.ranks))

    def parts(self, text: str) -> Iterator[str]:
        """Slices of a text before a space between a non-space and a letter, where every pre-token ends."""
        start = 0
        while len(text) - start > SLICE and (m := self.cut.search(text, start + SLICE)):
            yield text[start : m.start()]
            start = m.start()
        yield text[start:]

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        wanted = set().union(*split)
        self.resolve(wanted)
        get = self.memo.__getitem__
        return [[i for ids in map(get, tokens) for i in ids] for tokens in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str, list[int]]]:
        """Number of ids, digest of the ids, digest of the decoded bytes and the ids of each text."""
        small = [t or "" if len(t or "") <= SLICE else "" for t in texts]
        for text, ids in zip(texts, self.encode(small), strict=True):
            n, a, b, own = 0, hashlib.sha256(), hashlib.sha256(), []
            for got in [ids] if len(text or "") <= SLICE else (self.encode([p])[0] for p in self.parts(text)):
                a.update(("," * (n > 0 and len(got) > 0) + ",".join(map(self.text_of.__getitem__, got))).encode())
                b.update(self.decode(got))
                n += len(got)
                own = got if not own else own + got
            yield n, a.hexdigest(), b.hexdigest(), own


_CODECS: dict[bytes, Codec] = {}


def codec(content: bytes, pattern: str, different: dict[str, tuple[str, str]] | None = None) -> Codec:
    """The worker's codec of a rank file; built once per worker."""
    key = hashlib.md5(content + (pattern + repr(different)).encode()).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(content, pattern, different)
    return _CODECS[key]


def round_trip(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode every text and decode its ids: ``keep`` columns, ``n_tokens``, the two digests and, if asked for, ``ids``."""
    with open(rank_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast((f.read(), differences(tiktoken_characters)))  # a vocabulary file: under a megabyte

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value[0], pattern, ranks.value[1])
        with remembering("byte_bpe", _CODECS.clear):
            for batch in batches:
                texts = batch.column(batch.num_columns - 1)
                for a, b in slices(lengths(texts)):
                    n, x, y, ids = zip(*own.digests(texts.slice(a, b - a).to_pylist()), strict=True)
                    made = [pa.array(n, pa.int64()), pa.array(x), pa.array(y)] + [pa.array(ids, pa.list_(pa.int32()))] * with_ids
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), *made],
                                                     names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    src = docs.select(*keep, docs[text].alias("__text"))
    return src.mapInArrow(work, schema(docs, keep, SCHEMA + ", ids array<int>" * with_ids))
