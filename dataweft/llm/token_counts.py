"""Token counts of a BPE vocabulary with word ends, without making the tokens where possible.

Offline, on the driver, every vocabulary string that ends a word is merged once; those that come out as one token are
proved to be whole tokens, whatever stands around them, since merges never cross pre-tokens. Executors get that list
with the merges (one vocabulary file, under two megabytes). A pre-token on the list counts one; only the rest is merged.

Understood: NFC, white space to one space and lower case before the split, a split that keeps the pattern's matches,
bytes as characters, an end-of-word suffix, and special tokens found in the raw text, each counting one.
Other settings raise an error instead of giving other counts.

Defined results: a NULL text counts as empty, with 0 bytes and 0 tokens; texts of any length are taken whole; repeated
rows give repeated results; an empty table an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dataweft.llm.classes import Splitter, differences, tokenizers_characters
from dataweft.llm.common import lengths, schema, slices

#: Distinct pre-tokens after which a worker's memo starts anew; the last one is kept beside it.
MEMO = 200_000
#: Capitals of Unicode 16 and their small letters, which Python's tables may not have yet (fixed values).
NEW_CAPITALS = {"\ua7cb": "\u0264", "\ua7dc": "\u019b"}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints in Latin-1, else the next one from 256 on."""
    out, more = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


class Counter:
    def __init__(self, content: str, single: Iterable[str] | None = None, different: dict[str, tuple[str, str]] | None = None):
        spec = json.loads(content)
        model, parts = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = parts
        if (model["type"], kinds, split["type"], split["behavior"], split["invert"], level["type"], level["use_regex"], level["add_prefix_space"]) != (
                "BPE", ["NFC", "Replace", "Lowercase"], "Split", "Removed", True, "ByteLevel", False, False) or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("a tokenizer of this kind is not understood")
        self.suffix = model["end_of_word_suffix"]
        self.letters = byte_letters()
        ids = model["vocab"]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[ids[a], ids[b]] = (r, ids[a + b])
        self.inner = [ids[x] for x in self.letters]
        self.last = [ids[x + self.suffix] for x in self.letters]
        self.matches = Splitter(split["pattern"]["Regex"], different or {})
        special = [t["content"] for t in spec["added_tokens"]]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens of this kind are not understood")
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.single = frozenset(self.prove(ids) if single is None else single)

    def prove(self, vocabulary: Iterable[str]) -> Iterator[str]:
        """Pre-tokens that are a vocabulary string with its word end and that merge to one token."""
        byte_of = {x: b for b, x in enumerate(self.letters)}
        for t in vocabulary:
            if t.endswith(self.suffix) and (body := t[: -len(self.suffix)]) and all(c in byte_of for c in body):
                raw = bytes(byte_of[c] for c in body)
                try:
                    text = raw.decode()
                except UnicodeDecodeError:
                    continue
                if self.merged(raw) == 1:
                    yield text

    def merged(self, word: bytes) -> int:
        """Number of tokens of a pre-token: the pair of least rank, the leftmost of equals, joins until none is left."""
        ids = [self.inner[b] for b in word[:-1]]
        ids.append(self.last[word[-1]])
        n, get = len(ids), self.pairs.get
        heap = [found[0] * n + i for i in range(n - 1) if (found := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n)), n
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j >= n or (found := get((ids[i], ids[j]))) is None or found[0] != r:
                continue
            ids[i], ids[j] = found[1], -1
            left -= 1
            end = after[i] = after[j]
            if end < n:
                before[end] = i
                if (found := get((ids[i], ids[end]))) is not None:
                    heapq.heappush(heap, found[0] * n + i)
            p = before[i]
            if p >= 0 and (found := get((ids[p], ids[i]))) is not None:
                heapq.heappush(heap, found[0] * n + p)
        return left

    def normal(self, text: str) -> str:
        """NFC and lower case, letter by letter: a final sigma has no form of its own here."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        for a, b in NEW_CAPITALS.items():
            text = text.replace(a, b)
        return text.lower()

    def count(self, texts: list[str | None]) -> list[int]:
        split, extra = [], []
        for t in texts:
            parts = self.special.split(t or "") if self.special else [t or ""]
            extra.append(len(parts) - 1)
            split.append([x for p in parts for x in self.matches(self.normal(p))])
        self.resolve(set().union(*split))
        get = self.memo.__getitem__
        return [n + sum(map(get, tokens)) for n, tokens in zip(extra, split, strict=True)]

    def resolve(self, tokens: set[str]) -> None:
        memo, older = self.memo, self.older
        if len(memo) > MEMO:
            memo, older = {}, memo
            self.memo, self.older = memo, older
        memo.update((t, older[t]) for t in tokens if t not in memo and t in older)
        memo.update(dict.fromkeys((tokens & self.single) - memo.keys(), 1))
        memo.update((t, self.merged(t.encode())) for t in tokens - memo.keys())


_COUNTERS: dict[bytes, Counter] = {}


def counter(content: str, single: Iterable[str] | None = None, different: dict[str, tuple[str, str]] | None = None) -> Counter:
    """The worker's counter of a vocabulary; built once per worker."""
    key = hashlib.md5((content + repr(different)).encode()).digest()
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(content, single, different)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every text."""
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    known = docs.sparkSession.sparkContext.broadcast((content, sorted(counter(content).single), differences(tokenizers_characters)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(*known.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            size = [n or 0 for n in lengths(texts)]
            for a, b in slices(size):
                n = own.count(texts.slice(a, b - a).to_pylist())
                kept = [batch.column(k).slice(a, b - a) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(size[a:b], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                                                 names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    src = docs.select(*keep, docs[text].alias("__text"))
    return src.mapInArrow(work, schema(docs, keep, "n_bytes long, n_tokens long, over_limit boolean"))
