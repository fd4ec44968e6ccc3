"""Substring deduplication: every byte covered by a string of ``length`` bytes that also starts elsewhere is removed.

A string's anchor is its gram of least hash, so equal strings have equal anchors at equal places. A document's anchors cut
its string starts into runs; a run with the bytes its strings cover is a region. Regions of one anchor hash form a group, and
equal strings can only lie in one group. A region that occurs twice is repeated as a whole. Where a group has different
regions, one copy of each goes to a shard with whole groups, and the shard's suffix array (``induced``) is sorted
externally: neighbours with a common prefix of ``length`` start equal strings. A group too large for a shard is split by
the strings themselves, whose 128-bit hashes Spark counts.

Two passes of one shuffle of the texts: the first cuts out the regions that shards need, the last removes the bytes.

Defined results: a NULL text counts as empty; a text shorter than ``length`` loses nothing; copies of a text that long lose all;
rows with and without an id are handled alike; an empty table gives an empty result. Grams, regions and texts are told apart by
64-bit hashes (texts also by their length); what a suffix array compares are the bytes.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataweft.llm import induced
from dataweft.llm.common import lengths, remembering, slices
from dataweft.operators.ordering import attach
from dataweft.session import cut

#: Most bytes of a gram; bytes of regions in a shard, and in a group that a shard takes.
GRAM, SHARD, GROUP = 32, 3 << 20, 2 << 20
TOP, PLACE = np.uint64(0xFFFFFFFFFF000000), np.uint64(0xFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_bytes(length: int) -> int:
    """Bytes of a gram: a power of two, at most a third of a string. Long grams seldom meet by chance, short ones make fewer regions."""
    return 1 << (max(1, min(GRAM, length // 3)).bit_length() - 1)


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on; doubles the span until it is reached."""
    h, span = raw.astype(np.uint64) + np.uint64(1), 1
    while span < size:
        h = mixed(h[:-span] * np.uint64(0x9E3779B97F4A7C15) + h[span:])
        span *= 2
    return h


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(x)
    y = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, width)
    up = np.minimum.accumulate(y, 1).ravel()
    down = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(down[: n - width + 1], up[width - 1 : n])


def regions(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, number of starts) of a text's runs of strings."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = gram_bytes(length)
    h, width, step = gram_hashes(raw, size), length - size + 1, 1 << 23
    anchor = []
    for a in range(0, len(raw) - length + 1, step):  # places fit the low bits of what is compared
        part = h[a : a + step + width - 1]
        tagged = (part & TOP) | np.arange(len(part), dtype=np.uint64)
        anchor.append((least(tagged, width) & PLACE).astype(np.int64) + a)
    at = np.concatenate(anchor)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return h[at[first]].view(np.int64), first, np.diff(np.append(first, len(at)))


def _occurrences(length: int, across: bool):
    """Rows (key, bytes, anchor, region, starts, start, more): a unit's first place of one region and its other ones, if any.

    A task shows no unit more than twice (once if only other units count): copies only have to be seen.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        digest = xxhash.xxh3_64_intdigest
        with remembering("substrings", list):
            for batch in batches:
                for i, j in slices(lengths(batch.column(1))):
                    rows: list[tuple] = []
                    for key, d in zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i), strict=True):
                        raw = d.as_buffer()
                        if raw is None or raw.size < length:
                            continue
                        seen[key] = seen.get(key, 0) + 1
                        if seen[key] > (1 if across else 2):
                            continue
                        view, found = memoryview(raw), {}
                        for a, s, n in zip(*(x.tolist() for x in regions(np.frombuffer(raw, np.uint8), length)), strict=True):
                            found.setdefault((a, digest(view[s : s + n + length - 1]), n), []).append(s)
                        rows += [(key, raw.size, a, r, n, at) for (a, r, n), at in found.items()]
                    if rows:
                        key, size, a, r, n, at = zip(*rows, strict=True)
                        first, more = [x[0] for x in at], [x[1:] or None for x in at]
                        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(size, pa.int64()), pa.array(a, pa.int64()), pa.array(np.array(r, np.uint64).view(np.int64)),
                                                          pa.array(n, pa.int16()), pa.array(first, pa.int32()), pa.array(more, pa.list_(pa.int32()))],
                                                         names=["key", "bytes", "anchor", "region", "starts", "start", "more"])
    return work


def _cut_out(length: int):
    """The bytes of the wanted regions of units that stand by key; copies that follow each other are looked at once."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows: list[tuple] = []
            for key, n, data, wanted in zip(batch.column("key").to_pylist(), batch.column("bytes").to_pylist(), batch.column("data"), batch.column("wanted"), strict=True):
                if (key, n) == last or not wanted.is_valid:
                    continue
                last, raw = (key, n), data.as_buffer()
                rows += [(key, w["anchor"], w["region"], w["starts"], w["many"], bytes(raw[w["start"] : w["start"] + w["starts"] + length - 1])) for w in wanted.as_py()]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)],
                                             names=["owner", "anchor", "region", "starts", "many", "raw"])
    return work


PART = "owner long, anchor long, region long, starts int, many boolean, raw binary"


def repeated_starts(parts: list[bytes], starts: list[int], length: int, folder: str, owners: list[int] | None = None,
                    many: list[bool] | None = None) -> list[np.ndarray]:
    """For each region the starts, from its own beginning, whose strings also start elsewhere among the regions.

    With ``owners`` only strings of two owners count; a region of ``many`` has two.
    """
    sizes = np.array([len(x) + 1 for x in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    # No byte is 255, so that it parts the regions.
    data = b"\xff".join(parts) + b"\xff"
    own = np.zeros(len(data), bool)
    for b, n in zip(begin.tolist(), starts, strict=True):
        own[b : b + n] = True
    t = np.frombuffer(data, np.uint8) + np.uint8(1)
    order, common = induced.suffix_array(t, 256, length, folder)
    # Suffixes between two starts only lower what these have in common, so a stretch of long common prefixes is one string.
    stretch = np.cumsum(common < length)
    mine = np.flatnonzero(own[order])
    at, stretch = order[mine], stretch[mine]
    if owners is None:
        often = np.bincount(stretch) > 1
    else:
        place = np.searchsorted(begin, at, side="right") - 1
        who, more = np.array(owners)[place], np.array(many)[place]
        edge = np.flatnonzero(np.concatenate(([True], stretch[1:] != stretch[:-1]))) if len(stretch) else np.zeros(0, np.int64)
        often = np.zeros(stretch[-1] + 1 if len(stretch) else 0, bool)
        if len(edge):
            often[stretch[edge]] = (np.minimum.reduceat(who, edge) != np.maximum.reduceat(who, edge)) | np.logical_or.reduceat(more, edge)
    hit = np.zeros(len(t), bool)
    hit[at[often[stretch]]] = True
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begin.tolist(), starts, strict=True)]


def _runs(at: np.ndarray) -> list[dict]:
    """Stretches of consecutive places as (first, number)."""
    if not len(at):
        return []
    edge = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1, [True])))
    return [{"first": int(at[a]), "number": int(b - a)} for a, b in zip(edge[:-1], edge[1:], strict=True)]


RUNS = pa.list_(pa.struct([("first", pa.int32()), ("number", pa.int32())]))


def _shards(length: int, across: bool):
    """Sort each shard; its rows follow each other."""
    def solve(rows: dict[tuple[int, int], tuple]) -> pa.RecordBatch:
        starts, raw, owner, many = zip(*rows.values(), strict=True)
        with tempfile.TemporaryDirectory(prefix="sort-") as folder:  # scratch of this sort alone, gone when it ends
            hits = repeated_starts(raw, starts, length, folder, *((owner, many) if across else ()))
        found = [(k, _runs(h)) for k, h in zip(rows, hits, strict=True) if len(h)]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in found], pa.int64()), pa.array([k[1] for k, _ in found], pa.int64()), pa.array([r for _, r in found], RUNS)],
                                          names=["anchor", "region", "runs"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, {}
        with remembering("substrings", list):
            for batch in batches:
                for s, a, r, *rest in zip(*(batch.column(c).to_pylist() for c in ("shard", "anchor", "region", "starts", "raw", "owner", "many")), strict=True):
                    if s != shard and rows:
                        yield solve(rows)
                        rows = {}
                    shard = s
                    rows[a, r] = rest
            if rows:
                yield solve(rows)
    return work


def _strings(length: int):
    """The strings of regions in groups too large for a shard, as two halves of a hash."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o, a, r, n, m, raw in zip(*(batch.column(c).to_pylist() for c in ("owner", "anchor", "region", "starts", "many", "raw")), strict=True):
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + length]) for i in range(n)), np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, o)), pa.array(np.full(n, a)), pa.array(np.full(n, r)), pa.array(np.full(n, m)), pa.array(np.arange(n, dtype=np.int32)),
                                                  pa.array(d[:, 0]), pa.array(d[:, 1])], names=["owner", "anchor", "region", "many", "place", "h", "g"])
    return work


def _removed(length: int, names: list[str], texts_too: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with remembering("substrings", list):
            for batch in batches:
                for i, j in slices(lengths(batch.column("data"))):
                    part, out = batch.slice(i, j - i), []
                    for text, found in zip(part.column("data"), part.column("found"), strict=True):
                        raw = text.as_buffer() if text.is_valid else b""
                        raw = b"" if raw is None else raw.to_pybytes() if isinstance(raw, pa.Buffer) else raw
                        edge = np.zeros(len(raw) + 1, np.int64)
                        if found.is_valid:
                            first, number = (found.values.field(i).to_numpy() for i in (0, 1))
                            np.add.at(edge, first, 1)
                            np.add.at(edge, first + number + length - 1, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if texts_too else None))
                    rest = [part.column(n) for n in names]
                    made = list(zip(*out, strict=True)) if out else [()] * 5
                    columns = [pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.int64()), pa.array(made[3], pa.string())]
                    if texts_too:
                        columns.append(pa.array(made[4], pa.string()))
                    yield pa.RecordBatch.from_arrays([*rest, *columns], names=[f"c{i}" for i in range(len(rest) + len(columns))])
    return work


def repeats(units: DataFrame, length: int, across: bool = False) -> DataFrame:
    """(key, bytes, found): the starts of ``length`` bytes of each unit that start elsewhere too, as runs (first, number).

    ``units`` has (key, bytes, data) and perhaps more; units of equal key and size are copies. The bytes of ``data`` lie below 254,
    as those of UTF-8 do. With ``across`` only strings
    of two different units count, else also copies and places in one unit.
    """
    seen = units.where(F.col("bytes") >= length).select("key", "data").mapInArrow(
        _occurrences(length, across), "key long, bytes long, anchor long, region long, starts short, start int, more array<int>")
    # Kept by the executors while anchors are counted; lost parts are made again from the texts, with the same content.
    seen = seen.persist(StorageLevel.MEMORY_AND_DISK)
    seen.count()  # filled once, not by several stages at a time
    often = F.min("key") < F.max("key") if across else F.sum(F.when(F.col("more").isNull(), 1).otherwise(2)) > 1
    # An anchor of very many regions is counted by partial sums, and adaptive execution splits it in the joins that hand the counts back.
    anchors = seen.groupBy("anchor").agg(often.alias("again"), (F.min("region") < F.max("region")).alias("mixed")).where("again or mixed")
    near = attach(seen, anchors.select("anchor", "mixed"), ["anchor"])
    many = near.groupBy("anchor", "region").agg(often.alias("many"))
    met = cut(attach(near, many, ["anchor", "region"]).where("many or mixed").select("key", "bytes", "anchor", "region", "starts", "start", "more", "many", "mixed"))
    seen.unpersist()
    wanted = met.where("mixed").groupBy("anchor", "region").agg(F.min(F.struct("key", "bytes", "start", "starts", "many")).alias("w"))
    wanted = wanted.select("w.key", "w.bytes", F.struct("anchor", "region", "w.start", "w.starts", "w.many").alias("w")).groupBy("key", "bytes").agg(F.collect_list("w").alias("wanted"))
    beside = units.join(wanted, ["key", "bytes"]).select("key", "bytes", "data", "wanted")
    parts = cut(beside.mapInArrow(_cut_out(length), PART))
    sizes = parts.groupBy("anchor").agg(F.sum(F.octet_length("raw")).alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // SHARD))
    dealt = parts.join(sizes, "anchor")
    inside = dealt.where(F.col("size") <= GROUP).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).drop("size")
    result = "anchor long, region long, runs array<struct<first: int, number: int>>"
    sorted_ = inside.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_shards(length, across), result)
    large = dealt.where(F.col("size") > GROUP).dropDuplicates(["anchor", "region"]).drop("size")
    one = large.mapInArrow(_strings(length), "owner long, anchor long, region long, many boolean, place int, h long, g long")
    again = (F.min("owner") < F.max("owner")) | F.bool_or("many") if across else F.count("*") > 1
    twice = one.groupBy("h", "g").agg(again.alias("again")).where("again").drop("again")
    counted = one.join(twice, ["h", "g"]).select("anchor", "region", F.array(F.struct(F.col("place").alias("first"), F.lit(1).alias("number"))).alias("runs"))
    runs = cut(sorted_.unionByName(counted))
    places = met.withColumn("place", F.explode(F.concat(F.array("start"), F.coalesce("more", F.array().cast("array<int>")))))
    whole = places.where("many").select("key", "bytes", F.col("place").alias("first"), F.col("starts").cast("int").alias("number"))
    single = places.where("not many").join(runs, ["anchor", "region"]).select("key", "bytes", "place", F.inline("runs")).select(
        "key", "bytes", (F.col("place") + F.col("first")).alias("first"), "number")
    return whole.unionByName(single).distinct().groupBy("key", "bytes").agg(F.collect_list(F.struct("first", "number")).alias("found"))


def remove_repeats(docs: DataFrame, length: int = 200, keep: tuple[str, ...] = ("doc_id",), texts_too: bool = False) -> DataFrame:
    """``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text of every document.

    A character of which a byte was removed leaves ``kept_text`` whole.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    texts = docs.select(*own, text.alias("data"), F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    beside = texts.join(repeats(texts, length), ["key", "bytes"], "left")
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if texts_too else [])]
    kinds = ["long", "long", "long", "string", "string"]
    schema += "".join(f", c{len(keep) + i} {kinds[i]}" for i in range(len(made)))
    return beside.select(*names, "data", "found").mapInArrow(_removed(length, names, texts_too), schema).toDF(*keep, *made)
