"""Join of documents whose shingle sets have a Jaccard similarity of at least a threshold, by parity sketches.

Sets of equal content are one class. Classes stand in size bands; a pair whose larger set lies in a band differs in at most
d = 2 * hi * (1 - t) / (1 + t) shingles, hi being the band's largest size. Every shingle falls by its hash into one of m > d
pieces of the band, where it is XORed into the piece's word and flips one bit of the piece's sketch. A pair within d leaves a
piece untouched, so its words agree there: classes that share a word of a piece meet. A set is indexed in its own band, and in the
next one if a partner can lie there.

Words of less than two shingles say little. A set with more stronger ones than its largest possible difference leaves one of
them untouched in any pair, so it shows only those; other sets show all. Where one of the two sets is of the first kind, the
pair meets in a strong word, else in any: nothing is lost. There are some pieces more than d + 1, so that most sets are.

In a first step each class meets one hub of its words; links that hold join components. Of the members of a word that are
still in different components, few are paired; many meet in blocks by size and bound. From these go out the classes whose sketch is close to that
of another component; their sets meet again, and only links that join components come out, so that near copies don't become all their pairs.
Shingles that no other class of a crowded word holds are in no intersection, which bounds the size of a class's partners; classes and
blocks beyond these bounds never meet, so texts of one template that differ enough cost nothing. The
Hamming distance of two sketches is a lower bound of the symmetric difference; pairs that it lets through have their sets compared.

Defined results: texts without words and NULL texts have an empty set, no links and themselves as component; texts of fewer
words than a shingle have one shingle, all their words; rows without an id count as members of their class but never name a
component (NULL if no row of it has an id); repeated rows are copies; an empty table gives an empty result. Shingles are
told apart by 64-bit hashes, sets by 128-bit ones. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataweft.llm.common import lengths, remembering, slices
from dataweft.operators.graph import connected_components
from dataweft.session import cut, setting, shuffles_go

#: Ratio of a band's sizes, pieces per allowed difference to choose from, shingles that make a word strong, steps that test one hub per class.
RATIO, SPARE, STRONG, HUB_STEPS = 1.45, (1.05, 1.2, 1.4), 2, 1
#: Classes in a block of a word's group, in a group whose pairs are listed, and the ratio of sizes in a block.
BLOCK, FEW, STEP = 1024, 48, 1.08
#: Bytes of the sets of a block's classes, about.
BLOCK_BYTES = 16 << 20
MEMO = 300_000
#: Classes (a hundred bytes each) that are sent to all tasks.
SENT = 200_000
#: Bits of a sketch for each piece, rows that a task gets at once.
BITS = 16
ROWS = 1000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; A-Z are lower-cased, words end at ASCII white space."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, w), np.uint64, len(w))
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(w[:words]), np.uint64)
    for i in range(min(words, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


class Bands:
    """Size bands and pieces for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.hi = [1]

    def difference(self, total: int) -> int:
        """Largest symmetric difference of a linked pair whose sizes add up to ``total``."""
        return total * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> int:
        while self.hi[-1] < n:
            self.hi.append(max(self.hi[-1] + 1, int(self.hi[-1] * max(RATIO, 100 / self.percent))))
        return int(np.searchsorted(self.hi, n))

    def places(self, n: int) -> list[int]:
        """The bands in which a set of n shingles is indexed."""
        own = self.of(n)
        return [own, own + 1] if self.of(n * 100 // self.percent) > own else [own]

    def pieces(self, band: int) -> tuple[int, int]:
        """(d, m) of a band."""
        self.of(int(self.hi[-1]) + 1 if band >= len(self.hi) else 1)
        d = self.difference(2 * self.hi[band])
        for spare in SPARE:  # the first that leaves most sets more strong words than a pair may touch
            m = int(np.ceil(spare * (d + 1)))
            each = (100 + self.percent) / (200 - 2 * self.percent) / spare
            if spare * (1 - np.exp(-each) * (1 + each)) >= 1.04:
                break
        return d, m

    def words(self, s: np.ndarray, band: int) -> np.ndarray:
        """Keys of the words that a set shows in a band; none where only equal sets can be linked."""
        d, m = self.pieces(band)
        if d == 0:
            return np.zeros(0, np.int64)
        piece = (s % np.uint64(m)).astype(np.int64)
        order = np.argsort(piece, kind="stable")
        count = np.bincount(piece, minlength=m)
        word = np.zeros(m, np.uint64)
        full = count > 0
        word[full] = np.bitwise_xor.reduceat(mixed(s[order]), (np.cumsum(count) - count)[full])
        key = mixed(word + np.uint64(band * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + np.arange(m, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + count.astype(np.uint64))
        strong = count >= STRONG
        touched = self.difference(len(s) + len(s) * 100 // self.percent)  # at most, whatever the partner
        return (key[strong] if strong.sum() > touched else key).view(np.int64)

    def sketch(self, s: np.ndarray, band: int) -> bytes:
        """Parity of ``BITS`` bits for every piece of a band, so many times the largest difference that matters."""
        m = self.pieces(band)[1]
        bit = (s % np.uint64(m)).astype(np.int64) * BITS + ((s >> np.uint64(48)) & np.uint64(BITS - 1)).astype(np.int64)
        return np.packbits((np.bincount(bit, minlength=m * BITS) & 1).astype(np.uint8)).tobytes()


def _sets(words: int, percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen, none = Bands(percent), set(), np.zeros(0, np.int64)
        with remembering("parity_join", WORDS.clear):
            for batch in batches:
                for a, b in slices(lengths(batch.column("text"))):
                    part = batch.slice(a, b - a)
                    size, name, keys = [], [], []
                    for t in part.column("text"):
                        s = shingles(t.as_py(), words)
                        size.append(len(s))
                        name.append(xxhash.xxh3_128_digest(s.tobytes()))
                        new = len(s) and name[-1] not in seen  # a task shows the words of a set once
                        seen.add(name[-1])
                        keys.append(np.concatenate([bands.words(s, x) for x in bands.places(len(s))]) if new else none)
                    flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
                    offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pa.array(size, pa.int64()), pa.array(name, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                                                     names=["doc_id", "hash", "n", "name", "keys"])
    return work


def _details(words: int, percent: int):
    """(node, n, set, bands, sketches) of the texts that are those of their class, whatever else bears the id."""
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        with remembering("parity_join", WORDS.clear):
            for batch in batches:
                for a, b in slices(lengths(batch.column("text"))):
                    part, rows = batch.slice(a, b - a), []
                    for t, node, name, n in zip(part.column("text"), *(part.column(c).to_pylist() for c in ("node", "set", "n")), strict=True):
                        raw = (s := shingles(t.as_py(), words)).tobytes()
                        if xxhash.xxh3_128_digest(raw) == name:
                            at = bands.places(max(1, n))[0]
                            rows.append((node, n, raw, at, bands.sketch(s, at), bands.sketch(s, at + 1)))
                    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["node", "n", "members", "band", "sketch", "next_sketch"])
    return work


def _near(percent: int):
    """Keep the pairs whose sketches differ in no more bits than a linked pair's sets may differ."""
    bits = np.array([bin(i).count("1") for i in range(256)], np.uint8)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            keep = []
            for r in batch.select(["a_n", "b_n", "a_band", "b_band", "a_sketch", "b_sketch", "a_next_sketch", "b_next_sketch"]).to_pylist():
                x = r["a_sketch"] if r["a_band"] >= r["b_band"] else r["a_next_sketch"]
                y = r["b_sketch"] if r["b_band"] >= r["a_band"] else r["b_next_sketch"]
                apart = len(x) != len(y) or int(bits[np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)].sum())
                keep.append(abs(r["a_band"] - r["b_band"]) <= 1 and apart is not True and apart <= bands.difference(r["a_n"] + r["b_n"]))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return work


def _by_band(rows: list[dict], columns: tuple[str, ...]) -> dict[int, dict[str, np.ndarray]]:
    """By band: what the rows have of it, sorted by nothing in particular; ``at`` is the place among the rows."""
    out = {}
    for band in {r["band"] for r in rows}:
        own = [(i, r) for i, r in enumerate(rows) if r["band"] == band]
        out[band] = {c: np.array([r[c] for _, r in own]) for c in columns} | {"at": np.array([i for i, _ in own])} | {
            c: np.array([np.frombuffer(r[c], np.uint16) for _, r in own]) for c in ("sketch", "next_sketch")}
    return out


def _sketch_pairs(left: dict, right: dict, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place on the left, place on the right, differing bits) of the pairs that are in different components, may be linked by their
    sizes and have sketches that are close enough."""
    for x, u in left.items():
        for y in {x - 1, x, x + 1} & right.keys():
            v = right[y]
            s, t = u["sketch" if x >= y else "next_sketch"], v["sketch" if y >= x else "next_sketch"]
            for i in range(0, len(s), 32):
                total = u["n"][i : i + 32, None] + v["n"][None, :]
                fits = (u["most"][i : i + 32, None] >= v["n"][None, :]) & (v["most"][None, :] >= u["n"][i : i + 32, None])
                p, q = np.nonzero(fits & (u["part"][i : i + 32, None] != v["part"][None, :]))
                apart = np.concatenate([np.bitwise_count(s[i + p[k : k + 4096]] ^ t[q[k : k + 4096]]).sum(1, dtype=np.int64) for k in range(0, len(p), 4096)] or [np.zeros(0, np.int64)])
                keep = apart <= total[p, q] * (100 - percent) // (100 + percent)
                yield u["at"][i + p[keep]], v["at"][q[keep]], apart[keep]


def _close(percent: int):
    """(meeting, node, part, most): of two blocks the classes that have a close one in another component; never the pairs, whose number is a square."""
    columns = ("part", "n", "most")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a_rows"), batch.column("b_rows"), strict=True):
                a, b = a.as_py(), b.as_py()
                hit = np.zeros(len(a), bool), np.zeros(len(b), bool)
                for p, q, _ in _sketch_pairs(_by_band(a, columns), _by_band(b, columns), percent):
                    hit[0][p], hit[1][q] = True, True
                rows = {r["node"]: r for block, h in zip((a, b), hit, strict=True) for r, x in zip(block, h, strict=True) if x}
                nodes = [*sorted(r["node"] for r in a), -1, *sorted(r["node"] for r in b)]
                meeting = xxhash.xxh3_64_intdigest(np.array(nodes, np.int64).tobytes()) >> 1  # equal ones would only be compared together
                yield pa.RecordBatch.from_arrays([pa.array([meeting] * len(rows), pa.int64()), *(pa.array([r[c] for r in rows.values()], pa.int64()) for c in ("node", "part", "most"))],
                                                 names=["meeting", "node", "part", "most"])
    return work


def _joined(percent: int):
    """Linked pairs (a, b) of a meeting that join all its components that links join: closest first, none whose ends are joined already."""
    def work(met: pa.Table) -> pa.Table:
        rows = met.select(["node", "part", "n", "most", "band", "sketch", "next_sketch"]).to_pylist()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in met.column("members")]
        banded = _by_band(rows, ("part", "n", "most"))
        found = [(p[p < q], q[p < q], d[p < q]) for p, q, d in _sketch_pairs(banded, banded, percent)]
        p, q, apart = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
        order = np.argsort(apart, kind="stable")
        part = np.unique([r["part"] for r in rows], return_inverse=True)[1]
        links = []
        for k in range(0, len(order), 4096):
            at = order[k : k + 4096]
            at = at[part[p[at]] != part[q[at]]]
            for i, j in zip(p[at].tolist(), q[at].tolist(), strict=True):
                if part[i] != part[j]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        part[part == part[j]] = part[i]
                        links.append(sorted((rows[i]["node"], rows[j]["node"])))
        return pa.table({c: pa.array([x[k] for x in links], pa.int64()) for k, c in enumerate("ab")})
    return work


def block_links(blocks: DataFrame, details: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the classes of ``block_pairs``, in a number that grows with the classes. The sets of those that have a close one travel to where these meet."""
    met = blocks.mapInArrow(_close(percent), "meeting long, node long, part long, most long").distinct()
    return met.join(details, "node").groupBy("meeting").applyInArrow(_joined(percent), "a long, b long").distinct()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingle): 32 bits of each shingle of a class; classes that seem to share one have at worst a looser bound."""
    for batch in batches:
        for node, raw in zip(batch.column("node").to_pylist(), batch.column("members"), strict=True):
            s = np.unique((np.frombuffer(raw.as_py(), np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node), pa.int64()), pa.array(s)], names=["node", "shingle"])


def reach(crowded: DataFrame, details: DataFrame, percent: int) -> DataFrame:
    """(node, n, most): the largest set that each class can be linked with among the ``crowded`` ones; classes that can be linked with none are left out."""
    held = details.join(crowded.select("node").distinct(), "node", "left_semi")
    each = held.select("node", "members").mapInArrow(_members, "node long, shingle int")
    alone = each.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last").groupBy("node").agg(F.count("*").alias("alone"))
    shared = F.col("n") - F.coalesce("alone", F.lit(0))
    most = F.floor(shared * (100 + percent) / percent) - F.col("n")
    return held.select("node", "n").join(alone, "node", "left").select("node", "n", most.alias("most")).where(F.col("most") * 100 >= F.col("n") * percent)


def block_pairs(many: DataFrame, details: DataFrame, percent: int) -> DataFrame:
    """(a_rows, b_rows): blocks of classes that share a word (``word``, ``node``, ``part``) and of which two may be linked by their sizes."""
    rows = many.select("word", "node", "part").join(cut(reach(many, details, percent)), "node").withColumns({c: F.floor(F.log(x) / np.log(STEP)) for c, x in (("step", "n"), ("top", "most"))})
    sizes = rows.groupBy("word", "step", "top").agg(F.count("*").alias("size"))
    each = F.pow(F.lit(STEP), F.col("step") + 1) * (8 / BLOCK_BYTES)  # the share of a block that a set of the step takes
    rows = rows.join(sizes, ["word", "step", "top"]).withColumn("place", F.struct("step", "top", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") * F.greatest(F.lit(1 / BLOCK), each)).cast("long")).alias("block")))
    rows = rows.join(details.select("node", "band", "sketch", "next_sketch"), "node")
    blocks = rows.groupBy("word", "place").agg(F.min("n").alias("least"), F.max("most").alias("most"),
                                               F.collect_list(F.struct("node", "part", "n", "most", "band", "sketch", "next_sketch")).alias("a_rows"))
    other = blocks.select("word", F.col("place").alias("b_place"), F.col("least").alias("b_least"), F.col("most").alias("b_most"), F.col("a_rows").alias("b_rows"))
    return blocks.join(other, "word").where("place <= b_place and least <= b_most and b_least <= most").select("a_rows", "b_rows")


def _linked(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_members"), batch.column("b_members"), strict=True):
                u, v = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return work


def _with(pairs: DataFrame, details: DataFrame, columns: list[str]) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(details.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return pairs


def verified(pairs: DataFrame, details: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""
    near = _with(pairs, details, ["n", "band", "sketch", "next_sketch"]).mapInArrow(_near(percent), "a long, b long")
    return _with(near, details, ["members"]).mapInArrow(_linked(percent), "a long, b long")


def classes_and_links(docs: DataFrame, words: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows`` (doc_id, n, name), ``classes`` (node, name, n, least doc_id) and ``links`` (a, b) that connect the classes
    of every component; a link between two classes that others connect already may be missing."""
    spark = docs.sparkSession
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS)), shuffles_go(spark):  # a batch of texts stays small on both sides
        return _classes_and_links(docs, words, percent)


def _classes_and_links(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    # Kept by the executors while the join runs; lost parts are made again from the texts, with the same content.
    kept = texts.mapInArrow(_sets(words, percent), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, hash long, n long, name binary, keys array<long>")
    kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
    rows = cut(kept.drop("keys"))
    sets = rows.where("n > 0").groupBy("name").agg(F.first("n").alias("n"), F.min(F.struct("doc_id", "hash")).alias("row"), F.min("doc_id").alias("least"))
    classes = cut(sets.withColumn("node", F.monotonically_increasing_id()))  # numbers stay as they are written
    one = kept.where(F.size("keys") > 0).join(classes.select("name", "node"), "name")  # a task has words of a class once
    shown = one.select("node", F.explode("keys").alias("word"))
    by_word = F.expr("min(node) OVER (PARTITION BY word)"), F.expr("max(node) OVER (PARTITION BY word)")
    groups = cut(shown.select("word", "node", by_word[0].alias("hub"), by_word[1].alias("last")).where("hub < last").drop("hub", "last"))
    kept.unpersist()
    shared = cut(groups.select("node").distinct())
    wanted = classes.join(shared, "node").select("node", F.col("name").alias("set"), "n", F.col("row.doc_id").alias("id"), F.col("row.hash").alias("row_hash"))
    # One row of each class that meets another: its text is read again, not carried along, and stays where it is while the classes are few.
    wanted = F.broadcast(wanted) if shared.count() <= SENT else wanted
    again = texts.join(wanted, (F.col("hash") == F.col("row_hash")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "node", "set", "n")
    details = again.mapInArrow(_details(words, percent), "node long, n long, members binary, band int, sketch binary, next_sketch binary")
    details = cut(details)
    if not details.groupBy("node").count().where("count > 1").isEmpty():  # repeated rows: the same text with the same id
        details = cut(details.dropDuplicates(["node"]))
    links = tested = None
    parts = shared.withColumn("part", F.col("node"))
    for _ in range(HUB_STEPS):
        # The class of the least component in a word's group is the hub of the others; each class asks the hub it meets most.
        placed = groups.select("word", "node").join(parts, "node")
        hubs = placed.groupBy("word").agg(F.min(F.struct("part", "node")).alias("hub"), F.max("part").alias("last")).where("hub.part < last")
        asks = placed.join(hubs.select("word", "hub"), "word").where("part <> hub.part").groupBy("node", F.col("hub.node").alias("hub")).count()
        if tested is not None:
            asks = asks.join(tested.select(F.col("a").alias("hub"), F.col("b").alias("node")).unionByName(tested.select(F.col("b").alias("hub"), F.col("a").alias("node"))), ["node", "hub"], "left_anti")
        best = asks.groupBy("node").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub"))
        pairs = cut(best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = cut(verified(pairs, details, percent))
        links = found if links is None else links.unionByName(found)
        parts = cut(_parts(links, shared))
    placed = groups.select("word", "node").join(parts, "node")
    mixed_words = placed.groupBy("word").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("word")
    rest = placed.join(mixed_words, "word")
    rest = cut(rest.join(rest.groupBy("word").agg(F.count("*").alias("size")), "word"))
    few, many = rest.where(F.col("size") <= FEW), rest.where(F.col("size") > FEW)
    close = cut(block_links(block_pairs(many, details, percent), details, percent))
    if not close.isEmpty():  # pairs are listed only where blocks have not joined them
        few = few.drop("part").join(cut(_parts(links.unionByName(close), shared)), "node")
    other = few.select("word", F.col("node").alias("b"), F.col("part").alias("b_part"))
    listed = few.join(other, "word").where("node < b and part <> b_part").select(F.col("node").alias("a"), "b")
    cross = listed.distinct().join(tested, ["a", "b"], "left_anti")
    return rows, classes.select("node", "name", "n", "least"), cut(links.unionByName(close).unionByName(verified(cross, details, percent)))


def _parts(links: DataFrame, nodes: DataFrame) -> DataFrame:
    found = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("component", "part")
    return nodes.join(found, "node", "left").select("node", F.coalesce("part", "node").alias("part"))


def components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document with the least id its links reach."""
    rows, classes, links = classes_and_links(docs, words, percent)
    with shuffles_go(docs.sparkSession):
        linked = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = classes.join(linked, "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "part").select(F.col("name").alias("set"), "component_id")
    out = rows.join(named, (rows["name"] == named["set"]) & (rows["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
