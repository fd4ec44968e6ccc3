"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Records of equal payloads are found by digest: ids and digests shrink to one row per digest on the map side, and pages join
those few rows, so no group of copies is ever gathered. Each task writes archives of about ``ARCHIVE`` bytes of payload under names of
its own and returns a row per archive; only archives in that manifest are read, so files of lost attempts don't count. A
dictionary is trained for each archive on its first records (at most ``SAMPLE`` bytes); it changes sizes, never results.

The reader streams an archive: it takes the dictionary from the skippable frame (itself packed or not), decodes frame by frame and
checks every record: version line, required and unique headers, declared against real lengths, the closing line breaks, one
record per frame, and the digest of the payload. What does not fit raises ``WarcError`` with the archive and the offset.

Defined results: NULL html is an empty payload; payloads under ``least`` bytes are never revisits; pages without an id are responses
unless a page with an id has the same payload; rows that repeat the id of a response with its payload are responses too;
an empty table makes no archive and reads as no rows. Other columns of the pages don't travel.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataweft.operators.ordering import attach
from dataweft.session import cut, work_path

#: Bytes of payload in an archive, of training rows for its dictionary, and of the dictionary.
ARCHIVE, SAMPLE, DICTIONARY = 64 << 20, 1 << 20, 32 << 10
# Magic numbers of a dictionary's skippable frame, of a frame and of a dictionary; version line; profile of revisits.
DICT_FRAME, FRAME, DICT_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
URN = "urn:x-page:"
READ, MOST_TASKS = 1 << 20, 20_000

MANIFEST = "archive string, records long, bytes long"
RECORDS = "archive string, offset long, page_id string, uri string, record_type string, payload_bytes long, payload_digest string, refers_to string"


class WarcError(ValueError):
    pass


# -- one record -------------------------------------------------------------------------------------------------------

def _line(value: str) -> str:
    """A header value on one line: control characters and per cent signs become escapes."""
    return "".join(f"%{b:02X}" if b < 32 or b in (37, 127) else chr(b) for b in value.encode()) if not value.isascii() or not value.isprintable() or "%" in value else value


def _plain(value: str) -> str:
    """What ``_line`` was given."""
    if "%" not in value and value.isascii():
        return value
    out, raw, at = bytearray(), value.encode("latin-1"), 0
    while at < len(raw):
        if raw[at] == 37:
            out.append(int(raw[at + 1:at + 3], 16))
            at += 3
        else:
            out.append(raw[at])
            at += 1
    return out.decode()


def record(page_id: str | None, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the response's head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{URN}{_line(page_id or '')}>"), ("WARC-Date", date),
            ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Length", str(len(block)))]
    if uri is not None:
        head.append(("WARC-Target-URI", _line(uri)))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{URN}{_line(refers_to)}>"), ("WARC-Profile", PROFILE)]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("latin-1")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _fields(raw: bytes, what: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        key = name.decode("latin-1").lower()
        if not colon or not name or name != name.strip() or key in out:
            raise WarcError(f"{what}: bad header line {line[:80]!r}")
        out[key] = value.decode("latin-1").strip()
    return out


def _length(value: str | None, what: str) -> int:
    if value is None or not (value.isascii() and value.isdigit()):
        raise WarcError(f"{what}: bad length {value!r}")
    return int(value)


def _page(value: str, what: str) -> str:
    if not (value.startswith(f"<{URN}") and value.endswith(">")):
        raise WarcError(f"{what}: unknown kind of id {value!r}")
    return _plain(value[len(URN) + 1:-1])


@dataclass
class Record:
    """One validated record; ``payload`` is None for a revisit."""

    kind: str
    page_id: str
    uri: str | None
    length: int
    digest: str
    refers_to: str | None
    payload: bytes | None


def parse(raw: bytes, what: str = "record") -> Record:
    """The record of one frame, checked."""
    end = raw.find(b"\r\n\r\n")
    version, _, lines = raw[:max(end, 0)].partition(b"\r\n")
    if end < 0 or version not in (b"WARC/1.0", VERSION):
        raise WarcError(f"{what}: no WARC version line")
    head = _fields(lines, what)
    if missing := [k for k in REQUIRED if k.lower() not in head]:
        raise WarcError(f"{what}: no {', '.join(missing)}")
    size, start = _length(head["content-length"], what), end + 4
    if len(raw) != start + size + 4 or raw[start + size:] != b"\r\n\r\n":
        raise WarcError(f"{what}: the block has {len(raw) - start - 4} bytes, declared are {size}, or its end is missing")
    kind = head["warc-type"]
    if kind not in ("response", "revisit"):
        raise WarcError(f"{what}: unknown type {kind!r}")
    body = raw.find(b"\r\n\r\n", start, start + size)
    status, _, lines = raw[start:max(body, start)].partition(b"\r\n")
    if body < 0 or not status.startswith(b"HTTP/1."):
        raise WarcError(f"{what}: no HTTP head")
    length = _length(_fields(lines, what).get("content-length"), what)
    algorithm, _, digest = head.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha256" or len(digest) != 64:
        raise WarcError(f"{what}: no SHA-256 payload digest")
    payload, refers_to = raw[body + 4:start + size], None
    if kind == "revisit":
        refers_to = _page(head.get("warc-refers-to", ""), what)
        if payload or head.get("warc-profile") != PROFILE:
            raise WarcError(f"{what}: a revisit with a payload or of another profile")
    elif len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
        raise WarcError(f"{what}: the payload differs from its length or digest")
    uri = head.get("warc-target-uri")
    return Record(kind, _page(head["warc-record-id"], what), uri if uri is None else _plain(uri), length, digest, refers_to, payload if kind == "response" else None)


# -- one archive ------------------------------------------------------------------------------------------------------

def trained(samples: list[bytes], size: int = DICTIONARY) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the samples, None where they are too few or too alike to train one."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, level=3)
    except zstandard.ZstdError:
        return None


class Writer:
    """One archive: records wait until the dictionary can be trained, then each becomes a frame."""

    def __init__(self, out, level: int = 3):
        self.out, self.level, self.records, self.raw, self.size = out, level, 0, 0, 0
        self.waiting: list[bytes] | None = []
        self.compressor = None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        waiting, self.waiting = self.waiting, None
        d = trained([x[:DICTIONARY] for x in waiting])
        if d is not None:
            body = zstandard.ZstdCompressor(level=self.level).compress(d.as_bytes())
            self._put(struct.pack("<II", DICT_FRAME, len(body)) + body)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=True)
        for x in waiting:
            self._put(self.compressor.compress(x))

    def add(self, raw: bytes) -> None:
        self.records += 1
        self.raw += len(raw)
        if self.waiting is None:
            self._put(self.compressor.compress(raw))
        else:
            self.waiting.append(raw)
            if self.raw >= SAMPLE:
                self._begin()

    def close(self) -> None:
        if self.waiting is not None:
            self._begin()
        self.out.close()


def _dictionary(body: bytes, what: str) -> zstandard.ZstdCompressionDict:
    if body[:4] == FRAME:
        try:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        except zstandard.ZstdError as e:
            raise WarcError(f"{what}: the dictionary can't be unpacked") from e
    if body[:4] != DICT_MAGIC:
        raise WarcError(f"{what}: the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(body)


def frames(stream, what: str = "archive") -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of every frame of a stream, which is read in pieces."""
    head = stream.read(8)
    d, at, rest = None, 0, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICT_FRAME:
        size = struct.unpack("<I", head[4:])[0]
        body = stream.read(size)
        if len(body) != size:
            raise WarcError(f"{what}: the dictionary is cut short")
        d, at, rest = _dictionary(body, what), 8 + size, b""
    decoder = zstandard.ZstdDecompressor(dict_data=d)
    while True:
        rest = rest or stream.read(READ)
        if not rest:
            return
        frame, parts, used = decoder.decompressobj(), [], 0
        while True:
            try:
                parts.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise WarcError(f"{what}, offset {at}: {e}") from e
            used += len(rest)
            if frame.eof:
                rest = frame.unused_data
                used -= len(rest)
                break
            rest = stream.read(READ)
            if not rest:
                raise WarcError(f"{what}, offset {at}: the frame is cut short")
        yield at, b"".join(parts)
        at += used


def records(stream, what: str = "archive") -> Iterator[tuple[int, Record]]:
    """(offset, record) of every frame, each holding exactly one record."""
    for at, raw in frames(stream, what):
        yield at, parse(raw, f"{what}, offset {at}")


# -- on Spark ---------------------------------------------------------------------------------------------------------

def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path: a plain path is a shared folder, a URI says itself."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def classed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """(id, uri, payload, digest, refers_to): ``refers_to`` is the smallest id of the pages of an equal payload, where that is another page."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("head"), F.count("*").alias("n"))
    # A short payload gets a key of its own: the many empty pages must not meet in one task.
    alone = F.concat(F.lit("-"), F.xxhash64("id", "uri").cast("string"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.col("digest")).otherwise(alone))
    heads = long.where((F.col("n") > 1) & F.col("head").isNotNull()).select(F.col("digest").alias("key"), "head")
    met = attach(rows, heads, ["key"], "left")
    other: Column = F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))
    return met.select("id", "uri", "payload", "digest", F.when(other, F.col("head")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100,
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The manifest (archive, records, bytes) of the archives written into ``path``, a folder that all executors reach."""
    rows = classed(pages, page_id, url, html, least)
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("id", "uri", "refers_to")})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _file_system(path)
        store.create_dir(folder, recursive=True)
        made: list[tuple[str, int, int]] = []
        name, writer = "", None

        def done() -> None:
            writer.close()
            made.append((name, writer.records, writer.size))

        for batch in batches:
            columns = [batch.column(c) for c in ("id", "uri", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = Writer(store.open_output_stream(f"{folder}/{name}", compression=None))
                writer.add(record(*[c[i].as_py() for c in columns], date))
                if writer.raw >= ARCHIVE:
                    done()
                    writer = None
        if writer is not None:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return cut(rows.mapInArrow(work, MANIFEST))


def read_archives(manifest: DataFrame, path: str, payloads: bool = False) -> DataFrame:
    """A row per record of the archives (column ``archive``) in ``path``; with ``payloads`` also (payload binary), NULL for revisits.

    Archives are dealt over tasks by name; a task holds one record at a time.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _file_system(path)
        names = [*RECORDS_NAMES, *(["payload"] if payloads else [])]
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows: list[tuple] = []
                held = 0
                with store.open_input_stream(f"{folder}/{archive}", compression=None) as stream:
                    for at, r in records(stream, archive):
                        rows.append((archive, at, r.page_id, r.uri, r.kind, r.length, r.digest, r.refers_to, *([r.payload] if payloads else [])))
                        held += 1000 + (len(r.payload or b"") if payloads else 0)
                        if held >= 8 << 20:
                            yield _batch(rows, names)
                            rows, held = [], 0
                yield _batch(rows, names)

    n = min(MOST_TASKS, max(1, manifest.count()))  # a stated number: few rows stand for much work, so they mustn't be put together
    return manifest.select("archive").repartition(n, "archive").mapInArrow(work, RECORDS + (", payload binary" if payloads else ""))


RECORDS_NAMES = [c.split()[0] for c in RECORDS.split(", ")]
TYPES = {"string": pa.string(), "long": pa.int64()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [*(TYPES[c.split()[1]] for c in RECORDS.split(", ")), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records as read back from archives in the shared folder."""
    path = work_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, path, page_id, url, html, least)
    read = read_archives(manifest, path)
    kind = pages.schema[page_id].dataType
    own = F.when(F.col("page_id") != "", F.col("page_id")).cast(kind)
    return read.select(own.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
