"""Archives: round trip, one frame per record, validation."""

import hashlib
import io
import os
import struct

import pytest
import zstandard

from dataweft.llm import warc

SCHEMA = "page_id bigint, url string, html string, payload string, key string, head int, digest string, offset string"
LONG = "<p>ünï " + "word " * 40
ROWS = [(1, "http://a/%7Eü x\r\n", LONG), (2, None, LONG), (2, "http://b", LONG), (3, "u", LONG + "!"), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""),
        (None, "u", LONG), (None, None, "other " * 30), (None, None, "other " * 30), (9, "u", "z" * 300_000), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (1, "again", LONG), (None, None, None)]
ROWS = [(*r, "c", "d", 1, "e", "f") for r in ROWS]


def want(rows):
    out = []
    for i, _, html, *_ in rows:
        body = (html or "").encode()
        ids = [j for j, _, h, *_ in rows if (h or "") == (html or "") and j is not None]
        other = len(body) >= 100 and ids and i != min(ids)
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if other else "response", min(ids) if other else None))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 4000)
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in warc.round_trip(frame).collect()), key=str) == want(ROWS)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_archives_on_disk(spark, tmp_path):
    many = [(i, f"http://h/{i}", f"<html><body><h1>{i}</h1>" + f"<p>item {i % 7} of the list</p>" * 60, "c", "d", 1, "e", "f") for i in range(900)]
    frame = spark.createDataFrame(ROWS + many, SCHEMA).repartition(2)
    manifest = warc.write_archives(frame, str(tmp_path / "w"))
    open(tmp_path / "w" / "lost.warc.zst", "wb").write(b"left by a lost attempt")
    names = {r.archive for r in manifest.collect()}
    assert sum(r.records for r in manifest.collect()) == len(ROWS) + 900
    assert all(os.path.getsize(tmp_path / "w" / r.archive) == r.bytes for r in manifest.collect())
    rows = warc.read_archives(manifest, str(tmp_path / "w"), payloads=True).collect()
    assert {r.archive for r in rows} == names and len(rows) == len(ROWS) + 900
    by_uri = {r.uri: r for r in rows if r.record_type == "response"}
    assert by_uri["http://a/%7Eü x\r\n"].payload.decode() == LONG and by_uri["http://h/5"].payload.decode() == many[5][2]
    heads = [open(tmp_path / "w" / n, "rb").read(8) for n in names]
    assert any(struct.unpack("<I", h[:4])[0] == warc.DICT_FRAME for h in heads)  # enough rows to train on
    for r in rows[:20]:  # every record starts a frame of its own
        raw = open(tmp_path / "w" / r.archive, "rb").read()
        assert raw[r.offset:r.offset + 4] == warc.FRAME


def archive(parts, dictionary=None, packed=True):
    body = b""
    if dictionary is not None:
        d = zstandard.ZstdCompressor().compress(dictionary.as_bytes()) if packed else dictionary.as_bytes()
        body = struct.pack("<II", warc.DICT_FRAME, len(d)) + d
    c = zstandard.ZstdCompressor(dict_data=dictionary) if dictionary is not None else zstandard.ZstdCompressor()
    return body + b"".join(c.compress(p) for p in parts)


def one(payload=b"abc", **change):
    raw = warc.record("7", "http://x", payload, hashlib.sha256(payload).hexdigest(), change.pop("refers_to", None), "2020-01-01T00:00:00Z")
    for a, b in change.items():
        raw = raw.replace(*b) if a else raw
    return raw


def read(data):
    return list(warc.records(io.BytesIO(data)))


@pytest.mark.parametrize("packed", [True, False])
def test_dictionary_of_either_form(packed):
    texts = [b"%d some text that is shared by all %d" % (i, i * 7) + b"x" * (i % 50) for i in range(2000)]
    d = warc.trained(texts)
    assert d is not None
    found = read(archive([one(t) for t in texts[:50]], d, packed))
    assert [r.payload for _, r in found] == texts[:50]


def test_pieces_of_any_size(monkeypatch):
    data = archive([one(b"a" * k) for k in (0, 1, 5000, 3)])
    for size in (1, 3, 1000):
        monkeypatch.setattr(warc, "READ", size)
        assert [r.length for _, r in read(data)] == [0, 1, 5000, 3]


@pytest.mark.parametrize("bad", [
    one(x=(b"WARC/1.1", b"WARC/9.9")), one(x=(b"Content-Length: 3\r\n\r\nabc", b"Content-Length: 4\r\n\r\nabc")), one()[:-1], one() + b"x", one() + one(), one(x=(b"abc\r\n", b"abd\r\n")),
    one(x=(b"WARC-Date: 2020-01-01T00:00:00Z\r\n", b"")), one(x=(b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: response")), one(x=(b"response\r\n", b"metadata\r\n")),
    one(x=(b"WARC-Date:", b"WARC-Date")), one(refers_to="3", x=(b"revisit/identical", b"revisit/other")), one(x=(b"sha256:", b"md5:")), b""])
def test_bad_records_are_named(bad):
    good = one(b"fine")
    with pytest.raises(warc.WarcError, match="offset"):
        read(archive([good, bad]))


def test_bad_archives():
    data = archive([one(), one(b"more")])
    for cut in (data[:-1], data + b"\x00", data[:5] + b"\xff" + data[6:]):
        with pytest.raises(warc.WarcError):
            read(cut)
    with pytest.raises(warc.WarcError, match="dictionary"):
        read(struct.pack("<II", warc.DICT_FRAME, 100) + b"short")
    with pytest.raises(warc.WarcError, match="no dictionary"):
        read(struct.pack("<II", warc.DICT_FRAME, 4) + b"none" + data)
    assert read(b"") == []
