"""Operator 11: round trips, archives of others, and what a reader refuses."""

import glob
import gzip
import hashlib
import io
import random
import re

import pyarrow as pa
import pytest
from tests.llm.helpers import prose

from tesserae.llm import common, warc

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({n: F.lit("x") for n in ("n", "first", "copies", "payload", "record_id", "data", "chunk_no", "_", "last", "path")})


def table(seed=1):
    rng = random.Random(seed)
    copy, short = "<p>" + prose(rng, 40) + "é</p>", "<p>short</p>"
    rows = [(i, f"http://e.org/{i}", f"<p>{prose(rng, rng.randint(0, 300))}</p>\r\n\r\nWARC/1.1\r\n") for i in range(30)]
    rows += [(i, f"http://e.org/{i}", copy) for i in range(99, 59, -1)] + [(i, None, short) for i in range(200, 205)]
    return rows + [(300, "bad\r\nurl x", None), (301, "u", ""), (302, "u", "x" * 99), (303, "u", "x" * 99), (304, "u", "é" * 50), (305, "u", "é" * 50), (306, "u", "big " * 60_000)]


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "") == (html or ""))
        again = len(data) >= 100 and first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("hot", [3, 1000])
def test_query(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    pages(spark, table()).repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op11_web_archive(spark, str(tmp_path))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute(table())


def test_round_trip_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 2000)
    rows = table(2)
    index = warc.archive(pages(spark, rows).repartition(2), common.new_folder(spark, "warc"))
    places = index.collect()
    assert sorted(r["record_id"] for r in places) == sorted(f"urn:x-page:{i}" for i, _, _ in rows) and len({r["path"] for r in places}) > 3
    chunks = warc.read(index.select("path").distinct(), size=1000).where("record_type = 'response'").collect()
    payload = {}
    for r in sorted(chunks, key=lambda r: (r["record_id"], r["chunk_no"])):
        assert len(r["data"]) <= 1000
        payload[r["record_id"]] = payload.get(r["record_id"], b"") + r["data"]
        assert r["payload_bytes"] == len(payload[r["record_id"]]) and r["payload_digest"] == hashlib.sha256(payload[r["record_id"]]).hexdigest()
        assert r["last"] == (r["payload_bytes"] == len((dict((f"urn:x-page:{i}", h) for i, _, h in rows)[r["record_id"]] or "").encode()))
    assert payload == {f"urn:x-page:{i}": (h or "").encode() for (i, _, h), (_, _, _, kind, _) in zip(sorted(rows), brute(rows), strict=True) if kind == "response"}
    for r in places[:5]:  # a record stands alone at its offset
        with open(r["path"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            one = gzip.decompress(f.read(r["size"]))
        assert one.startswith(b"WARC/1.1\r\n") and f"<{r['record_id']}>".encode() in one and one.endswith(b"\r\n\r\n")


def test_odd_rows(spark):
    html = "y" * 200
    rows = [(None, None, html), (5, "a", html), (5, "a", html), (5, "b", html), (7, None, html), (None, None, None)]
    index = warc.archive(pages(spark, rows), common.new_folder(spark, "warc"))
    got = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"]) for r in warc.read(index.select("path").distinct(), payloads=False).collect())
    five = "urn:x-page:5"
    assert got == sorted([("urn:x-page:", "response", "", 0), ("urn:x-page:", "revisit", five, 200), (five, "response", "", 200), (five, "revisit", five, 200), (five, "revisit", five, 200), ("urn:x-page:7", "revisit", five, 200)])
    empty = warc.archive(pages(spark, []), common.new_folder(spark, "warc"))
    assert empty.count() == 0 and warc.read(empty.select("path")).count() == 0


OTHERS = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 4\r\n\r\na\nb\n\r\n\r\nWARC/1.0\nwarc-type: resource\nWARC-Record-ID: <urn:uuid:2>\nX: long\n  line\nContent-Length: 3\n\n\xff\x00z\n\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:3>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n"


def test_archives_of_others():
    for data in (OTHERS, gzip.compress(OTHERS), b"".join(gzip.compress(b"WARC" + p) for p in re.split(b"WARC(?=/)", OTHERS)[1:])):
        got = list(warc.records(io.BytesIO(data), "p", 4))
        assert [(r[1], r[2], r[3], r[6], r[7], r[10]) for r in got] == [(0, "urn:uuid:1", "warcinfo", 0, b"a\nb\n", True), (1, "urn:uuid:2", "resource", 0, b"\xff\x00z", True), (2, "urn:uuid:3", "response", 0, b"hell", False), (2, "urn:uuid:3", "response", 1, b"o", True)]
        assert got[-1][8] == 5 and got[-1][9] == hashlib.sha256(b"hello").hexdigest()
    assert list(warc.records(io.BytesIO(b""), "p")) == []


def test_what_a_reader_refuses():
    stated = OTHERS.replace(b"WARC-Record-ID: <urn:uuid:3>", b"WARC-Payload-Digest: sha256:" + hashlib.sha256(b"hello").hexdigest().encode())
    assert len(list(warc.records(io.BytesIO(stated), "p"))) == 3
    for data, error in ((stated.replace(b"hello", b"hullo"), ValueError), (OTHERS[:-8], EOFError), (gzip.compress(OTHERS)[:-30], EOFError), (OTHERS[:120], EOFError), (b"x" + OTHERS, ValueError)):
        with pytest.raises(error):
            list(warc.records(io.BytesIO(data), "p"))


def test_a_writer_refuses_wrong_chunks(tmp_path):
    row = {"record_id": "r", "record_type": "response", "target_uri": None, "refers_to": None, "payload_bytes": 2, "payload_digest": hashlib.sha256(b"ab").hexdigest()}
    for chunks in ([(0, b"a"), (0, b"b")], [(0, b"a"), (2, b"b")], [(1, b"ab")], [(0, b"ax")], [(0, b"a")]):
        with pytest.raises(ValueError):
            archives = warc._Archives(str(tmp_path), warc.DATE)
            for n, data in chunks:
                archives.chunk({**row, "chunk_no": n}, data)
            archives.close()
    archives = warc._Archives(str(tmp_path / "good"), warc.DATE)
    archives.chunk({**row, "chunk_no": 0}, b"a")
    archives.chunk({**row, "chunk_no": 1}, b"b")
    archives.close()
    assert archives.indexed().num_rows == 1 and len(glob.glob(f"{tmp_path}/good/*")) == 1


def test_memory_depends_on_the_chunk(tmp_path):
    """A payload of 200 MB goes in and out with less than 20 MB of Python's memory."""
    import tracemalloc

    digest = hashlib.sha256()
    for k in range(200):
        digest.update(bytes([k]) * (1 << 20))
    row = {"record_id": "r", "record_type": "response", "target_uri": None, "refers_to": None, "payload_bytes": 200 << 20, "payload_digest": digest.hexdigest()}
    tracemalloc.start()
    archives = warc._Archives(str(tmp_path), warc.DATE)
    for k in range(200):
        archives.chunk({**row, "chunk_no": k}, bytes([k]) * (1 << 20))
    archives.close()
    with pa.OSFile(glob.glob(f"{tmp_path}/*")[0]) as raw:
        last = None
        for last in warc.records(raw, "p"):  # noqa: B007
            pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert last[8:] == (200 << 20, digest.hexdigest(), True) and last[6] == 199 and peak < 20 << 20
