"""WARC archives by way of a table of chunks.

A payload travels as rows (record, chunk number, bytes) of bounded size. The writer streams them into archives, one gzip member for
each record, and carries a running SHA-256 along; the reader streams archives back into such rows, each with the number of bytes and
the digest up to its end, so that the last chunk of a record knows both of the full payload. Neither ever holds a whole record.

Writers are tasks: each writes archives under names of its own, and only those of tasks that succeeded are listed in the returned
index, so what a lost or repeated task leaves behind is never read. Archives lie in the shared folder, by pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common

#: Bytes of a chunk, of an archive before the next one begins, of the rows that a reader hands over at once, and of a header at most.
CHUNK, ARCHIVE, HANDOVER, HEADER = 1 << 20, 1 << 30, 8 << 20, 1 << 20
#: Payloads of fewer bytes are never revisited.
LEAST = 100
#: Groups of copies of more rows than this are joined apart; at most N / MOST_HOT for N rows, so that there are at most MOST_HOT.
HOT, MOST_HOT = 1000, 10_000
DATE = "2000-01-01T00:00:00Z"

CHUNKS = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, chunk_no long, data binary"
INDEX = "path string, offset long, size long, record_id string"
_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("record_id", pa.string())])
ROWS = "path string, record_no long, record_id string, record_type string, target_uri string, refers_to string, chunk_no long, data binary, payload_bytes long, payload_digest string, last boolean"
_ROWS = pa.schema([("path", pa.string()), ("record_no", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_())])


def chunked(records: DataFrame, payload: str = "payload", size: int = CHUNK) -> DataFrame:
    """One row for each `size` bytes of the binary payload, in order and with the other columns; an empty or null one gives one empty row."""
    data = F.coalesce(F.col(f"`{payload}`"), F.lit(b""))
    last = F.floor((F.greatest(F.octet_length(data), F.lit(1)) - 1) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.cast("long").alias("chunk_no"), F.substring(data, i * size + 1, F.lit(size)).alias("data")))
    rest = [F.col(f"`{c}`") for c in records.columns if c != payload]
    return records.select(*rest, F.explode(parts).alias("_part")).select(*rest, "_part.chunk_no", "_part.data")


# ---------------------------------------------------------------- writing


def _clean(uri: str) -> str:
    """A URI as one header line: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def _head(kind: str, record_id: str, uri: str | None, refers_to: str | None, size: int, digest: str, date: str) -> bytes:
    """The headers of a record and of the HTTP message in it. A revisit has the message's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_clean(record_id)}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(uri)}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{_clean(refers_to or '')}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if kind == 'revisit' else size)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


class _Archives:
    """Archives of one task. Chunks of a record come one after the other; lengths and digests that don't come true are errors."""

    def __init__(self, root: str, date: str):
        self.fs, self.root = pa.fs.FileSystem.from_uri(root)
        self.uri, self.date, self.file, self.record, self.index = root, date, None, None, []

    def chunk(self, row: dict, data) -> None:
        if row["chunk_no"] == 0:
            self.end_record()
            if self.file is not None and self.at >= ARCHIVE:
                self.close()
            if self.file is None:
                self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
                self.fs.create_dir(self.root)
                self.file = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.record, self.begin, self.next, self.held = row, self.at, 0, 0
            self.member, self.digest = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha256()
            self._put(self.member.compress(_head(row["record_type"], row["record_id"], row["target_uri"], row["refers_to"], row["payload_bytes"], row["payload_digest"], self.date)))
        if self.record is None or row["record_id"] != self.record["record_id"] or row["chunk_no"] != self.next:
            raise ValueError(f"chunk {row['chunk_no']} of {row['record_id']} doesn't follow the one before it")
        self.next += 1
        self.held += len(data)
        self.digest.update(data)
        self._put(self.member.compress(data))

    def _put(self, data: bytes) -> None:
        if data:
            self.file.write(data)
            self.at += len(data)

    def end_record(self) -> None:
        if self.record is None:
            return
        row, self.record = self.record, None
        whole = self.held == 0 if row["record_type"] == "revisit" else self.held == row["payload_bytes"] and self.digest.hexdigest() == row["payload_digest"]
        if not whole:
            raise ValueError(f"the chunks of {row['record_id']} aren't the payload that its record states")
        self._put(self.member.compress(b"\r\n\r\n") + self.member.flush())
        self.index.append((f"{self.uri}/{self.name}", self.begin, self.at - self.begin, row["record_id"]))

    def close(self) -> None:
        self.end_record()
        if self.file is not None:
            self.file.close()
            self.file = None

    def indexed(self) -> pa.RecordBatch:
        rows, self.index = self.index, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_INDEX)], schema=_INDEX)


def write(chunks: DataFrame, root: str, date: str = DATE) -> DataFrame:
    """Write the records of a chunk table as archives under `root`, a folder that all executors see; returns their index.

    chunks: the columns of CHUNKS. The chunks of a record stand together in one partition, from number 0 on, as chunked() makes
    them; payload_bytes and payload_digest (SHA-256, lower-case hex) are those of the full payload, and of the one revisited where
    record_type is revisit, which has one empty chunk. Each partition writes archives of its own, so there are no empty ones.
    The index (path, offset, size, record_id) has a row for each record, is stored, and alone says which archives count.
    """

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(root, date)
        for batch in batches:
            data = batch.column(batch.schema.get_field_index("data"))
            rows = batch.drop_columns(["data"]).to_pylist()
            for i, row in enumerate(rows):
                archives.chunk(row, data[i].as_buffer() or b"")
            if len(archives.index) >= 1 << 16:
                yield archives.indexed()
        archives.close()
        if archives.index:
            yield archives.indexed()

    names = [c.split()[0] for c in CHUNKS.split(", ")]
    return common.materialize(chunks.select(*names).mapInArrow(call, INDEX), "archive-index")


# ---------------------------------------------------------------- reading


class _Stream:
    """Bytes of an archive, plain or of gzip members, through a buffer of bounded size."""

    def __init__(self, raw):
        self.raw, self.buffer, self.at, self.ended = raw, b"", 0, False
        start = raw.read(2)
        self.inflate = zlib.decompressobj(31) if start == b"\x1f\x8b" else None
        self.waiting = start

    def _fill(self) -> bool:
        """More bytes in the buffer; False at the end of the archive."""
        more = b""
        while not more:
            if not self.waiting:
                self.waiting = self.raw.read(1 << 16)
            if not self.waiting:
                if self.inflate is not None and not self.inflate.eof and not self.ended:
                    raise EOFError("the archive ends amid a gzip member")
                return False
            if self.inflate is None:
                more, self.waiting = self.waiting, b""
                continue
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            more = self.inflate.decompress(self.waiting, 1 << 18)
            self.waiting = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.buffer, self.at = self.buffer[self.at :] + more, 0
        return True

    def some(self, n: int) -> bytes:
        """Up to n bytes, at least one; empty at the end."""
        if self.at == len(self.buffer) and not self._fill():
            return b""
        out = self.buffer[self.at : self.at + n]
        self.at += len(out)
        return out

    def line(self, most: int = HEADER) -> bytes | None:
        """A line with its end; None at the end of the archive."""
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if len(self.buffer) - self.at > most:
                raise ValueError("a header line is too long")
            if not self._fill():
                if self.at < len(self.buffer):
                    raise EOFError("the archive ends amid a line")
                return None
        out = self.buffer[self.at : end + 1]
        self.at = end + 1
        return out


def _fields(stream: _Stream) -> tuple[dict[str, str], int]:
    """Header fields up to the empty line, names in lower case, and how many bytes were read; lines that go on are joined."""
    out, last, size = {}, None, 0
    while True:
        line = stream.line()
        if line is None:
            raise EOFError("the archive ends amid headers")
        size += len(line)
        if not line.strip(b"\r\n"):
            return out, size
        if line[:1] in b" \t" and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, _, value = line.decode("utf-8", "replace").partition(":")
        last = name.strip().lower()
        out[last] = value.strip()


def _bare(uri: str | None) -> str | None:
    return uri[1:-1] if uri and uri.startswith("<") and uri.endswith(">") else uri


def records(raw, path: str, size: int = CHUNK) -> Iterator[tuple]:
    """The rows of ROWS of one archive, read from a byte stream with bounded memory."""
    stream, number = _Stream(raw), 0
    while True:
        line = stream.line()
        while line in (b"\n", b"\r\n"):
            line = stream.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"record {number} of {path} doesn't begin with a WARC version")
        head, _ = _fields(stream)
        left = int(head["content-length"])
        kind, stated = head.get("warc-type"), head.get("warc-payload-digest", "")
        stated = stated[7:].lower() if stated.lower().startswith("sha256:") else None
        told = None
        if head.get("content-type", "").replace(" ", "").startswith("application/http") and left:
            first = stream.line()
            if first is None:
                raise EOFError(f"record {number} of {path} ends amid its headers")
            http, used = _fields(stream)
            left -= len(first) + used
            told = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        if left < 0:
            raise ValueError(f"record {number} of {path} is longer than it states")
        common_ = (path, number, _bare(head.get("warc-record-id")), kind, head.get("warc-target-uri"), _bare(head.get("warc-refers-to")))
        digest, done, chunk = hashlib.sha256(), 0, 0
        while True:
            parts, room = [], min(size, left)
            while room:
                part = stream.some(room)
                if not part:
                    raise EOFError(f"{path} ends amid record {number}")
                parts.append(part)
                room -= len(part)
            data = b"".join(parts)
            left, done = left - len(data), done + len(data)
            digest.update(data)
            if kind == "revisit" and not done and not left:
                yield *common_, 0, b"", told, stated, True
            else:
                so_far = digest.copy().hexdigest()
                if not left and stated is not None and stated != so_far:
                    raise ValueError(f"the payload of record {number} of {path} doesn't have the digest that it states")
                yield *common_, chunk, data, done, so_far, not left
            chunk += 1
            if not left:
                break
        number += 1


def read(paths: DataFrame, payloads: bool = True, size: int = CHUNK) -> DataFrame:
    """The records of archives (column path), one row for each chunk of at most `size` bytes of payload.

    Plain and gzip archives are read, of one member or many. Columns: path, record_no (from 0 in its archive), record_id,
    record_type, target_uri, refers_to (ids without angle brackets), chunk_no, data, payload_bytes and payload_digest (of the payload
    up to the end of this chunk), last (whether the record ends here; with it, both are those of the full payload). The payload of an
    HTTP message is what follows its headers, taken as it is; of other records their whole block. A revisit without a payload has one
    empty chunk with the length and digest that it states. Without `payloads` data is null. A payload without the digest that it
    states, an archive that ends amid a record, and a block longer than stated are errors. Repeated paths are read each, null ones
    not; an archive is streamed by one task, in memory that depends on `size` only.
    """

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(place, compression=None, buffer_size=1 << 18) as raw:
                    for row in records(raw, path, size):
                        rows.append(row if payloads else (*row[:7], None, *row[8:]))
                        held += 200 + (len(row[7]) if payloads else 0)
                        if held >= HANDOVER:
                            yield _batch(rows)
                            rows, held = [], 0
        if rows:
            yield _batch(rows)

    paths = paths.where(F.col("path").isNotNull()).select("path")
    width = max(1, min(4 * common.shuffle_width(paths.sparkSession), paths.count()))
    return paths.repartition(width).mapInArrow(call, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


# ---------------------------------------------------------------- pages


def _page(name: Column) -> Column:
    return F.concat(F.lit("urn:x-page:"), F.coalesce(name.cast("string"), F.lit("")))


def archive(pages: DataFrame, root: str, least: int = LEAST) -> DataFrame:
    """Write a record for each page (page_id, url, html) under `root`; returns the index, as write() does.

    The payload is the html in UTF-8, null counts as empty. Of pages with equal payloads of at least `least` bytes one is a response,
    that with the smallest (page_id, url), nulls last; all others revisit it, repeated rows of that page too. Smaller payloads are
    responses each. Payloads are sent to one place once for each of their digests and task; copies travel as counted ids. A group of
    more than N / MOST_HOT copies is joined by broadcast, of which there are at most MOST_HOT.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("`html`"), F.lit("")).cast("binary")
    bytes_ = F.octet_length(payload).cast("long")
    base = pages.select(F.col("`page_id`").alias("page_id"), F.col("`url`").alias("target_uri"), bytes_.alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"), payload.alias("payload"))
    large = F.col("payload_bytes") >= least
    key = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", F.col("target_uri").isNull().alias("placeless"), "target_uri")
    slim = common.materialize(base.where(large).groupBy("payload_digest", "payload_bytes", "page_id", "target_uri").agg(F.count("*").alias("n")), "page-digests")
    groups = common.materialize(slim.groupBy("payload_digest").agg(F.min(key).alias("first"), F.sum("n").alias("copies")), "page-groups").where("copies > 1")
    hot = max(HOT, (slim.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    first = F.struct(*[F.col(f"first.{c}").alias(c) for c in ("unnamed", "page_id", "placeless", "target_uri")])
    often, rest = groups.where(F.col("copies") > hot), groups.where(F.col("copies") <= hot)
    others = slim.join(F.broadcast(often), "payload_digest").unionByName(slim.join(F.broadcast(often.select("payload_digest")), "payload_digest", "left_anti").join(rest, "payload_digest"))
    n = F.col("n") - F.when(key == first, 1).otherwise(0)
    revisits = others.withColumn("n", n).where("n > 0").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    revisits = revisits.select(_page(F.col("page_id")).alias("record_id"), F.lit("revisit").alias("record_type"), "target_uri", _page(F.col("first.page_id")).alias("refers_to"), "payload_bytes", "payload_digest", F.lit(0).cast("long").alias("chunk_no"), F.lit(b"").alias("data"))
    whole = base.where(large).groupBy("payload_digest").agg(F.min(key).alias("first"), F.any_value("payload_bytes").alias("payload_bytes"), F.any_value("payload").alias("payload"))
    whole = whole.select(F.col("first.page_id").alias("page_id"), F.col("first.target_uri").alias("target_uri"), "payload_bytes", "payload_digest", "payload")
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    response = lambda df: chunked(df.select(_page(F.col("page_id")).alias("record_id"), F.lit("response").alias("record_type"), "target_uri", F.lit(None).cast("string").alias("refers_to"), "payload_bytes", "payload_digest", "payload")).select(*names)
    return write(response(whole).unionByName(response(base.where(~large))).unionByName(revisits.select(*names)), root)


def op11_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives and reads these back: each record's length, digest, type and what it refers to."""
    pages = common.table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    index = archive(pages, common.new_folder(spark, "warc"))
    ended = read(index.select("path").distinct(), payloads=False).where("last AND record_type IN ('response', 'revisit')")
    number = lambda c: F.when(F.col(c) != "urn:x-page:", F.expr(f"substring({c}, 12)")).cast(kind)
    return ended.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, html, octet_length(encode(html)) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM g
"""
