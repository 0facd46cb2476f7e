"""Shared pieces of the corpus operators: table access, shared storage, byte-level hashing, packed key exchange.

Texts are handled as UTF-8 buffers of Arrow columns, many documents at a time, so that numpy works on whole batches.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64
#: Odd multipliers of the polynomial hashes (over bytes, over words) and their inverses modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
_MASK = (1 << 64) - 1
BYTE_INV = pow(BYTE_BASE, -1, 1 << 64)
WORD_INV = pow(WORD_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one given to setCheckpointDir.

    Where neither is set a local master gets a folder of our own, which goes when Python ends; any other master is an error, as its
    executors couldn't read what they write to folders of their own.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if place:
        return place.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share: master is {master}")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tesserae-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which made() lists from now on."""
    path = f"{shared_dir(spark)}/tesserae/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and survives the loss of executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """The folders that materialize() has written and nothing has removed."""
    return list(_made)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove such folders, once nothing reads them any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _made.remove(path)


def shuffle_width(spark: SparkSession) -> int:
    """spark.sql.shuffle.partitions, the one size knob: blocks and buckets are multiples of it, so they grow with the cluster's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever others a table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def unlike(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to be like no column, whatever its case."""
    have = {c.lower() for c in columns}
    while have & {n.lower() for n in names}:
        names = tuple("_" + n for n in names)
    return list(names)


# ---------------------------------------------------------------- buffers


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array and the offsets of each (len + 1). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks_by_bytes(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges (lo, hi) of documents of about `most` bytes; a longer document stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.ones(size, _U)
        filled, step = 1, base
        while filled < size:
            more = min(filled, size - filled)
            out[filled : filled + more] = out[:more] * _U(step)
            step = step * step & _MASK
            filled += more
        _powers[base] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the hash of data[i:j] times BYTE_BASE**i."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(BYTE_BASE, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each data[start:end]."""
    raw = (prefix[end] - prefix[start]) * powers(BYTE_INV, len(prefix))[start]
    return mix(raw + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


#: Byte values that part words: space and the ASCII control spaces 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (what lies between the byte values marked in gaps), and the index of each document's first one (len + 1)."""
    n = len(data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    ink = ~gaps[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = ink[:-1]
    before[edge[:n]] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.zeros(n, bool)
    after[:-1] = ink[1:]
    after[edge[1:]] = False
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(data), starts, ends)


def widen(h: np.ndarray, k: int, more: int | None = None) -> np.ndarray:
    """From unmixed hashes of windows of k words, those of k + more words (more <= k) at each start that has room."""
    more = k if more is None else more
    if len(h) <= k:
        return np.zeros(0, _U)
    assert more == k
    return h[:-k] + h[k:] * _U(pow(WORD_BASE, k, 1 << 64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Unmixed hash of each window of k consecutive words, len(words) - k + 1 of them, document borders ignored."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = words[:n].copy()
    for j in range(1, k):
        out += words[j : j + n] * _U(pow(WORD_BASE, j, 1 << 64))
    return out


def leftmost_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """For each start i with width values ahead, the index of the leftmost smallest of h[i:i+width]."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value, index, have = h, np.arange(len(h), dtype=np.int64), 1
    while have < width:
        step = min(have, width - have)
        left, right = value[:-step], value[step:]
        take = right < left
        index = np.where(take, index[step:], index[:-step])
        value = np.where(take, right, left)
        have += step
    return index


def split_by(bucket: np.ndarray, n: int):
    """Order that groups equal buckets (stable), and the bounds of each of n buckets in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def with_block(docs: DataFrame, blocks: int, *keys: str) -> DataFrame:
    """Deal rows to blocks by a hash of their key. A block is what one Python call sees at a time."""
    return docs.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))


# ---------------------------------------------------------------- packed exchange
#
# Keys of many windows travel packed: a block of documents sends each bucket one row with all its keys as bytes, and gets one row
# back. Both ends derive the same order of keys from the same documents, so an answer is a bit for each key sent.

#: Bytes of text that a block holds, about.
BLOCK_BYTES = 4 << 20
PACKED = "bucket int, block int, kind int, payload binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def block_count(docs: DataFrame) -> int:
    """As many blocks as shuffle partitions, and more if they would hold over BLOCK_BYTES of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_width(docs.sparkSession), -(-total // BLOCK_BYTES))


def in_blocks(docs: DataFrame, blocks: int, *more: str) -> DataFrame:
    """(block, doc_id, text, ...): rows dealt by id and text, so that neither rows without an id nor those of one id are one block.

    Used more than once in a plan, its exchange is reused.
    """
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    return docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text", *more)


def ordered(part: pa.Table) -> pa.Table:
    """The rows of a block in an order that depends on nothing but their content."""
    return part.take(pa.compute.sort_indices(part, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def packed_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, PACKED_ARROW, strict=True)], schema=PACKED_ARROW)


def send(block: int, bucket: np.ndarray, buckets: int, *columns: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """A row for each bucket that has keys: the number of keys, then each column's values for it."""
    order, bounds = split_by(bucket, buckets)
    sorted_columns = [c[order] for c in columns]
    out = []
    for b in np.flatnonzero(np.diff(bounds)):
        lo, hi = bounds[b], bounds[b + 1]
        out.append((int(b), block, 0, np.int64(hi - lo).tobytes() + b"".join(c[lo:hi].tobytes() for c in sorted_columns)))
    return out


def receive(payloads: list[bytes], *kinds: type) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of keys of each payload, and each column over all payloads."""
    sizes = np.array([np.frombuffer(p, np.int64, 1)[0] for p in payloads], np.int64)
    columns = []
    at = np.full(len(payloads), 8, np.int64)
    for kind in kinds:
        width = np.dtype(kind).itemsize
        columns.append(np.concatenate([np.frombuffer(p, kind, n, a) for p, n, a in zip(payloads, sizes, at, strict=True)]) if len(payloads) else np.zeros(0, kind))
        at += sizes * width
    return sizes, columns


def answer(bucket: int, blocks: list[int], sizes: np.ndarray, flags: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """The flags of the keys that each block has sent, as bits."""
    ends = np.cumsum(sizes)
    return [(bucket, block, 0, np.packbits(flags[e - n : e]).tobytes()) for block, n, e in zip(blocks, sizes, ends, strict=True)]


def answered(rows: pa.Table, bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The bits that came back, in the order of the keys that were sent."""
    order, bounds = split_by(bucket, buckets)
    out = np.zeros(len(bucket), bool)
    for b, kind, payload in zip(rows["bucket"].to_pylist(), rows["kind"].to_pylist(), rows["payload"].to_pylist(), strict=True):
        if kind == 0:
            n = bounds[b + 1] - bounds[b]
            out[order[bounds[b] : bounds[b + 1]]] = np.unpackbits(np.frombuffer(payload, np.uint8), count=int(n)).astype(bool)
    return out


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> _U(40)) % _U(buckets)).astype(np.int32)


def repeated(key: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Whether the weights of each key's equals sum to two or more."""
    if len(key) == 0:
        return np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    k = key[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    total = np.add.reduceat(weight[order].astype(np.int64), starts)
    out = np.zeros(len(key), bool)
    out[order] = np.repeat(total >= 2, np.diff(np.append(starts, len(k))))
    return out


def grouped(function, **fixed):
    """function(key, rows, **fixed) in the plain form that applyInArrow takes."""

    def call(key, rows):
        return function(key, rows, **fixed)

    return call


def paired(function, **fixed):
    """function(key, left, right, **fixed) in the plain form that cogrouped applyInArrow takes."""

    def call(key, left, right):
        return function(key, left, right, **fixed)

    return call
