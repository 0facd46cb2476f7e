"""Best-fit packing of tokenised documents into sequences of fixed length.

Best-fit decreasing needs only the number of pieces of each length. Those counts, at most `capacity` of them, come to the
driver; a segment tree over the remaining capacities finds the tightest open bin for each; the outcome is a plan of runs
"pieces r0..r1 of this length go to bins b.. at this offset". Executors then place each piece by its rank within its length.
The plan is the one that placing the pieces one by one gives, since pieces of one length are alike and follow each other.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm import common

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that one window partition ranks, about.
RANKED_TOGETHER = 100_000
#: White-space runs that tiktoken isn't given: its regex engine keeps a state for each character of a run and ends the task at a million.
LONG_RUN = re.compile(r"(?<!\s)\s{100000}")


@functools.cache
def encoder(path: str):
    """A function from text to ids of a byte-level BPE file of the tokenizers library.

    The vocabulary and its special strings are read from that file; the merging itself is done by tiktoken, whose merge order is
    that of the ids, as in this kind of file, and which is several times faster. Tests hold the ids against the other library's. Texts with a LONG_RUN go to the tokenizers library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    import public_tokenizers

    coder = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    other = functools.cache(lambda: Tokenizer.from_file(path))

    def encode(text: str) -> list[int]:
        if LONG_RUN.search(text):
            return other().encode(text, add_special_tokens=False).ids
        if any(s in text for s in special):
            return coder.encode(text, allowed_special=set(special))
        return coder.encode_ordinary(text)

    return encode


class CapacityTree:
    """Segment tree over remaining capacities 0..most; a node holds the number of open bins below it."""

    def __init__(self, most: int):
        self.size = 1 << max(1, most).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += bins
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity >= need that an open bin has."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts of lengths.

    Returns runs (length, first rank, end rank, first bin, pieces a bin, offset) as int64 rows, and the number of bins. Rank r of a
    run goes to bin `first bin + (r - first rank) // pieces a bin`, at `offset + (r - first rank) % pieces a bin * length`.
    """
    tree, open_bins, runs, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], [], 0
    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        rank, count = 0, histogram[length]
        while rank < count:
            room = tree.tightest(length)
            if room is None:
                per = capacity // length
                first, many = bins, -(-(count - rank) // per)
                bins += many
                room = capacity
            else:
                per = room // length
                first, end = open_bins[room].pop()
                many = min(end - first, -(-(count - rank) // per))
                if first + many < end:
                    open_bins[room].append((first + many, end))
                tree.add(room, -many)
            placed = min(count - rank, many * per)
            runs.append((length, rank, rank + placed, first, per, capacity - room))
            full = placed // per
            for lo, hi, left in ((first, first + full, room - per * length), (first + full, first + many, room - placed % per * length)):
                if lo < hi:
                    open_bins[left].append((lo, hi))
                    tree.add(left, hi - lo)
            rank += placed
    return np.array(runs, np.int64).reshape(-1, 6), bins


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenise each document, add end_id, and cut it if it is longer than capacity; then the first piece is the shorter one."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            ids_of, rows, kept = batch.column(0).to_pylist(), ([], [], [], [], []), []
            texts = batch.column(1)
            for k, doc_id in enumerate(ids_of):
                text = texts[k].as_py()
                ids = np.array([*encode(text or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for column, value in zip(rows, (doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(value)
                    if keep_ids:
                        kept.append(ids[a:b].astype(np.int32))
            columns = [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences as best-fit decreasing does.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids with keep_ids). Null text is
    an empty document, which is the end id alone; repeated rows and equal ids are separate documents; a null doc_id stays null; an
    empty table gives no rows; further columns are ignored. Full pieces need no other company and get negative sequence ids; the
    others get the bins of the plan from 0.
    """
    made = common.materialize(pieces_of(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    histogram = {int(r["length"]): int(r["count"]) for r in made.groupBy("length").count().collect()}
    histogram.pop(capacity, None)
    runs, _ = plan(histogram, capacity)
    salts = max(1, -(-max(histogram.values(), default=1) // RANKED_TOGETHER))
    part = made.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    base = part.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = part.withColumn("within", within).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("within"))
    out = made.schema.names

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((runs[:, 1], runs[:, 0]))
        table = runs[order]
        start_of = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            at = np.empty(len(rank), np.int64)
            for one in np.unique(length):
                lo, hi = start_of[one], start_of[one + 1]
                mine = length == one
                at[mine] = lo + np.searchsorted(table[lo:hi, 1], rank[mine], "right") - 1
            row = table[at]
            step = rank - row[:, 1]
            seq, offset = row[:, 3] + step // row[:, 4], row[:, 5] + step % row[:, 4] * length
            columns = [batch.column(batch.schema.get_field_index(c)) for c in out]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seq), pa.array(offset)], [*out, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema) + ", sequence_id long, offset long"
    placed = ranked.select(*out, "rank").mapInArrow(place, schema)
    alone = made.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return placed.unionByName(alone)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pack(..., keep_ids=True): sequence_id, ids. A sequence has at most `capacity` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), default_tokenizer())
