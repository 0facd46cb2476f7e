"""Record files of one JSON object a line: byte ranges of records, reads of single ones, scans that mask values, and staged tables.

Files are read through pyarrow's file systems inside tasks, a byte range at a time. A line belongs to the range in which it starts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tesserae.operators import validation
from tesserae.sources.files import reject_repeated_keys

#: Bytes of a range that a task takes at once, of one read, and rows that are handed over together.
RANGE, BUFFER, HANDOVER = 64 << 20, 1 << 20, 4096
INDEX = "file string, offset long, length long, id string, sha256 string"
_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("id", pa.string()), ("sha256", pa.string())])
_LINES = pa.schema([("id", pa.string()), ("line", pa.string())])


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, start, end): byte ranges of the files at path, by Spark's own listing; no file is opened."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    last = F.floor((F.col("length") - 1) / size)
    rows = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    return rows.select("file", (F.col("i") * size).alias("start"), F.least("length", (F.col("i") + 1) * size).alias("end"))


def _lines(file: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line with its end) of the lines that start in [start, end), read BUFFER bytes at a time."""
    fs, place = pa.fs.FileSystem.from_uri(file)
    with fs.open_input_file(place) as raw:
        at = start - 1 if start else 0  # the byte before tells whether a line starts here
        raw.seek(at)
        held, done, skip = b"", 0, start > 0  # done: bytes of held that are behind
        while True:
            cut = held.find(b"\n", done)
            if cut < 0:
                more = raw.read(BUFFER)
                if not more:
                    break
                held, done = held[done:] + more, 0
                continue
            line, done = held[done : cut + 1], cut + 1
            if not skip:
                if at >= end:
                    return
                yield at, line
            at, skip = at + len(line), False
        if done < len(held) and not skip and at < end:
            yield at, held[done:]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= HANDOVER:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def index(spark: SparkSession, path: str, key: str, size: int = RANGE) -> DataFrame:
    """(file, offset, length, id, sha256) of every record of the JSON Lines files at path; id is the field `key` as text.

    Empty lines are no records. A line that isn't an object, repeats a key at any depth or lacks the field is an error, and so is an id
    that occurs twice: see unique(). sha256 is that of the line's bytes, its end left out.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    for offset, raw in _lines(r["file"], r["start"], r["end"]):
                        line = raw.rstrip(b"\r\n")
                        if not line.strip():
                            continue
                        record = json.loads(line, object_pairs_hook=reject_repeated_keys)
                        if not isinstance(record, dict) or record.get(key) is None:
                            raise ValueError(f"the record at {offset} of {r['file']} has no {key}")
                        yield r["file"], offset, len(line), str(record[key]), hashlib.sha256(line).hexdigest()

        yield from _batches(rows(), _INDEX)

    parts = ranges(spark, path, size)
    return parts.repartition(max(1, parts.count())).mapInArrow(scan, INDEX)


def unique(rows: DataFrame) -> DataFrame:
    """The index, once no id of it occurs twice."""
    validation.require_unique(rows, ["id"])
    return rows


def read_ranges(file: str, wanted: list[tuple[int, int, str, str]], opened: Callable | None = None) -> Iterator[tuple[str, str]]:
    """(id, line) of the records (offset, length, id, sha256) of a file; nothing but their bytes is read, and each must have its hash."""
    fs, place = pa.fs.FileSystem.from_uri(file)
    with (opened or fs.open_input_file)(place) as raw:
        for offset, length, key, digest in sorted(wanted):
            raw.seek(offset)
            line = raw.read(length)
            if len(line) != length or hashlib.sha256(line).hexdigest() != digest:
                raise ValueError(f"the record of {length} bytes at {offset} of {file} doesn't have the hash of its index")
            yield key, line.decode()


def lookup(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line) of the records whose id is in ids (column id), by the index `rows`; ids without a record and nulls have no row.

    Wanted ranges are dealt by file and place, so that a task reads neighbours; repeated ids count once.
    """
    wanted = rows.join(ids.where("id IS NOT NULL").select(F.col("id").cast("string")).distinct(), "id", "left_semi")
    dealt = wanted.withColumn("part", F.floor(F.col("offset") / RANGE)).repartition("file", "part").sortWithinPartitions("file", "offset")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines():
            for batch in batches:
                by_file: dict[str, list] = {}
                for r in batch.to_pylist():
                    by_file.setdefault(r["file"], []).append((r["offset"], r["length"], r["id"], r["sha256"]))
                for file, some in by_file.items():
                    yield from read_ranges(file, some)

        yield from _batches(lines(), _LINES)

    return dealt.select("file", "offset", "length", "id", "sha256").mapInArrow(fetch, "id string, line string")


class _Ranges(InputPartition):
    def __init__(self, file: str, wanted: list[tuple[int, int, str, str]]):
        self.file, self.wanted = file, wanted


class _Reader(DataSourceReader):
    """Reads the records of the ids that a filter names."""

    def __init__(self, place: str):
        self.place, self.ids = place, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("id",):
                ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = ids if self.ids is None else self.ids & ids
            else:
                yield f

    def partitions(self) -> list[_Ranges]:
        if self.ids is None:
            raise ValueError("name ids in a filter; all records are read by spark.read.text")
        fs, place = pa.fs.FileSystem.from_uri(self.place)
        known = pa.dataset.dataset(place, filesystem=fs, format="parquet", exclude_invalid_files=True)
        found = known.to_table(filter=pa.dataset.field("id").isin(sorted(i for i in self.ids if i is not None))).to_pylist()
        parts: dict[tuple, list] = {}
        for r in found:
            parts.setdefault((r["file"], r["offset"] // RANGE), []).append((r["offset"], r["length"], r["id"], r["sha256"]))
        return [_Ranges(file, wanted) for (file, _), wanted in sorted(parts.items())]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        if partition is not None and partition.wanted:
            yield from _batches(read_ranges(partition.file, partition.wanted), _LINES)


class IndexedLines(DataSource):
    """spark.read.format("indexed_lines").option("index", path of a stored index).load().where("id IN (...)"): those records only.

    The ids of the filter are few enough to be written in a query; for a table of ids there is lookup().
    """

    @classmethod
    def name(cls) -> str:
        return "indexed_lines"

    def schema(self) -> str:
        return "id string, line string"

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["index"])


def open_indexed(spark: SparkSession, place: str) -> DataFrame:
    """The records behind a stored index, to be filtered by id. Spark pushes filters to sources in Python only where told to."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedLines)
    return spark.read.format("indexed_lines").option("index", place).load()


# ---------------------------------------------------------------- masked scans

_TOKEN = re.compile(r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity|[\[\]{}:,]|[ \t\r\n]+')
_KINDS = {'"': "string", "t": "boolean", "f": "boolean", "n": "null", "[": "array", "{": "object", "N": "number", "I": "number"}


def _number_status(token: str) -> str:
    """Whether a number lies in [0, 1], by its text; the value goes no further."""
    try:
        return "present" if 0 <= float(token) <= 1 and (token[0] != "-" or float(token) == 0) else "invalid"
    except ValueError:
        return "invalid"


def mask_line(line: str, hidden: Callable[[str], bool], numbers: bool = False) -> str:
    """A JSON text in which no hidden value is left: it is scanned as tokens, before any parser makes values of them.

    The value of each key for which hidden(key) holds, at any depth and however the key is spelled, becomes an object of valid_binary
    (it is 0, 1, true or false) and source_type (string, integer, number, boolean, null, array, object). With `numbers` every other
    number becomes "present" if it lies in [0, 1] and "invalid" if not. A key that an object repeats, at any depth, and what is no JSON
    token are errors whose messages hold neither keys nor values.
    """
    out: list[str] = []
    stack: list[tuple[str, set[str]]] = []  # open containers with the keys seen
    expects_key, cover, at, end = False, None, 0, len(line)  # cover: depth of the hidden container that is being left out
    hide = False
    while at < end:
        m = _TOKEN.match(line, at)
        if m is None:
            raise ValueError(f"no JSON token at {at}")
        token, at = m[0], m.end()
        first = token[0]
        if first in " \t\r\n":
            continue
        if first == '"' and expects_key:
            key = json.loads(token)
            if not stack or key in stack[-1][1]:
                raise ValueError(f"a key is repeated at depth {len(stack)}")
            stack[-1][1].add(key)
            expects_key = False
            if cover is None:
                hide = hidden(key)
                out.append(token)
            continue
        if first in ":,":
            expects_key = first == "," and bool(stack) and stack[-1][0] == "{"
            if cover is None:
                out.append(token)
            continue
        if first in "]}":
            if not stack or stack.pop()[0] != ("[" if first == "]" else "{"):
                raise ValueError(f"unbalanced at {at}")
            expects_key = False
            if cover is None:
                out.append(token)
            elif len(stack) == cover:
                cover = None
            continue
        if cover is None and hide:
            kind = _KINDS.get(first, "number" if set(token) & set(".eE") else "integer")
            good = token in ("0", "1", "-0", "true", "false")
            out.append('{"valid_binary": %s, "source_type": "%s"}' % ("true" if good else "false", kind))
            if first in "[{":
                cover = len(stack)
            hide = False
        elif cover is None:
            masked = numbers and first not in '"tfn[{'
            out.append(f'"{_number_status(token)}"' if masked else token)
        if first in "[{":
            stack.append((first, set()))
            expects_key = first == "{"
    if stack:
        raise ValueError("the text ends amid a container")
    return "".join(out)


def mask_batches(batches: Iterator[pa.RecordBatch], hidden: Callable[[str], bool], numbers: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of masked lines; one is handed over as soon as it has BUFFER characters or HANDOVER lines, whatever comes in at once."""
    held: list[str] = []
    size = 0
    for batch in batches:
        for value in batch.column(0):
            text = value.as_py()
            if not text.strip():
                continue
            held.append(mask_line(text, hidden, numbers))
            size += len(held[-1])
            if size >= BUFFER or len(held) >= HANDOVER:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])


def masked_scan(spark: SparkSession, path: str, schema: str, hidden: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), numbers: bool = False) -> DataFrame:
    """The records of JSON Lines files by `schema`, with the values of keys named in hidden, or ending in a suffix, masked ahead of parsing.

    What schema says of a masked field is struct<valid_binary: boolean, source_type: string>, and string for masked numbers. Empty
    lines are left out; broken records and repeated keys are errors. Only masked text reaches a parser, a column or a plan.
    """

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return mask_batches(batches, lambda key: key in hidden or (bool(suffixes) and key.endswith(suffixes)), numbers)

    masked = spark.read.text(path).mapInArrow(mask, "value string")
    return masked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


# ---------------------------------------------------------------- staged tables


def write_staged(rows: DataFrame, path: str, stage: str = "stage") -> None:
    """Rows in a folder for each stage, so that a stage can be read without touching another."""
    rows.write.partitionBy(stage).parquet(path)


def read_staged(spark: SparkSession, path: str, schema: str, stages: list[str], stage: str = "stage") -> DataFrame:
    """The rows of the named stages. The schema is given, so that no file of a sealed stage is opened for it.

    The scan must prune by stage: a plan that could read a sealed folder is an error.
    """
    rows = spark.read.schema(f"{schema}, `{stage}` string").parquet(path).where(F.col(stage).isin(*stages))
    require_pruned(rows, stage)
    return rows


def require_pruned(rows: DataFrame, column: str) -> None:
    """An error unless every file scan of the plan filters its partitions by the column."""
    scans = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    for line in scans:
        pruning = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", line)
        if pruning is None or f"{column}#" not in pruning[1]:
            raise ValueError(f"a scan isn't pruned by {column}")
    if not scans:
        raise ValueError("there is no file scan to prune")


def files_read(rows: DataFrame) -> list[str]:
    """The files that a scan's rows come from."""
    return sorted(r[0] for r in rows.select(F.input_file_name()).distinct().collect())


# ---------------------------------------------------------------- positions


def lines(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, start, offset, length, number, sha256) of every line of the files at path, empty ones too, its end left out.

    number counts the lines of a range, from 0 in the order of the file.
    """
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("number", pa.int64()), ("sha256", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    for number, (offset, raw) in enumerate(_lines(r["file"], r["start"], r["end"])):
                        line = raw.rstrip(b"\r\n")
                        yield r["file"], r["start"], offset, len(line), number, hashlib.sha256(line).hexdigest()

        yield from _batches(rows(), schema)

    parts = ranges(spark, path, size)
    return parts.repartition(max(1, parts.count())).mapInArrow(scan, "file string, start long, offset long, length long, number long, sha256 string")
