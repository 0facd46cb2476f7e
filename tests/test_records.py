"""Record files: byte ranges, single reads, masks ahead of parsing, stages."""

import glob
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators.storage import shared_dir
from tesserae.sources import records


def write(path, lines, end="\n"):
    with open(path, "wb") as f:
        f.write(end.join(lines).encode())
    return str(path)


def test_lines_belong_to_the_range_they_start_in(tmp_path, monkeypatch):
    monkeypatch.setattr(records, "BUFFER", 7)
    rng = random.Random(1)
    for trial in range(30):
        lines = ["x" * rng.choice([0, 1, 5, 6, 7, 30]) + "é" * rng.randint(0, 2) for _ in range(rng.randint(0, 12))]
        path = write(tmp_path / f"f{trial}", lines + [""] * rng.randint(0, 1))
        data = open(path, "rb").read()
        want, at = [], 0
        for line in data.splitlines(keepends=True):
            want.append((at, line))
            at += len(line)
        for size in (1, 3, 8, 1000):
            got = [x for start in range(0, len(data), size) for x in records._lines(path, start, min(len(data), start + size))]
            assert got == want


def test_single_records(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    want = {}
    for k in range(3):
        rows = [{"n": i, "id": f"r{k}-{i}", "text": "é\n" * (i % 50)} for i in range(2000)]
        want |= {r["id"]: json.dumps(r) for r in rows}
        write(folder / f"p{k}.jsonl", [json.dumps(r) for r in rows] + ["", "  "])
    place = str(tmp_path / "index")
    records.unique(records.index(spark, str(folder), "id", size=10_000)).sort("id").write.parquet(place)
    known = spark.read.parquet(place)
    assert known.count() == 6000
    ids = ["r0-0", "r1-77", "r2-1999", "r0-1500", "nowhere"]
    opened = records.open_indexed(spark, place).where(F.col("id").isin(ids))
    assert {r["id"]: r["line"] for r in opened.collect()} == {i: want[i] for i in ids[:4]}
    asked = spark.createDataFrame([(i,) for i in [*ids, "r0-0", None]], "id string")
    assert {r["id"]: r["line"] for r in records.lookup(known, asked).collect()} == {i: want[i] for i in ids[:4]}
    assert {r["id"]: r["line"] for r in records.open_indexed(spark, place).where("id = 'r1-5' AND length(line) > 0").collect()} == {"r1-5": want["r1-5"]}
    with pytest.raises(Exception, match="name ids"):
        records.open_indexed(spark, place).collect()
    # all bytes but those of the asked records are destroyed: the read doesn't see it; then one byte of a record is
    keep = known.where(F.col("id").isin(ids)).collect()
    for path in glob.glob(f"{folder}/*"):
        data = bytearray(os.path.getsize(path))
        old = open(path, "rb").read()
        for r in keep:
            if r["file"].endswith(os.path.basename(path)):
                data[r["offset"] : r["offset"] + r["length"]] = old[r["offset"] : r["offset"] + r["length"]]
        open(path, "wb").write(bytes(data))
    assert {r["id"]: r["line"] for r in opened.collect()} == {i: want[i] for i in ids[:4]}
    r = next(r for r in keep if r["id"] == "r1-77")
    path = r["file"].removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    data[r["offset"] + 3] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception, match="hash"):
        records.lookup(known, asked).collect()


def test_bytes_that_are_read(tmp_path):
    """Ten of a million records: their own bytes and no more."""
    path = write(tmp_path / "million", [f'{{"id": {i}}}' for i in range(1_000_000)])
    lines = open(path, "rb").read().split(b"\n")
    offsets, at = [], 0
    for line in lines:
        offsets.append(at)
        at += len(line) + 1
    wanted = [(offsets[i], len(lines[i]), str(i), hashlib.sha256(lines[i]).hexdigest()) for i in range(0, 1_000_000, 100_000)]
    count = []

    class Counted:
        def __init__(self, place):
            self.file = open(place, "rb", buffering=0)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, n):
            self.file.seek(n)

        def read(self, n):
            count.append(n)
            return self.file.read(n)

    assert len(list(records.read_ranges(path, wanted, Counted))) == 10
    assert sum(count) == sum(w[1] for w in wanted) and len(count) == 10


@pytest.mark.parametrize("line", ['{"id": 1, "a": {"x": 1, "x": 2}}', '{"a": 1}', "[1]", "{", '{"id": null}'])
def test_an_index_refuses(spark, tmp_path, line):
    with pytest.raises(Exception):
        records.index(spark, write(tmp_path / "f", ['{"id": 0}', line]), "id").collect()


def test_repeated_ids_are_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        records.unique(records.index(spark, write(tmp_path / "f", ['{"id": 0}', '{"id": "0"}']), "id"))
    assert records.index(spark, write(tmp_path / "e", []), "id").count() == 0


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 7)
    if kind == 7:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind == 8:
        return {rng.choice(['a', 'b"', "x_hidden", "é", "c\\", "n_hidden"]) + str(rng.randrange(3)) * rng.randint(0, 1): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    return [0, 1, True, None, 0.5, -3e7, 'text "q" {[:,'][kind]


def masked(v, hidden, numbers):
    """What a masked value parses to, from the value itself."""
    if isinstance(v, dict):
        kinds = {bool: "boolean", int: "integer", float: "number", str: "string", type(None): "null", list: "array", dict: "object"}
        return {k: {"valid_binary": isinstance(x, int) and x in (0, 1), "source_type": kinds[type(x)]} if hidden(k) else masked(x, hidden, numbers) for k, x in v.items()}
    if isinstance(v, list):
        return [masked(x, hidden, numbers) for x in v]
    if numbers and isinstance(v, (int, float)) and not isinstance(v, bool):
        return "present" if 0 <= v <= 1 else "invalid"
    return v


def test_masks_are_those_of_the_values():
    rng = random.Random(2)
    hidden = lambda k: k.endswith("_hidden")
    for _ in range(2000):
        v = value(rng)
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        if rng.random() < 0.5:
            text = text.replace("hidden", "\\u0068idden")
        for numbers in (False, True):
            assert json.loads(records.mask_line(text, hidden, numbers)) == masked(v, hidden, numbers)


@pytest.mark.parametrize("text", ['{"a": 1, "\\u0061": 2}', '{"x": [{"k": {"secret": 1, "secret": 77}}]}', '{"s_hidden": {"a": 1, "a": 2}}', '{"a": 01x}', '{"a": ', '{"a": [}', '{"a": tru}'])
def test_repeated_keys_and_broken_texts_are_errors_without_values(text):
    with pytest.raises(ValueError) as e:
        records.mask_line(text, lambda k: k.endswith("_hidden"))
    assert "secret" not in str(e.value) and "77" not in str(e.value)


def test_masked_scan(spark, tmp_path):
    lines = ['{"id": 1, "role": {"score": 0.25, "deep": [{"q_fulfilment": {"v": "forbidden-1"}}]}, "a_fulfilment": true}', "", '{"id": 2, "role": {"sc\\u006fre": "forbidden-2", "deep": []}, "a_fulfilment": 7}']
    mask = "struct<valid_binary: boolean, source_type: string>"
    scan = records.masked_scan(spark, write(tmp_path / "f", lines), f"id long, role struct<score: {mask}, deep: array<struct<q_fulfilment: {mask}>>>, a_fulfilment {mask}", ("score",), ("_fulfilment",))
    got = [json.loads(x) for x in scan.orderBy("id").toJSON().collect()]
    number = {"valid_binary": False, "source_type": "number"}
    assert got == [
        {"id": 1, "role": {"score": number, "deep": [{"q_fulfilment": {"valid_binary": False, "source_type": "object"}}]}, "a_fulfilment": {"valid_binary": True, "source_type": "boolean"}},
        {"id": 2, "role": {"score": {"valid_binary": False, "source_type": "string"}, "deep": []}, "a_fulfilment": {"valid_binary": False, "source_type": "integer"}},
    ]
    assert "forbidden" not in str(got)


def test_a_sealed_stage_is_not_opened(spark, tmp_path):
    path = f"{shared_dir(spark)}/staged-{tmp_path.name}"
    rows = spark.range(100).select("id", F.when(F.col("id") < 40, "pilot").otherwise("confirmation").alias("stage"))
    records.write_staged(rows, path)
    for sealed in glob.glob(f"{path}/stage=confirmation/*.parquet"):
        open(sealed, "wb").write(b"sealed")
    pilot = records.read_staged(spark, path, "id long", ["pilot"])
    assert pilot.count() == 40 and all("stage=pilot" in f for f in records.files_read(pilot))
    with pytest.raises(Exception):
        records.read_staged(spark, path, "id long", ["confirmation"]).collect()
    with pytest.raises(ValueError):
        records.require_pruned(spark.read.schema("id long, stage string").parquet(path).where("id > 3"), "stage")


def test_masked_lines_are_handed_over_in_bounded_batches():
    """A batch of 4000 long lines, some blank, goes out in parts that Python holds one at a time."""
    import tracemalloc

    import pyarrow as pa

    line = '{"score": 1, "text": "%s"}' % ("x" * 10_000)
    batch = pa.RecordBatch.from_arrays([pa.array([line if n % 4 else " " for n in range(4000)])], ["value"])
    rows = most = 0
    tracemalloc.start()
    for part in records.mask_batches(iter([batch]), lambda key: key == "score"):
        rows, most = rows + part.num_rows, max(most, part.nbytes)
        assert '"valid_binary": true' in part.column(0)[0].as_py()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and most < 2 * records.BUFFER and peak < 8 * records.BUFFER
