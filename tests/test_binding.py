"""Digests that don't depend on layout, and differences by key and by position."""

import random

from pyspark.sql import functions as F

from tesserae.operators import binding
from tesserae.sources import records


def test_digest_depends_on_content_only(spark):
    rows = [(i, f"t{i % 7}" if i % 5 else None, i / 3) for i in range(3000)] + [(5, "t5", 5 / 3)] * 40
    df = spark.createDataFrame(rows, "k long, t string, x double")
    digests = {binding.root(df.repartition(n, F.rand()), ["k"]) for n in (1, 7, 64)}
    assert len(digests) == 1
    assert binding.root(df.select("x", "t", "k").orderBy("t"), ["k"]) in digests
    for other in (df.limit(3039), df.withColumn("t", F.coalesce("t", F.lit("N"))), df.unionByName(df.limit(1)), df.withColumn("x", F.when(F.col("k") == 77, F.col("x") + 1e-9).otherwise(F.col("x")))):
        assert binding.root(other, ["k"]) not in digests
    assert binding.root(df, ["k"], 1) not in digests and binding.root(df.limit(0), ["k"]) == binding.root(df.limit(0), ["t"])
    nodes = binding.tree(df, ["k"]).collect()
    assert {r["n"] for r in nodes if r["level"] == 0} == {3040} and sum(r["n"] for r in nodes if r["level"] == 2) == 3040


def test_a_changed_bit_is_located(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    new = df.where("k <> 17").withColumn("v", F.when(F.col("k") == 4321, F.col("v").bitwiseXOR(1)).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(9999, 1), (None, 2)], "k long, v long"))
    got = sorted((str(r["k"]), r["state"]) for r in binding.differences(df, new.repartition(9), ["k"]).collect())
    assert got == [("17", "missing"), ("4321", "changed"), ("9999", "added"), ("None", "added")]
    assert binding.differences(df, df.repartition(3), ["k"]).collect() == []


def test_keys_that_repeat(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, "d"), (3, "e")], "k long, v string")
    right = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "d"), (3, "f")], "k long, v string")
    assert sorted(map(tuple, binding.differences(left, right, ["k"]).collect())) == [(2, "changed"), (3, "changed")]


def brute(left, right):
    def nth(rows):
        seen, out = {}, []
        for r in rows:
            seen[r] = seen.get(r, 0) + 1
            out.append((r, seen[r]))
        return out

    a, b = nth(left), nth(right)
    gaps = []
    for rows, other in ((a, set(b)), (b, set(a))):
        matched, out = 0, {}
        for pos, r in enumerate(rows):
            if r in other:
                matched += 1
            else:
                out.setdefault(matched, []).append(pos)
        gaps.append(out)
    found = []
    for gap in set(gaps[0]) | set(gaps[1]):
        x, y = gaps[0].get(gap, []), gaps[1].get(gap, [])
        for i in range(max(len(x), len(y))):
            p, q = (x[i] if i < len(x) else None), (y[i] if i < len(y) else None)
            found.append(("missing" if q is None else "inserted" if p is None else "changed", p, q))
    return sorted(found, key=repr)


def test_positions(spark, tmp_path):
    rng = random.Random(4)
    left = [rng.choice("abcdef") * rng.randint(1, 3) for _ in range(300)]
    right = [x for x in left]
    for _ in range(20):
        at = rng.randrange(len(right))
        what = rng.randrange(3)
        if what == 0:
            right.insert(at, f"new{at}")
        elif what == 1:
            del right[at]
        else:
            right[at] = f"other{at}"
    sides = []
    for name, rows in (("l", left), ("r", right)):
        folder = tmp_path / name
        folder.mkdir()
        for k in range(3):
            (folder / f"part-{k}").write_text("".join(x + "\n" for x in rows[k * 100 : (k + 1) * 100 if k < 2 else None]))
        sides.append(binding.split_positions(records.lines(spark, str(folder), 64)))
    assert [r["pos"] for r in sides[1].orderBy("pos").collect()] == list(range(len(right)))
    got = sorted((tuple(r) for r in binding.by_position(*sides).collect()), key=repr)
    assert got == brute(left, right) and {g[0] for g in got} == {"missing", "inserted", "changed"}
    assert binding.by_position(sides[0], sides[0]).collect() == []
    empty = sides[0].limit(0)
    assert {r["state"] for r in binding.by_position(sides[0], empty).collect()} == {"missing"}


def test_positions_of_rows_that_occur_once_are_not_numbered(spark, monkeypatch):
    """Contents that don't repeat are matched without ranks of them; spans of four positions, in parts of four spans, carry over."""
    rng = random.Random(6)
    left = [f"row{k}" for k in range(400)]
    right = [x for x in left if rng.random() < 0.9]
    right[100:100] = [f"new{k}" for k in range(90)]
    del right[250:330]
    right = [f"other{k}" if rng.random() < 0.2 else x for k, x in enumerate(right)]

    def numbered(*args, **kwargs):
        raise AssertionError("rows that occur once are numbered")

    monkeypatch.setattr(binding.ranking, "global_offset", numbered)
    monkeypatch.setattr(binding, "_SPAN", 2)
    sides = [spark.createDataFrame(list(enumerate(rows)), "pos long, x string").selectExpr("pos", "sha2(x, 256) AS sha256") for rows in (left, right)]
    got = sorted((tuple(r) for r in binding.by_position(*sides).collect()), key=repr)
    assert got == brute(left, right) and {g[0] for g in got} == {"missing", "inserted", "changed"}
