"""Sharp ranges on small worlds, against every assignment that keeps the totals and what is shown."""

import itertools
import random

from pyspark.sql import functions as F

from tesserae.operators import bounds

GROUPS = 3


def world(rng):
    """Slots (task, slot, k, g, gold, shown) of a few tasks of one size."""
    k = rng.randint(1, 4)
    rows = []
    by_task = rng.random() < 0.4
    for t in range(rng.randint(1, 4 if k < 3 else 3)):
        whole = rng.random() < 0.3
        for s in range(k):
            rows.append((t, s, k, rng.randrange(GROUPS), int(rng.random() < 0.6), whole if by_task else rng.random() < 0.25))
    return rows


def extremes(rows):
    hidden = [i for i, r in enumerate(rows) if not r[5]]
    need = [sum(rows[i][4] for i in hidden if rows[i][3] == g) for g in range(GROUPS)]
    per_group = [[i for i in hidden if rows[i][3] == g] for g in range(GROUPS)]
    passes = []
    for ones in itertools.product(*(itertools.combinations(p, n) for p, n in zip(per_group, need, strict=True))):
        on = {i for part in ones for i in part} | {i for i, r in enumerate(rows) if r[5] and r[4]}
        tasks = {}
        for i, r in enumerate(rows):
            tasks[r[0]] = tasks.get(r[0], True) and i in on
        passes.append(sum(tasks.values()))
    return min(passes), max(passes)


def test_ranges_are_those_of_all_assignments(spark):
    rng = random.Random(17)
    worlds = [world(rng) for _ in range(500)]
    rows = [(f"w{w}", *r) for w, world_rows in enumerate(worlds) for r in world_rows]
    slots = spark.createDataFrame(rows, "release string, task_id long, slot int, k int, g int, gold int, shown boolean")
    tasks = bounds.typed(slots, GROUPS)
    planned = bounds.plan(tasks, GROUPS)
    bits = bounds.witnesses(slots, tasks, planned)
    got = {r["release"]: r for r in bounds.checked(bits, planned).collect()}
    assert len(got) == 500
    for w, world_rows in enumerate(worlds):
        r = got[f"w{w}"]
        assert (r["low_passes"], r["high_passes"]) == (r["least"], r["most"]) == extremes(world_rows)
        assert r["bound"] == r["most"] and r["broken_totals"] == r["broken_links"] == 0
        assert r["least"] <= r["truth"] <= r["most"]


def test_releases_nest(spark):
    """More that is shown never widens a range, and all that is shown leaves one value."""
    rng = random.Random(18)
    rows = [(t, s, rng.randrange(2), int(rng.random() < 0.7)) for t in range(200) for s in range(1 + t % 4)]
    frame = spark.createDataFrame(rows, "task_id long, slot int, prediction int, gold int")
    shown = {"0": F.lit(False), "1": F.col("task_id") % 4 == 0, "2": F.col("task_id") % 2 == 0, "3": (F.col("task_id") % 2 == 0) | (F.col("slot") == 0), "4": F.lit(True), "none": F.lit(None).cast("boolean")}
    slots = bounds.releases(frame, shown, F.col("prediction"))
    tasks = bounds.typed(slots, 2)
    planned = bounds.plan(tasks, 2)
    got = {(r["k"], r["release"]): r for r in bounds.checked(bounds.witnesses(slots, tasks, planned), planned).collect()}
    for k in range(1, 5):
        ranges = [(got[k, str(i)]["least"], got[k, str(i)]["most"]) for i in range(5)]
        assert all(a[0] <= b[0] <= b[1] <= a[1] for a, b in zip(ranges, ranges[1:], strict=False))
        assert ranges[4] == (got[k, "4"]["truth"],) * 2 and ranges[0] == (got[k, "none"]["least"], got[k, "none"]["most"])


def test_bits_are_the_planned_ones(spark):
    """Every slot gets both bits once, and a plan over many types keeps each group's totals."""
    rng = random.Random(19)
    rows = [("r", t, s, 5, rng.randrange(GROUPS), int(rng.random() < 0.8), rng.random() < 0.1) for t in range(400) for s in range(5)]
    slots = spark.createDataFrame(rows, "release string, task_id long, slot int, k int, g int, gold int, shown boolean")
    tasks = bounds.typed(slots, GROUPS)
    planned = bounds.plan(tasks, GROUPS)
    bits = bounds.witnesses(slots, tasks, planned)
    assert bits.count() == bits.select("task_id", "slot").distinct().count() == len(rows)
    r = bounds.checked(bits, planned).first()
    assert r["broken_totals"] == r["broken_links"] == 0 and (r["low_passes"], r["high_passes"]) == (r["least"], r["bound"])
    assert bounds.checked(bounds.witnesses(slots.limit(0), tasks.limit(0), planned.limit(0)), planned.limit(0)).count() == 0


def test_ladder_tells_whole_tasks_up_to_its_keys(spark, monkeypatch):
    """Every d2 release of a ladder against its own slots; slots are typed twice, not once for each of 52 releases."""
    import hashlib

    from tesserae.operators import bounds
    from tesserae.plans import disclosure

    rng = random.Random(4)
    rows = [(t, s, t % 3, "p", rng.choice("ANR"), rng.randrange(2), rng.randrange(2), [0]) for t in range(12) for s in range(rng.randint(1, 3))]
    frame = spark.createDataFrame(rows, "task_id long, slot int, base_id long, producer string, category string, gold int, prediction int, secondary array<int>")
    typed, calls = bounds.typed, []
    monkeypatch.setattr(bounds, "typed", lambda slots, groups: calls.append(1) or typed(slots, groups))
    monkeypatch.setattr(disclosure, "ORDERS", (1, 2))
    monkeypatch.setattr(disclosure, "STEPS", (25, 50))
    got = {(r["stage"], r["ord"], r["share"]): r for r in disclosure.ladder(frame).collect()}
    assert len(got) == 6 and len(calls) == 2
    for o in (1, 2):
        order = sorted(range(12), key=lambda t: hashlib.sha256(b"shown|%d|%d" % (o, t)).hexdigest())
        for s in (25, 50):
            shown = order[: s * 12 // 100]
            slots, groups = bounds.releases(frame, {"x": frame["task_id"].isin(shown)}, frame["prediction"] * 3 + (frame["category"] == "N").cast("int") + 2 * (frame["category"] == "R").cast("int")), 6
            plan = bounds.plan(typed(slots, groups), groups).groupBy("k").agg({"least": "max", "most": "max"}).collect()
            assert (got["d2", o, s]["least"], got["d2", o, s]["most"]) == (sum(r["max(least)"] for r in plan), sum(r["max(most)"] for r in plan))


def _orders(spark, path, categories="ANR"):
    """Orders with lines in any order of rows, of which some share their number and part; an order without lines and a line without one."""
    rng, lines = random.Random(31), []
    for t in range(150):
        numbers = [rng.choice((1, 2)) for _ in range(3)] if t % 5 == 0 else range(1, rng.randint(2, 6))
        lines += [(t * 7 - 40, n, rng.choice((5, 9)), rng.randint(1, 9), float(rng.choice((3, 9, 20, 30))), float(rng.randint(1, 9)), None, rng.choice(categories)) for n in numbers]
    rng.shuffle(lines)
    lines.append((5000, 1, 1, 1, 1.0, 1.0, None, "A"))
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate date, l_returnflag string"
    spark.createDataFrame(lines, schema).repartition(3).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(t * 7 - 40, t % 4, "p") for t in range(150)] + [(6000, 1, "p")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_chunks_give_what_slots_do(spark, tmp_path, monkeypatch):
    """Ranges, checks and totals from chunks of a few tasks against those from rows by slot, of which none is made for a release any more."""
    from tesserae.plans import disclosure
    from tesserae.sources import frames

    place = _orders(spark, tmp_path)
    rows = lambda df: sorted(map(repr, df.collect()))
    names = ("sharp_ranges", "witness_check", "witness_totals")
    frame = frames.orders_frame(spark, place).cache()
    want = [rows(getattr(disclosure, name)(frame)) for name in names]
    monkeypatch.setattr(bounds, "CHUNK", 20)
    monkeypatch.setattr(bounds, "releases", lambda *a: 1 / 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        made = disclosure.chunks(spark, place)
        assert made.count() > 10 and made.select("chunk").distinct().count() == made.count()
        assert [rows(disclosure.QUERIES[name](spark, place)) for name in names] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert disclosure.chunks(spark, _orders(spark, tmp_path / "other", "ANRX")) is None
