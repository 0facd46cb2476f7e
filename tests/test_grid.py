"""The grid against one run at a time, the nested policy against its definition, and matching on both sides' gaps."""

import random

from tests.test_policies import SCHEMA

from tesserae.operators import accounting, ranking
from tesserae.plans import grid, ingestion


def some_frame(spark, seed=3, tasks=25):
    rng, rows = random.Random(seed), []
    for t in range(tasks):
        for s in range(rng.randint(1, 6)):
            rows.append((t * 1000, s, t % 4, "p", "c", int(rng.random() < 0.7), int(rng.random() < 0.7), [int(rng.random() < 0.7)]))
    return spark.createDataFrame(rows, SCHEMA)


def test_grid_is_each_run_by_itself(spark):
    frame = some_frame(spark).cache()
    shares = (0, 7, 20, 50, 93, 100)
    got = {(r["policy"], r["task_order"], r["seed"], r["share"]): tuple(r[f] for f in accounting.FIELDS) for r in grid.curves(frame, seeds=(0, 2), shares=shares).collect()}
    assert len(got) == 7 * 3 * 2 * len(shares)
    for policy, order, seed in (("random_criterion", "random", 2), ("sc_judge", "release", 0), ("disagreement_only", "predicted_fail_count", 2), ("disagreement_then_random", "random", 2), ("sc_natural", "predicted_fail_count", 0)):
        want = accounting.curve(frame, ranking.transcript(frame, policy, order, seed), shares)
        for r in want.collect():
            assert got[policy, order, seed, r["share"]] == tuple(r[f] for f in accounting.FIELDS), (policy, order, seed, r["share"])


def test_nested_sets_grow_one_by_one(spark):
    frame = some_frame(spark, 5, 8)
    m = frame.count()
    sets = {}
    for r in grid.nested(frame, tuple(range(0, 101))).collect():
        sets.setdefault(r["share"], set()).add((r["task_id"], r["slot"]))
    sizes = [round(s * m / 100) for s in range(101)]
    for s in range(1, 101):
        assert len(sets.get(s, ())) == sizes[s]
        assert sets.get(s - 1, set()) <= sets.get(s, set())


def test_replay_ends_in_the_curve(spark):
    frame = some_frame(spark, 7)
    total = {f: sum(r[f] for r in grid.replay(frame).collect()) for f in ("d_certified", "d_eager_errors", "d_gate_errors", "d_touched")}
    first, last = (r.asDict() for r in accounting.curve(frame, ranking.transcript(frame, "sc_judge"), (0, 100)).orderBy("share").collect())
    assert total == {"d_certified": last["C"] - first["C"], "d_eager_errors": last["eager_errors"] - first["eager_errors"], "d_gate_errors": last["gate_errors"] - first["gate_errors"], "d_touched": last["tasks_touched"]}


def test_requests_and_answers_that_meet_nothing(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "r long")
    answers = spark.createDataFrame([(2,), (3,), (3,), (4,)], "a long")
    assert ingestion.match_once(asked, answers).first().asDict() == {"matched": 2, "unanswered": 1, "unasked": 1, "most_answers": 2}


def test_offsets_within_runs(spark):
    rows = [(k % 2, f"{k:03x}" * 5, k % 5) for k in range(300)]
    df = spark.createDataFrame(rows, "run int, h string, w int")
    got = ranking.global_offset(df, ranking.by_hash(df, "h"), ["h"], df["w"], within=("run",)).collect()
    for run in (0, 1):
        total = 0
        for r in sorted((r for r in got if r["run"] == run), key=lambda r: r["h"]):
            assert r["offset"] == total
            total += r["w"]


def test_arrays_and_rows_give_the_same_facts(spark, monkeypatch):
    """Tasks as arrays, tasks by windows, and some of each."""
    import random

    from tesserae.operators import ranking
    from tesserae.plans import grid

    rng = random.Random(8)
    rows = [(t, s, t % 5, "p", "A", rng.randrange(2), rng.randrange(2), [rng.randrange(2)]) for t in range(40) for s in range(rng.randint(1, 6))]
    frame = spark.createDataFrame(rows, "task_id long, slot int, base_id long, producer string, category string, gold int, prediction int, secondary array<int>")
    got = []
    for large in (10_000, 3, 0):
        monkeypatch.setattr(grid, "LARGE_TASK", large)
        made = grid.facts(frame, ranking.POLICIES, (0, 1, 2))
        got.append(sorted((tuple(r[c] for c in sorted(made.columns)) for r in made.collect()), key=repr))
    assert len(got[0]) == 40 * 7 * 3 and got[0] == got[1] == got[2]


def test_swept_curves_are_those_of_ranks(spark, monkeypatch):
    """Every run at every share from cuts and from ranks of all queries; ids of any sign and distance, in blocks of a few criteria."""
    from tesserae.operators import sweeps

    rng = random.Random(11)
    ids = [-(1 << 40), -7, *range(0, 60, 3), 1 << 50]
    rows = [(t, s, t % 4, "p", "c", int(rng.random() < 0.6), int(rng.random() < 0.6), [int(rng.random() < 0.6)]) for t in ids for s in range(rng.randint(1, 6))]
    frame = spark.createDataFrame(rows, SCHEMA).cache()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    seen = []
    counted = sweeps.counted
    monkeypatch.setattr(sweeps, "counted", lambda *a: seen.append(1) or counted(*a))
    swept = rows(grid.curves(frame, seeds=(0, 3)))
    assert seen and len(swept) == 7 * 3 * 2 * 101
    monkeypatch.setattr(grid, "LARGE_TASK", 0)
    assert swept == rows(grid.curves(frame, seeds=(0, 3))) and len(seen) == 1


def test_blocks_and_cuts_do_not_depend_on_size():
    import numpy as np
    import pyarrow as pa

    from tesserae.operators import sweeps

    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7]), pa.array([[0, 1], [0], [0, 1, 2]], pa.list_(pa.int32())), pa.array([[1, 6], [3], [0, 2, 7]], pa.list_(pa.int8()))], names=["task_id", "slots", "codes"])
    old, sweeps.BLOCK = sweeps.BLOCK, 2
    try:
        parts = [(b.ids.tolist(), b.slots.tolist(), b.fails.tolist()) for b in sweeps.blocks([batch.slice(0, 1), batch.slice(1)])]
    finally:
        sweeps.BLOCK = old
    assert parts == [([5], [0, 1], [1]), ([6], [0], [0]), ([7], [0, 1, 2], [1])]
    cut = sweeps.Cut(1, *(np.array(x) for x in ([0, 0, 1], [4, 4, -2], [1, 2, 5])))
    assert [x.tolist() for x in cut.tasks(np.array([0, 0, 1, 1]), np.array([3, 4, -2, 9]))] == [[0, 0, 2, 3], [0, 2, 3, 3]]


def _orders(spark, path):
    """Orders with lines in any order of rows, equal line numbers with like and unlike codes, an order without lines and lines without one."""
    rng, lines = random.Random(4), []
    for t in range(60):
        numbers = [rng.choice((-2, -1, 2, 3, 1 << 22, 1 << 24)) for _ in range(rng.randint(2, 5))] if t % 5 == 0 else range(1, rng.randint(2, 7))
        lines += [(t * 7 - 40, n, rng.choice((5, 9, 1 << 37, 1 << 50, -3)), rng.randint(1, 9), float(rng.randint(1, 50)), float(rng.randint(1, 9)), None, "A") for n in numbers]
    rng.shuffle(lines)
    lines += [(None, 1, 1, 1, 1.0, 1.0, None, "A"), (5000, 1, 1, 1, 1.0, 1.0, None, "A")]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate date, l_returnflag string"
    spark.createDataFrame(lines, schema).repartition(3).write.parquet(f"{path}/lineitem.parquet")
    orders = [(t * 7 - 40, t % 4, "1-URGENT") for t in range(60)] + [(6000, 1, "2-HIGH"), (None, 1, "2-HIGH")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{path}/orders.parquet")


def test_tasks_dealt_once_are_those_of_the_frame(spark, tmp_path, monkeypatch):
    """Curves don't store the frame with all its columns: its tasks meet in one shuffle. Batches are of few rows, so tasks go on in the next."""
    from tesserae.operators import sweeps
    from tesserae.plans import contrasts, policies
    from tesserae.sources import frames

    _orders(spark, tmp_path)
    rows = lambda df: sorted(map(repr, df.collect()))
    frame = frames.orders_frame(spark, str(tmp_path)).cache()
    want, tasks = rows(policies.objective_optimum_sets(frame)), rows(sweeps.packed(frame))
    signs = rows(contrasts.correction_signs(frame))
    again = []
    arrays = sweeps._arrays
    monkeypatch.setattr(sweeps, "_arrays", lambda df: again.append(df.select("task_id").distinct().count()) or arrays(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert rows(grid.packed_orders(spark, str(tmp_path))) == tasks and len(again) == 1 and 0 < again[0] < 30
        monkeypatch.setattr(grid, "stored_frame", lambda *a: 1 / 0)
        assert rows(policies.QUERIES["objective_optimum_sets"](spark, str(tmp_path))) == want
        assert rows(contrasts.QUERIES["correction_signs"](spark, str(tmp_path))) == signs
        # a task of many criteria
        monkeypatch.setattr(grid, "stored_frame", frames.orders_frame)
        monkeypatch.setattr(grid, "LARGE_TASK", 5)
        assert rows(policies.QUERIES["objective_optimum_sets"](spark, str(tmp_path))) == want
        assert "gold" in grid.packed_orders(spark, str(tmp_path)).columns
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_random_order_is_hashed_once(spark, monkeypatch):
    """One pass over the tasks finds the places of a random order and counts; windows that miss a place are widened."""
    from tesserae.operators import sweeps

    frame = sweeps.packed(some_frame(spark, 21, 60))
    rows = lambda: sorted(tuple(r) for r in grid.curves(frame, ("random_criterion", "disagreement_then_random"), ("random",), (1, 2), (0, 10, 45, 90, 100)).collect())
    passes, kind = [], type(frame)
    mapped = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda *a, **k: passes.append(1) or mapped(*a, **k))
    once = sorted(tuple(r) for r in grid.curves(frame, ("random_criterion",), ("random",), (1, 2), (0, 10, 45, 90, 100)).collect())
    assert len(passes) == 1 and len(once) == 10
    want = rows()
    assert [r for r in want if r[0] == "random_criterion"] == once
    passes.clear()
    monkeypatch.setattr(sweeps, "WIDTH", 0.01)
    assert rows() == want and len(passes) > 3
