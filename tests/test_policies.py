"""Policies and accounting against a literal replay, on all small worlds and on random ones."""

import itertools
import random

import pytest

from tesserae.operators import accounting, ranking

SCHEMA = "task_id long, slot int, base_id long, producer string, category string, gold int, prediction int, secondary array<int>"


def frame_of(spark, worlds):
    rows = []
    for t, (gold, prediction) in enumerate(worlds):
        for s, (g, p) in enumerate(zip(gold, prediction, strict=True)):
            rows.append((t, s, t % 3, "p", "c", g, p, [(g + s + t) % 2]))
    return spark.createDataFrame(rows, SCHEMA)


def literal(worlds, queries, budget):
    """Verdicts and certificates after the first queries, task by task."""
    seen = set(queries[:budget])
    out = dict.fromkeys(accounting.FIELDS, 0)
    for t, (gold, prediction) in enumerate(worlds):
        known = [(t, s) in seen for s in range(len(gold))]
        truth, initial = all(gold), all(prediction)
        eager = all(g if k else p for g, p, k in zip(gold, prediction, known, strict=True))
        fail = any(k and not g for g, k in zip(gold, known, strict=True))
        cert = fail or (truth and all(known))
        out["C"] += cert
        out["CW"] += cert and truth != initial
        out["certified_pass"] += cert and truth
        out["certified_fail"] += cert and not truth
        out["D"] += truth and not initial and eager and not cert
        out["A"] += not truth and not initial and eager
        out["eager_fp"] += eager and not truth
        out["eager_ff"] += truth and not eager
        out["U"] += any(known) and not cert
        out["tasks_touched"] += any(known)
        out["E0"] += truth != initial
        out["gate_fp"] += initial and not truth and not cert
        out["gate_ff"] += truth and not initial and not cert
    out["eager_errors"] = out["eager_fp"] + out["eager_ff"]
    out["gate_errors"] = out["gate_fp"] + out["gate_ff"]
    out["update_delta"] = out["gate_errors"] - out["eager_errors"]
    return out


WORLDS = [(g, p) for k in (1, 2, 3) for g in itertools.product((0, 1), repeat=k) for p in itertools.product((0, 1), repeat=k)]


@pytest.mark.parametrize("policy", ranking.POLICIES)
def test_accounting_is_a_literal_replay(spark, policy):
    rng = random.Random(policy)
    worlds = WORLDS + [([rng.randint(0, 1) for _ in range(5)], [rng.randint(0, 1) for _ in range(5)]) for _ in range(6)]
    frame = frame_of(spark, worlds)
    asked = ranking.transcript(frame, policy).cache()
    queries = [(r["task_id"], r["slot"]) for r in asked.orderBy("qnum").collect()]
    assert len(set(queries)) == len(queries)
    assert [r["qnum"] for r in asked.orderBy("qnum").collect()] == list(range(1, len(queries) + 1))
    caps = sorted({0, 1, 2, len(queries) // 3, len(queries) // 2, len(queries) - 1, len(queries), len(queries) + 5})
    for r in accounting.at_caps(accounting.times(frame, asked), caps).collect():
        want = literal(worlds, queries, r["cap"])
        assert {f: r[f] for f in accounting.FIELDS} == want, r["cap"]
        assert want["update_delta"] == want["D"] - want["A"] and abs(want["update_delta"]) <= want["U"]


def test_sequential_policies_stop_at_the_first_failure(spark):
    frame = frame_of(spark, WORLDS)
    for policy in ("sc_natural", "sc_random", "sc_judge", "sc_disagreement"):
        tasks = {}
        for r in ranking.transcript(frame, policy).orderBy("qnum").collect():
            tasks.setdefault(r["task_id"], []).append(r)
        for rows in tasks.values():
            assert all(r["gold"] for r in rows[:-1])
            assert [r["qnum"] for r in rows] == list(range(rows[0]["qnum"], rows[0]["qnum"] + len(rows)))


def test_unit_states_agree_with_prefixes(spark):
    frame = frame_of(spark, WORLDS)
    asked = ranking.transcript(frame, "random_criterion")
    states = accounting.unit_states(frame, asked.where("qnum <= 60")).groupBy().sum("certified_tasks", "residual_errors", "introduced_fp").first()
    prefix = accounting.at_caps(accounting.times(frame, asked), [60]).first()
    assert (states[0], states[1], states[2]) == (prefix["C"], prefix["eager_errors"], prefix["A"])


def test_global_offsets_match_one_sorted_list(spark):
    rng = random.Random(1)
    data = [(i, f"{rng.getrandbits(256):064x}", rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, h string, w int")
    from pyspark.sql import functions as F

    got = {r["id"]: r["offset"] for r in ranking.global_offset(df, ranking.by_hash(df, "h"), ["h"], weight=F.col("w")).collect()}
    total = 0
    for i, _, w in sorted(data, key=lambda x: x[1]):
        assert got[i] == total
        total += w


def test_unknown_names_are_errors(spark):
    frame = frame_of(spark, WORLDS[:4])
    with pytest.raises(ValueError):
        ranking.transcript(frame, "nothing")
    with pytest.raises(ValueError):
        ranking.task_order(frame, "nothing")


def test_cuts_are_the_keys_at_which_weights_are_reached(spark):
    """Every number of every run against a running sum; numbers below and above what there is."""
    rows = [(k % 2, f"{k * 2654435761 % 2**32:08x}" * 8, k % 4) for k in range(60)]
    df = spark.createDataFrame(rows, "run int, h string, w int")
    totals = {run: sum(w for r, _, w in rows if r == run) for run in (0, 1)}
    needs = [(run, 1000 * run + n, n) for run in (0, 1) for n in range(-1, totals[run] + 3)]
    got = ranking.cuts(df, "h", needs, df["w"], within="run")
    for run, name, n in needs:
        want, upto = ("", 0) if n < 1 else ("g", 0), 0
        for _, h, w in sorted((r for r in rows if r[0] == run), key=lambda r: r[1]):
            if upto < n <= upto + w:
                want = (h, n - upto)
            upto += w
        assert got[name] == want
