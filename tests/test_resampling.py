"""Draws of whole families: exact totals, the same on any layout, and the curves that follow from them."""

import math

import numpy as np
from pyspark.sql import functions as F

from tesserae.operators import resampling
from tesserae.plans import resampled


def families(spark, n, parts=3):
    return spark.range(n).select(F.col("id").alias("base_id"), F.lit(1).alias("one")).repartition(parts)


def weights(df, replicates, seed=5):
    got = {}
    for r in resampling.totals(df, "base_id", ["base_id"], "one", replicates, seed).collect():
        got[r["rep"], r["base_id"]] = r["n"]
    return got


def test_each_replicate_draws_all(spark, monkeypatch):
    for bucket in (10_000, 10):
        monkeypatch.setattr(resampling, "BUCKET", bucket)
        got = weights(families(spark, 300), 40)
        assert all(sum(n for (r, _), n in got.items() if r == rep) == 300 for rep in range(1, 41))
        assert got == weights(families(spark, 300, 7), 40) != weights(families(spark, 300), 40, 6)
    assert resampling.totals(families(spark, 0), "base_id", [], "one", 5, 1).collect() == []


def test_counts_are_multinomial(spark, monkeypatch):
    """Mean one, variance 1 - 1/N, covariance -1/N, also between buckets of the tree."""
    monkeypatch.setattr(resampling, "BUCKET", 4)
    n, reps = 40, 3000
    got = weights(families(spark, n), reps)
    w = np.zeros((reps, n))
    for (rep, i), x in got.items():
        w[rep - 1, i] = x
    assert np.allclose(w.mean(0), 1, atol=6 / math.sqrt(reps))
    c = np.cov(w.T)
    assert abs(np.diag(c).mean() - (1 - 1 / n)) < 0.03
    assert abs(c[~np.eye(n, dtype=bool)].mean() + 1 / n) < 0.003
    assert abs((w == 0).mean() - (1 - 1 / n) ** n) < 0.01


def test_totals_are_those_of_the_weights(spark):
    rows = spark.range(500).select((F.col("id") % 70).alias("base_id"), (F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("v"))
    w = weights(rows.select("base_id", F.lit(1).alias("one")).distinct(), 20)
    want = {}
    for r in rows.collect():
        for rep in range(1, 21):
            want[rep, r["g"]] = want.get((rep, r["g"]), 0) + w.get((rep, r["base_id"]), 0) * r["v"]
    got = {(r["rep"], r["g"]): r["n"] for r in resampling.totals(rows, "base_id", ["g"], "v", 20, 5).collect()}
    assert got == {k: v for k, v in want.items() if v}


def event(total, drawn, inside, outside):
    if inside + outside > total or inside > drawn or outside > total - drawn:
        return 0.0
    return math.comb(total - inside - outside, drawn - inside) / math.comb(total, drawn)


def test_curves_are_the_sums_of_events(spark):
    hist = [(1, 4, 1, 0, 0, 5), (1, 4, 2, 1, 0, 3), (1, 3, 1, 1, 1, 9), (1, 2, 0, 0, 0, 4), (2, 4, 2, 2, 0, 1), (2, 2, 1, 0, 0, 2), (3, 2, 2, 1, 1, 7)]
    df = spark.createDataFrame(hist, "rep int, k int, pf long, gf long, cf long, n long")
    for r in resampled.curves(df, (0, 30, 100)).collect():
        mine = [h for h in hist if h[0] == r["rep"]]
        total = sum(h[1] * h[5] for h in mine)
        m = round(r["share"] * total / 100)
        units = sum(h[5] for h in mine)
        a = sum(n * event(total, m, pf, gf) for _, k, pf, gf, cf, n in mine if 0 < pf < k and gf and not cf)
        d = sum(n * (event(total, m, pf, 0) - event(total, m, k, 0)) for _, k, pf, gf, cf, n in mine if 0 < pf < k and not gf)
        assert r["total"] == total and math.isclose(r["introduced"], 100 * a / units, abs_tol=1e-9) and math.isclose(r["delayed"], 100 * d / units, abs_tol=1e-9)


def test_the_expected_curve_is_not_trivial(spark):
    """Total and drawn criteria are columns of their own: names that differ by case only are one column to Spark."""
    from tesserae.plans import estimation

    rows = [(t, s, t % 7, "p", "A", int((t * 7 + s * 5) % 6 > 0), int((t * 5 + s * 3) % 4 > 0), [1]) for t in range(60) for s in range(2 + t % 3)]
    frame = spark.createDataFrame(rows, "task_id long, slot int, base_id long, producer string, category string, gold int, prediction int, secondary array<int>")
    tasks = {}
    for t, s, _, _, _, g, p, _ in rows:
        tasks.setdefault(t, []).append((g, p))
    total = len(rows)
    for r in estimation.expected_update_curve(frame).collect():
        m = round(r["share"] * total / 100)
        a = d = 0.0
        for bits in tasks.values():
            k, pf, gf, cf = len(bits), sum(1 - p for _, p in bits), sum(1 - g for g, _ in bits), sum((1 - g) * (1 - p) for g, p in bits)
            if 0 < pf < k and gf and not cf:
                a += event(total, m, pf, gf)
            if 0 < pf < k and not gf:
                d += event(total, m, pf, 0) - event(total, m, k, 0)
        assert math.isclose(r["introduced"], a, abs_tol=1e-6) and math.isclose(r["delayed"], d, abs_tol=1e-6) and a > 0 and d > 0
