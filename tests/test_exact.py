"""Exact arithmetic against enumeration."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.functions import exact


def tail(population, successes, drawn, at_least):
    ways = sum(math.comb(successes, j) * math.comb(population - successes, drawn - j) for j in range(max(at_least, 0), min(drawn, successes) + 1) if drawn - j <= population - successes)
    return Fraction(ways, math.comb(population, drawn))


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 40), st.data())
def test_interval(population, data):
    drawn = data.draw(st.integers(0, population))
    seen = data.draw(st.integers(0, drawn))
    level = Fraction("0.05") / 2
    good = [k for k in range(seen, population - drawn + seen + 1) if tail(population, k, drawn, seen) >= level and 1 - tail(population, k, drawn, seen + 1) >= level]
    assert exact.interval(population, drawn, seen) == (good[0], good[-1])


def test_interval_of_large_counts():
    low, high = exact.interval(60_000, 3_000, 2_500)
    assert low < 50_000 < high and high - low < 2_000
    with pytest.raises(ValueError):
        exact.interval(5, 6, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 5)), min_size=1, max_size=5), st.data())
def test_waterfill(strata, data):
    caps, weights = [c for c, _ in strata], [float(w) for _, w in strata]
    total = data.draw(st.integers(0, sum(caps)))
    out = exact.waterfill(total, weights, caps)
    assert sum(out) == total and all(0 <= x <= c for x, c in zip(out, caps, strict=True))


def test_waterfill_by_hand():
    assert exact.waterfill(10, [1, 1], [100, 100]) == [5, 5]
    assert exact.waterfill(10, [3, 1], [4, 100]) == [4, 6]
    assert exact.waterfill(3, [1, 1], [5, 5]) == [2, 1]
    assert exact.waterfill(4, [0.0, 1.0], [5, 2]) == [2, 2]
    with pytest.raises(ValueError):
        exact.waterfill(9, [1], [5])


def test_design_variance_by_enumeration():
    sizes, correct, cap = [6, 5], [4, 1], 7
    pilot = exact.pilot_sizes(sizes, cap)
    pools = [[1] * k + [0] * (n - k) for n, k in zip(sizes, correct, strict=True)]
    total, mass = 0.0, 0
    for pick in itertools.product(*(itertools.combinations(range(n), a) for n, a in zip(sizes, pilot, strict=True))):
        seen = [sum(pools[h][i] for i in pick[h]) for h in range(2)]
        counts = exact.neyman(cap, sizes, pilot, seen)
        rest = [[pools[h][i] for i in range(sizes[h]) if i not in pick[h]] for h in range(2)]
        v = 0.0
        for h in range(2):
            means = [sum(c) / counts[h] for c in itertools.combinations(rest[h], counts[h])]
            mean = sum(means) / len(means)
            v += (len(rest[h]) / sum(sizes)) ** 2 * sum((m - mean) ** 2 for m in means) / len(means)
        total += v
        mass += 1
    lengths = [len(exact.support(n, k, a)[1]) for n, k, a in zip(sizes, correct, pilot, strict=True)]
    got, outcomes, whole = exact.pilot_terms(sizes, correct, cap, [(0, n) for n in lengths])
    assert got == pytest.approx(total / mass) and whole == pytest.approx(1) and outcomes > 1
    assert exact.known_variance(sizes, correct, 11, "random") == 0 and exact.known_variance(sizes, correct, cap, "charged_neyman") is None


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.data())
def test_support_is_the_distribution(population, data):
    successes, drawn = data.draw(st.integers(0, population)), data.draw(st.integers(0, population))
    first, p, outside = exact.support(population, successes, drawn)
    want = [math.comb(successes, t) * math.comb(population - successes, drawn - t) / math.comb(population, drawn) for t in range(max(0, drawn + successes - population), min(drawn, successes) + 1)]
    assert first == max(0, drawn + successes - population) and p == pytest.approx(want) and outside == 0


def test_support_of_large_counts():
    first, p, outside = exact.support(10**10, 7 * 10**9, 10**8)
    mean = first + float((np.arange(len(p)) * p).sum())
    assert mean == pytest.approx(7 * 10**7, rel=1e-9) and math.fsum(p) == pytest.approx(1) and outside < 1e-30 and len(p) < 10**6
    low, high = exact.interval(10**8, 10**6, 700_000)
    assert 0 < 7 * 10**7 - low < 10**6 and 0 < high - 7 * 10**7 < 10**6
    assert exact._by_scaled_terms(60_000, 50_000, 3_000, 2_500, Fraction(1, 2)) == (tail(60_000, 50_000, 3_000, 2_500) >= Fraction(1, 2))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.floats(0.01, 9)), min_size=1, max_size=4), st.data())
def test_waterfill_of_many_is_that_of_each(strata, data):
    caps = [c for c, _ in strata]
    least = [int(c > 0) for c in caps]
    total = data.draw(st.integers(sum(least), sum(caps)))
    rows = [[w * f for (_, w), f in zip(strata, data.draw(st.lists(st.floats(0.1, 3), min_size=len(caps), max_size=len(caps))), strict=True)] for _ in range(3)]
    got = exact.waterfill_many(total, np.array(rows), caps, least)
    assert got.tolist() == [exact.waterfill(total, r, caps, least) for r in rows]


def test_design_variances_at_any_size(spark):
    from tesserae.plans import estimation

    def by_outcomes(sizes, correct, cap):
        pilot = exact.pilot_sizes(sizes, cap)
        total = sum(sizes)
        out = 0.0
        for t in itertools.product(*(range(max(0, a - n + k), min(a, k) + 1) for n, k, a in zip(sizes, correct, pilot, strict=True))):
            p = math.prod(math.comb(k, x) * math.comb(n - k, a - x) / math.comb(n, a) for n, k, a, x in zip(sizes, correct, pilot, t, strict=True))
            rest = [n - a for n, a in zip(sizes, pilot, strict=True)]
            counts = exact.neyman(cap, sizes, pilot, list(t))
            out += p * sum((n / total) ** 2 * exact.mean_variance(n, k - x, c) for n, k, x, c in zip(rest, correct, t, counts, strict=True) if n)
        return out

    worlds = {"a": ([3000, 9000], [2000, 8500]), "b": ([700, 1300], [10, 1299]), "c": ([5_000_000, 7_000_000], [4_000_000, 6_500_000]), "d": ([400, 0], [380, 0])}
    strata = spark.createDataFrame([(w, h, n, k) for w, (ns, ks) in worlds.items() for h, (n, k) in enumerate(zip(ns, ks, strict=True)) if n], "producer string, prediction int, size long, correct long")
    got = {(r["producer"], r["design"]): r for r in estimation.design_variances(strata, 100).collect()}
    for w in "ab":
        sizes, correct = worlds[w]
        assert got[w, "charged_neyman"]["variance"] == pytest.approx(by_outcomes(sizes, correct, sum(sizes) // 100), rel=1e-9)
    big = {d: got["c", d]["variance"] for d in ("random", "proportional", "charged_neyman")}
    assert got["c", "charged_neyman"]["outcomes"] > 10**6 and got["c", "charged_neyman"]["tail"] < 1e-30
    assert big["proportional"] < big["random"] and big["charged_neyman"] < 1.3 * big["proportional"]


def test_event_by_subsets(spark):
    from pyspark.sql import functions as F

    cases = [(n, m, r, f) for n in range(1, 7) for m in range(n + 1) for r in range(4) for f in range(4)]
    got = spark.createDataFrame(cases, "n int, m int, r int, f int").select("*", exact.event(F.col("n"), F.col("m"), F.col("r"), F.col("f")).alias("p")).collect()
    for x in got:
        n, m, r, f = x["n"], x["m"], x["r"], x["f"]
        if r + f > n:
            assert x["p"] == 0
        else:
            hits = [set(range(r)) <= set(c) and not set(range(r, r + f)) & set(c) for c in itertools.combinations(range(n), m)]
            assert x["p"] == pytest.approx(sum(hits) / len(hits))
