"""Exact finite-population arithmetic: event probabilities, hypergeometric intervals, integer allocations, design variances."""

from __future__ import annotations

import math
from bisect import bisect_left
from fractions import Fraction
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def event(total: Column, drawn: Column, inside: Column, outside: Column) -> Column:
    """Chance that a uniform draw of `drawn` of `total` items holds `inside` given ones and none of `outside` others.

    Empty products are guarded, as a sequence from 0 to -1 counts down.
    """
    m, n, r, f = (c.cast("double") for c in (drawn, total, inside, outside))

    def falling(count: Column, top: Column, bottom: Column) -> Column:
        steps = F.sequence(F.lit(0), F.greatest(count.cast("int") - 1, F.lit(0)))
        return F.when(count == 0, F.lit(1.0)).otherwise(F.aggregate(steps, F.lit(1.0), lambda a, j: a * (top - j) / (bottom - j)))

    none = (inside + outside > total) | (inside > drawn) | (outside > total - drawn)
    return F.when(none, F.lit(0.0)).otherwise(falling(inside, m, n) * falling(outside, n - m, n - r))


def event_sql(total: str, drawn: str, inside: str, outside: str) -> str:
    part = lambda top, bottom, count: f"coalesce(list_product([(({top}) - j)::DOUBLE / (({bottom}) - j) FOR j IN range(CAST({count} AS BIGINT))]), 1.0)"
    return f"""(CASE WHEN ({inside}) + ({outside}) > ({total}) OR ({inside}) > ({drawn}) OR ({outside}) > ({total}) - ({drawn}) THEN 0.0
        ELSE {part(drawn, total, inside)} * {part(f'({total}) - ({drawn})', f'({total}) - ({inside})', outside)} END)"""


#: Chances below e**-FLOOR of the largest are left out of sums; what that can miss is bounded with them.
FLOOR = 90.0


def support(population: int, successes: int, drawn: int) -> tuple[int, np.ndarray, float]:
    """The chances of a hypergeometric count around its mode: the first count, their values, and a bound on what lies outside.

    Neighbours follow from each other by their ratio, so nothing as large as a binomial coefficient is formed. Beyond the ends ratios
    fall, so what is left out is less than a geometric series.
    """
    low, high = max(0, drawn + successes - population), min(drawn, successes)
    mode = min(high, max(low, (drawn + 1) * (successes + 1) // (population + 2)))
    share = successes / population if population else 0.0
    radius = int(14 * math.sqrt(max(1.0, drawn * share * (1 - share)))) + 60

    def ratios(start: int, end: int) -> np.ndarray:
        """Of the chance of t + 1 to that of t, for t from start to end - 1."""
        t = np.arange(start, end, dtype=np.float64)
        return (successes - t) * (drawn - t) / ((t + 1) * (population - successes - drawn + t + 1))

    while True:
        first, last = max(low, mode - radius), min(high, mode + radius)
        logs = np.concatenate([-np.cumsum(np.log(ratios(first, mode))[::-1])[::-1], [0.0], np.cumsum(np.log(ratios(mode, last)))])
        if (first == low or logs[0] < -FLOOR) and (last == high or logs[-1] < -FLOOR):
            break
        radius *= 2
    p = np.exp(logs)
    outside = 0.0
    for end, there, step in ((0, first == low, None if first == low else 1 / ratios(first - 1, first)[0]), (-1, last == high, None if last == high else ratios(last, last + 1)[0])):
        if not there:
            outside += p[end] * step / (1 - step) if step < 1 else 1.0
    whole = math.fsum(p) + outside
    return first, p / whole, outside / whole


def upper_tail_at_least(population: int, successes: int, drawn: int, seen: int, level: Fraction) -> bool:
    """Whether P(X >= seen) >= level for a hypergeometric X; by floats where they are clear, by whole numbers where they aren't."""
    low, high = max(0, drawn + successes - population), min(drawn, successes)
    if seen <= low:
        return True
    if seen > high:
        return False
    first, p, _ = support(population, successes, drawn)
    at = min(max(0, seen - first), len(p))
    # the shorter tail is summed
    value = math.fsum(p[at:]) if len(p) - at <= at else 1 - math.fsum(p[:at])
    if abs(value - float(level)) > 1e-9 + 1e-7 * float(level):
        return value >= level
    if population > 5000:
        clear = _by_scaled_terms(population, successes, drawn, seen, level)
        if clear is not None:
            return clear
    ways = sum(math.comb(successes, j) * math.comb(population - successes, drawn - j) for j in range(seen, high + 1))
    return Fraction(ways, math.comb(population, drawn)) >= level


def _by_scaled_terms(population: int, successes: int, drawn: int, seen: int, level: Fraction, bits: int = 400) -> bool | None:
    """The same from the terms as multiples of 2**-bits of the largest, by ratios of neighbours; None where rounding could decide."""
    low, high = max(0, drawn + successes - population), min(drawn, successes)
    mode = min(high, max(low, (drawn + 1) * (successes + 1) // (population + 2)))
    upper = whole = steps = 0
    for step in (1, -1):
        t, term = mode, 1 << bits
        while low <= t <= high and term:
            if step == 1 or t != mode:
                whole += term
                upper += term if t >= seen else 0
                steps += 1
            if step == 1:
                term = term * (successes - t) * (drawn - t) // ((t + 1) * (population - successes - drawn + t + 1))
            else:
                term = term * t * (population - successes - drawn + t) // ((successes - t + 1) * (drawn - t + 1))
            t += step
    error = steps * steps + high - low  # each term is low by less than its distance from the mode; those left out are below one
    if upper * level.denominator >= (whole + error) * level.numerator:
        return True
    if (upper + error) * level.denominator < whole * level.numerator:
        return False
    return None


@lru_cache(maxsize=100_000)
def interval(population: int, drawn: int, seen: int, alpha: str = "0.05") -> tuple[int, int]:
    """All success totals that neither tail rejects at alpha / 2 each, tails equal to it included; they are a range."""
    if not 0 <= seen <= drawn <= population:
        raise ValueError("impossible observation")
    level = Fraction(alpha) / 2
    totals = range(seen, population - drawn + seen + 1)
    first = bisect_left(totals, True, key=lambda k: upper_tail_at_least(population, k, drawn, seen, level))
    # P(X <= seen) is the upper tail of the failures
    last = bisect_left(totals, True, key=lambda k: not upper_tail_at_least(population, population - k, drawn, drawn - seen, level))
    return totals[first], totals[last - 1]


def waterfill(total: int, weights: list[float], capacities: list[int], least: list[int] | None = None) -> list[int]:
    """Whole numbers between least and capacities that sum to total: least + level * weight up to the capacity, by largest remainders.

    The level solves the sum: strata fill up in the order of room over weight. Strata without weight share alike once the others
    are full.
    """
    least = [0] * len(capacities) if least is None else least
    if not (sum(least) <= total <= sum(capacities) and all(0 <= a <= c for a, c in zip(least, capacities, strict=True)) and all(w >= 0 for w in weights)):
        raise ValueError("impossible allocation")
    value = [float(a) for a in least]
    left = total - sum(least)
    for group in ([h for h, w in enumerate(weights) if w > 0], [h for h, w in enumerate(weights) if w == 0]):
        rate = {h: weights[h] or 1.0 for h in group}
        todo = sorted((h for h in group if capacities[h] > least[h]), key=lambda h: (capacities[h] - least[h]) / rate[h])
        while todo and left > 0:
            level = left / sum(rate[h] for h in todo)
            h = todo[0]
            if level * rate[h] < capacities[h] - least[h]:
                for h in todo:
                    value[h] += level * rate[h]
                left = 0
            else:
                value[h] = float(capacities[h])
                left -= capacities[h] - least[h]
                todo.pop(0)
    whole = [math.floor(v + 1e-9) for v in value]
    short = total - sum(whole)
    for h in sorted((h for h in range(len(whole)) if whole[h] < capacities[h]), key=lambda h: (whole[h] - value[h], h))[:short]:
        whole[h] += 1
    return whole


def pilot_sizes(sizes: list[int], cap: int) -> list[int] | None:
    """Charged pilot: two of each stratum, a fifth of the budget in all, one left for each stratum that isn't used up; None if too dear."""
    # the rule is fixed: other sizes would give other variances
    two = [min(2, n) for n in sizes]
    later = sum(n > b for n, b in zip(sizes, two, strict=True))
    if cap < sum(two) + later:
        return None
    room = [n if n <= 2 else n - 1 for n in sizes]
    return waterfill(min(max(sum(two), cap // 5), cap - later, sum(room)), [float(n) for n in sizes], room, two)


def mean_variance(population: int, successes: int, drawn: int) -> float:
    """Variance of a binary sample mean without replacement."""
    if drawn == population:
        return 0.0
    return (population - drawn) * successes * (population - successes) / (drawn * population**2 * (population - 1))


def neyman(cap: int, sizes: list[int], pilot: list[int], agreed: list[int]) -> list[int]:
    """What is left of the budget after the pilot, by size and smoothed spread of each stratum."""
    rest = [n - a for n, a in zip(sizes, pilot, strict=True)]
    rates = [(t + 0.5) / (a + 1) for t, a in zip(agreed, pilot, strict=True)]
    return waterfill(cap - sum(pilot), [n * math.sqrt(r * (1 - r)) for n, r in zip(rest, rates, strict=True)], rest, [int(n > 0) for n in rest])


def waterfill_many(total: int, weights: np.ndarray, capacities: list[int], least: list[int]) -> np.ndarray:
    """waterfill() for rows of weights, all over zero where there is room. Numbers of strata are few, rows may be many."""
    n, strata = weights.shape
    room = np.array(capacities, np.float64) - np.array(least, np.float64)
    value = np.broadcast_to(np.array(least, np.float64), (n, strata)).copy()
    rate = np.where(room > 0, weights, 1.0)
    todo = np.broadcast_to(room > 0, (n, strata)).copy()
    left = np.full(n, float(total - sum(least)))
    order = np.argsort(np.where(todo, room / rate, np.inf), axis=1, kind="stable")
    for step in range(strata):
        h = order[:, step]
        row = np.arange(n)
        live = todo[row, h] & (left > 0)
        level = np.divide(left, np.where(todo, rate, 0).sum(1), out=np.zeros(n), where=live)
        ends = live & (level * rate[row, h] < room[h])
        value += np.where(ends[:, None] & todo, level[:, None] * rate, 0)
        left = np.where(ends, 0.0, left)
        fills = live & ~ends
        value[row[fills], h[fills]] = np.array(capacities, np.float64)[h[fills]]
        left = np.where(fills, left - room[h], left)
        todo[row[fills], h[fills]] = False
    whole = np.floor(value + 1e-9).astype(np.int64)
    short = total - whole.sum(1)
    lack = np.where(whole < np.array(capacities), whole - value, np.inf)
    place = np.argsort(np.argsort(lack, axis=1, kind="stable"), axis=1, kind="stable")
    return whole + (place < short[:, None])


def known_variance(sizes: list[int], correct: list[int], cap: int, design: str) -> float | None:
    """Exact variance of the agreement estimate under a design; None for the charged allocation, whose pilot's outcomes must be summed."""
    total = sum(sizes)
    plain = mean_variance(total, sum(correct), cap)
    if cap == total or design == "random" or (design == "charged_neyman" and pilot_sizes(sizes, cap) is None):
        return plain
    if design == "proportional":
        if cap < len(sizes):
            return plain
        counts = waterfill(cap, [float(n) for n in sizes], sizes, [1] * len(sizes))
        return math.fsum((n / total) ** 2 * mean_variance(n, k, c) for n, k, c in zip(sizes, correct, counts, strict=True) if n)
    return None


def pilot_terms(sizes: list[int], correct: list[int], cap: int, first: list[tuple[int, int]]) -> tuple[float, int, float]:
    """Of the outcomes of a charged pilot whose counts lie in ranges, a range for each stratum: their part of the variance, number, mass.

    Ranges count from the first count of each stratum's support(). The ranges of all strata together must hold few enough outcomes.
    """
    total, pilot = sum(sizes), pilot_sizes(sizes, cap)
    axes, chances = [], []
    for n, k, a, (lo, hi) in zip(sizes, correct, pilot, first, strict=True):
        start, p, _ = support(n, k, a)
        axes.append(np.arange(start + lo, start + min(hi, len(p))))
        chances.append(p[lo:hi])
    seen = np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")], 1)
    p = np.prod(np.stack([g.ravel() for g in np.meshgrid(*chances, indexing="ij")], 1), axis=1)
    a, rest = np.array(pilot), np.array(sizes) - np.array(pilot)
    rates = (seen + 0.5) / (a + 1)
    counts = waterfill_many(cap - int(a.sum()), rest * np.sqrt(rates * (1 - rates)), rest.tolist(), [int(n > 0) for n in rest.tolist()])
    n, k, c = rest.astype(np.float64), (np.array(correct) - seen).astype(np.float64), counts.astype(np.float64)
    open_ = (c < n) & (n > 1)
    variance = np.where(open_, (n - c) * k * (n - k) / np.where(open_, c * n * n * (n - 1), 1), 0.0)
    return float(p @ (variance * (n / total) ** 2).sum(1)), len(p), float(p.sum())
