"""Integer problems over types against enumeration."""

import itertools
import random

from tesserae.functions import integer


def best(room, vectors, counts):
    most = 0
    for x in itertools.product(*(range(n + 1) for n in counts)):
        if sum(x) > most and all(sum(a * v[g] for a, v in zip(x, vectors, strict=True)) <= r for g, r in enumerate(room)):
            most = sum(x)
    return most


def world(rng, groups=None, most=4):
    groups = groups or rng.randint(1, 4)
    vectors = [[rng.randint(0, 3) for _ in range(groups)] for _ in range(rng.randint(0, 4))]
    counts = [rng.randint(1, most) for _ in vectors]
    return [rng.randint(0, 12) for _ in range(groups)], vectors, counts


def test_most_is_that_of_enumeration():
    rng = random.Random(1)
    for _ in range(600):
        room, vectors, counts = world(rng)
        x, bound = integer.most(room, vectors, counts)
        assert all(0 <= a <= n for a, n in zip(x, counts, strict=True))
        assert all(sum(a * v[g] for a, v in zip(x, vectors, strict=True)) <= r for g, r in enumerate(room))
        assert sum(x) == bound == best(room, vectors, counts)


def test_most_of_many_types_is_proven():
    rng = random.Random(2)
    for size in (10, 10**4, 10**9):
        vectors = [v for v in itertools.product(range(5), repeat=6) if sum(v) == 4]
        counts = [rng.randint(1, size) for _ in vectors]
        slots = [sum(n * v[g] for n, v in zip(counts, vectors, strict=True)) for g in range(6)]
        room = [s * rng.randint(5, 99) // 100 for s in slots]
        x, bound = integer.most(room, vectors, counts)
        assert sum(x) == bound
        assert all(sum(a * v[g] for a, v in zip(x, vectors, strict=True)) <= r for g, r in enumerate(room))


def test_a_search_that_ends_early_states_its_bound(monkeypatch):
    monkeypatch.setattr(integer, "MOST_NODES", 0)
    rng = random.Random(3)
    for _ in range(100):
        room, vectors, counts = world(rng)
        x, bound = integer.most(room, vectors, counts)
        assert sum(x) <= best(room, vectors, counts) <= bound


def test_spread_attains_the_deficiency_bound():
    rng = random.Random(4)
    for _ in range(600):
        supply, vectors, counts = world(rng, most=9)
        flow = integer.spread(supply, vectors, counts)
        assert all(sum(f) <= n and all(a >= 0 and (not a or v[g]) for g, a in enumerate(f)) for f, n, v in zip(flow, counts, vectors, strict=True))
        assert all(sum(f[g] for f in flow) <= s for g, s in enumerate(supply))
        groups = range(len(supply))
        least = min(sum(s for g, s in enumerate(supply) if g not in sub) + sum(n for v, n in zip(vectors, counts, strict=True) if any(v[g] for g in sub)) for size in range(len(supply) + 1) for sub in itertools.combinations(groups, size))
        assert sum(map(sum, flow)) == least


def test_search_goes_down_among_equal_bounds(monkeypatch):
    """57 types whose maximum the bound reaches: 60 nodes prove it, which a search through all nodes of a bound in turn doesn't."""
    monkeypatch.setattr(integer, "MOST_NODES", 60)
    rng, counts, room = random.Random(50), {}, [0] * 5
    for _ in range(80):
        v = [0] * 5
        for _ in range(6):
            g = rng.randrange(5)
            v[g] += 1
            room[g] += rng.random() < 0.85
        counts[tuple(v)] = counts.get(tuple(v), 0) + 1
    vectors = sorted(counts)
    taken, bound = integer.most(room, [list(v) for v in vectors], [counts[v] for v in vectors])
    assert sum(taken) == bound == 68
    assert all(0 <= t <= counts[v] for t, v in zip(taken, vectors, strict=True))
    assert all(sum(t * v[g] for t, v in zip(taken, vectors, strict=True)) <= room[g] for g in range(5))
