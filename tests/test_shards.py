"""First fit under two caps: one range is a global pass; many ranges keep the caps and stay near it."""

import random

import pytest

from tesserae.functions.firstfit import Rooms
from tesserae.operators import shards


def plain(sizes, most_bytes, most_items):
    held, of = [], []
    for size in sizes:
        s = next((i for i, (b, c) in enumerate(held) if b + size <= most_bytes and c < most_items), None)
        if s is None:
            s = len(held)
            held.append((0, 0))
        held[s] = held[s][0] + size, held[s][1] + 1
        of.append(s)
    return of


def test_rooms_are_first_fit():
    rng = random.Random(1)
    for _ in range(200):
        most_bytes, most_items = rng.randint(1, 60), rng.randint(1, 6)
        sizes = [rng.randint(0, most_bytes) for _ in range(rng.randint(0, 80))]
        rooms = Rooms(most_bytes, most_items)
        assert [rooms.put(s) for s in sizes] == plain(sizes, most_bytes, most_items)


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r["shard"], []).append((r["place"], r["bytes"]))
    return out


@pytest.mark.parametrize("kind", ["even", "large", "small", "mixed"])
def test_ranges(spark, kind):
    rng = random.Random(2)
    size = {"even": lambda: rng.randint(1, 1000), "large": lambda: rng.randint(400, 1000), "small": lambda: rng.randint(1, 30), "mixed": lambda: rng.choice([5, 90, 333, 501, 999])}[kind]
    sizes = [size() for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "place long, bytes long")
    whole = shards.first_fit(df, 1000, 40).collect()
    one = plain(sizes, 1000, 40)
    first = {}
    for place, s in enumerate(one):
        first.setdefault(s, place)
    assert {r["place"]: r["shard"] for r in whole} == {p: first[s] for p, s in enumerate(one)}
    parts = shards.first_fit(df, 1000, 40, range_size=500, merged=3).collect()
    again = shards.first_fit(df.orderBy("bytes").repartition(5), 1000, 40, range_size=500, merged=3).collect()
    assert sorted(map(tuple, parts)) == sorted(map(tuple, again)) and len(parts) == 6000
    held = groups(parts)
    assert all(sum(b for _, b in g) <= 1000 and len(g) <= 40 and min(g)[0] == s for s, g in held.items())
    assert len(held) <= 1.05 * len(first)


def test_requests_over_the_cap_have_no_shard(spark):
    df = spark.createDataFrame([(0, 5), (1, 11), (2, 5), (3, 10)], "place long, bytes long")
    assert {r["place"]: r["shard"] for r in shards.first_fit(df, 10, 9).collect()} == {0: 0, 1: None, 2: 0, 3: 3}
    assert shards.first_fit(df.limit(0), 10, 9).collect() == []
