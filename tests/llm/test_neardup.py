"""Operator 1 against all pairs, and its sampling against the similarity it estimates."""

import math
import random
from collections import Counter

import numpy as np
from tests.llm.helpers import clashing, documents, mixed, prose, rows

from tesserae.llm import neardup, tiling


def tokens(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return tuple(tiling.tokens(data, np.array([0, len(data)]))[0].tolist())


def brute(texts, threshold=0.8):
    toks = [tokens(t) for t in texts]
    bags = [Counter(t[j : j + 5] for j in range(len(t) - 4)) if len(t) >= 5 else Counter([t]) if t else Counter() for t in toks]
    once = {t: b for t, b in zip(texts, bags, strict=True) if t}  # copies of a text count once
    n, many, df = len(texts), len(once), Counter(s for b in once.values() for s in b)
    w = [{s: c * (1 + math.log((1 + many) / (1 + df[s]))) for s, c in b.items()} for b in bags]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if toks[i] and toks[j]:
                low = sum(min(v, w[j].get(s, 0)) for s, v in w[i].items())
                if toks[i] == toks[j] or low / (sum(w[i].values()) + sum(w[j].values()) - low) >= threshold:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return sorted(((i, find(i)) for i in range(n)), key=repr)


def variants(seed, groups=6, size=12):
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = prose(rng, 200).split()
        for _ in range(size):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = prose(rng, 1) + str(rng.randrange(99))
            out.append(" ".join(t))
    return out


def test_classes_are_those_of_all_pairs(spark):
    texts = mixed() + variants(2)
    assert rows(neardup.classes(clashing(documents(spark, texts))), "doc_id", "class_id") == brute(texts)


def test_chunks_of_large_groups_are_compared_with_each_other(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 4)
    texts = variants(4, 2, 15)
    assert rows(neardup.classes(documents(spark, texts)), "doc_id", "class_id") == brute(texts)


def test_a_large_group_with_strays(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 16)
    rng = random.Random(9)
    base = prose(rng, 120).split()
    texts = []
    for k in range(150):  # copies with an edit each, and some with so many that they stand alone or with a few
        t = list(base)
        for _ in range(1 if k % 10 else 6):
            t[rng.randrange(len(t))] = f"w{rng.randrange(60)}"
        texts.append(" ".join(t))
    want = brute(texts)
    assert len({c for _, c in want}) > 1
    assert rows(neardup.classes(documents(spark, texts)), "doc_id", "class_id") == want


def test_a_forest_is_of_greatest_estimates():
    rng = np.random.default_rng(5)
    for n in (2, 5, 12, 40):
        i, j = np.array([(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5] or [(0, 1)]).T
        same = rng.integers(0, 6, len(i))
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        weight = 0
        for e in np.argsort(-same, kind="stable"):
            a, b = find(i[e]), find(j[e])
            if a != b:
                root[a], weight = b, weight + same[e]
        got = neardup._forest(n, i, j, same)
        assert same[got].sum() == weight and len(got) == n - len({find(x) for x in range(n)})


def test_repeated_and_missing_ids(spark):
    text = prose(random.Random(1), 50)
    got = rows(neardup.classes(documents(spark, [text, text, text, None], ids=[7, 7, None, None])), "doc_id", "class_id")
    assert got == sorted([(7, 7), (7, 7), (None, 7), (None, None)], key=repr)
    assert neardup.classes(documents(spark, [])).collect() == []


def test_short_texts_in_another_order_differ(spark):
    texts = ["a b c", "c a b", "A, b. C!", "b c", "c b", "x", "x x", "d e f g", "g f e d"] + [prose(random.Random(3), 40)]
    got = rows(neardup.classes(documents(spark, texts)), "doc_id", "class_id")
    assert got == brute(texts) == sorted([(i, 0 if i == 2 else i) for i in range(10)], key=repr)


def test_sampling_estimates_the_weighted_similarity():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    x, y = rng.uniform(0.5, 3, 60), rng.uniform(0.5, 3, 60)
    drawn = [neardup.sample(hashes, w, np.array([0, 60]), 4000)[0] for w in (x, y)]
    exact = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((drawn[0] == drawn[1]).mean() - exact) < 0.03


def _chunk_rows(n, chunks, chunk, classes):
    """The rows of one chunk of a group of n texts: those at home there, and copies of all minor ones."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    comp = np.arange(n) if classes is None else classes
    samples = rng.integers(0, 1 << 16, (n, 80)).astype(np.uint16)
    samples[:, :4] = 7  # the band in which they meet
    counts = np.unique(comp, return_counts=True)
    major = counts[0][counts[1].argmax()]
    home, minor = np.arange(n) % chunks == chunk, comp != major
    rows = np.flatnonzero(home | minor)
    size = len(rows)
    table = {"band": np.zeros(size, np.int64), "chunk": np.full(size, chunk), "text_key": rows * 3 - n, "weight": np.full(size, 100.0), "shared": np.full(size, 90.0), "comp": comp[rows], "home": home[rows], "minor": minor[rows]}
    return pa.table({**{k: pa.array(v) for k, v in table.items()}, "samples": pa.array([samples[r].tobytes() for r in rows], pa.binary())}), int(home.sum()), int(minor.sum())


def test_each_pair_is_looked_at_once(monkeypatch):
    """10,000 single texts in a group: all chunks together look at n * n / 2 pairs, a chunk at no more than home times minor ones."""
    import numpy as np

    looked, plain = [], neardup._pairs
    monkeypatch.setattr(neardup, "_pairs", lambda start, many, most: looked.append(int(many.sum())) or plain(start, np.zeros_like(many), most))
    n, chunks = 10_000, 5
    for chunk in range(chunks):
        rows, home, minor = _chunk_rows(n, chunks, chunk, None)
        neardup._candidates(None, rows, 0.8, 4, True)
        assert looked[-1] <= home * minor
    assert sum(looked) == n * (n - 1) // 2


def test_chunks_meet_all_pairs_of_different_classes(monkeypatch):
    import numpy as np

    rng, n, chunks = np.random.default_rng(6), 60, 3
    classes = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 20, n))
    seen, plain = [], neardup._pairs
    for chunk in range(chunks):
        rows, *_ = _chunk_rows(n, chunks, chunk, classes)
        sorted_rows = rows.sort_by([("band", "ascending"), ("chunk", "ascending"), ("minor", "descending"), ("text_key", "ascending")])
        keys = np.asarray(sorted_rows["text_key"])
        monkeypatch.setattr(neardup, "_pairs", lambda s, m, most, keys=keys: [seen.append((keys[i], keys[j])) for a, b in plain(s, m, most) for j, i in zip(a, b, strict=True)] and iter(()))
        neardup._candidates(None, rows, 0.8, 4, True)
    key = lambda r: r * 3 - n
    want = {frozenset((key(a), key(b))) for a in range(n) for b in range(a) if classes[a] != classes[b]}
    got = [frozenset(p) for p in seen]
    assert want <= set(got) and len(got) == len(set(got))


def test_copies_of_a_large_group_stay_together(spark):
    """160 copies of a text with two edits each, among 500 other texts: pairs share 0.83 of their shingles. Levelled, they are of one class."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(220)]
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(500)]
    for k in range(160):
        t = list(base)
        t[10 + k % 90], t[110 + (7 * k) % 100] = f"x{k}", f"y{k}"
        texts.append(" ".join(t))
    of = dict(rows(neardup.classes(documents(spark, texts), level=True), "doc_id", "class_id"))
    assert {of[i] for i in range(500, 660)} == {500} and all(of[i] == i for i in range(500))
    plain = dict(rows(neardup.classes(documents(spark, texts)), "doc_id", "class_id"))
    assert len({plain[i] for i in range(500, 660)}) > 1


def test_levelled_weights_leave_shared_shingles_alone():
    weight, times = np.array([2.0, 9.0, 6.0, 9.0]), np.array([1, 1, 2, 1])
    got = neardup.levelled(weight, times, np.array([True, False, True, False]), np.array([0, 0, 0, 1]), 2)
    assert got.tolist() == [2.0, 8 / 3, 6.0, 9.0]
