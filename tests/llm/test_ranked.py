"""Operator 12 against scores by their definition."""

import math
import random
import re
from collections import Counter

import numpy as np
from tests.llm.helpers import WORDS, clashing, documents, mixed

from tesserae.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counted = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(split(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def got(df):
    return [tuple(r) for r in df.orderBy("item_id", "rank").select("item_id", "rank", "doc_id", "score").collect()]


def corpus(rng, n):
    some = [w.upper() if rng.random() < 0.2 else w for w in WORDS[:40]]
    texts = mixed() + ["É é É-é", "İ ı İ", "don't 3.14 x_y"]
    while len(texts) < n:
        texts.append(" ".join(rng.choice(some) for _ in range(rng.randint(0, 40))))
    return texts + texts[40:80]  # repeats tie


def test_ranks(spark, monkeypatch):
    rng = random.Random(4)
    texts = corpus(rng, 300)
    items = [(j, " ".join(rng.choice(WORDS[:60]) for _ in range(rng.randint(1, 9)))) for j in range(12)] + [(50, "é İ x"), (51, None), (52, "..."), (53, "nowhere")]
    docs, asked = documents(spark, texts), clashing(spark.createDataFrame(items, "item_id long, text string"))
    want = brute(list(enumerate(texts)), items, 20)
    assert got(ranked.rank(clashing(docs).repartition(3), asked, 20)) == want
    for name, value in (("SEGMENT_DOCS", 70), ("LEAF", 3), ("FAN", 2), ("BLOCK_TERMS", 5), ("QUERY_TERMS", 30)):
        monkeypatch.setattr(ranked, name, value)
    assert got(ranked.rank(docs.coalesce(1), asked, 20)) == want


def test_odd_rows(spark):
    texts, ids = ["a b", "a b", "b c", None, "", "a"], [None, 7, 7, 1, 2, 3]
    items = spark.createDataFrame([(1, "A b"), (1, "A b"), (None, "c")], "item_id long, text string")
    assert got(ranked.rank(documents(spark, texts, ids=ids), items, 9)) == sorted(brute(list(zip(ids, texts, strict=True)), [(1, "a b"), (None, "c")], 9), key=lambda r: (r[0] is not None, r))
    assert got(ranked.rank(documents(spark, []), items)) == []
    assert got(ranked.rank(documents(spark, texts), items.limit(0))) == []
    long = documents(spark, ["w " * 400_000 + "rare", "w rare", "v"])
    assert got(ranked.rank(long, spark.createDataFrame([(1, "rare")], "item_id long, text string"))) == brute([(0, "w " * 400_000 + "rare"), (1, "w rare"), (2, "v")], [(1, "rare")], 50)


def test_ranges_that_tie_are_opened_and_low_ones_are_not():
    rng = np.random.default_rng(2)
    dense = rng.integers(0, 3, (4, 1000)).astype(np.int32)
    dense[:, 64:] //= 2
    ids, weights = rng.permutation(1000).astype(np.int64), np.array([5, 3, 2, 1])
    nothing = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    found, _, scores, opened = ranked.Ranges(ids, np.ones(1000, bool), dense).search(np.arange(4), weights, 10, nothing)
    order = np.lexsort((ids, -(weights @ dense)))[:10]
    assert found.tolist() == ids[order].tolist() and scores.tolist() == (weights @ dense)[order].tolist()
    high = dense.copy()
    high[:, 5] = 9
    assert ranked.Ranges(ids, np.ones(1000, bool), high).search(np.arange(4), weights, 1, nothing)[3] == 1 and 1 <= opened <= 16
