"""Operator 13 against runs found by looking at every period and place."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from tests.llm.helpers import clashing, documents, mixed

from tesserae.llm import runs


def brute_runs(words):
    n, spans = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                spans.setdefault((i, j + q - i), q)  # periods rise, so the first one is the smallest
            i = j + 1
    return sorted((s, length, q) for (s, length), q in spans.items())


def brute(doc_id, text, rewritten=True):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if rewritten and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    more = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
    return (doc_id, len(found), *more, digest, hashlib.sha256(kept).hexdigest())


def sequences(rng):
    def fibonacci(n):
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        return b[:n]

    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(5000))
    out = ["", "a", "aaaaa", "aaaaaa", "ab" * 3, "ab" * 4, "ab" * 4 + "a", "abc" * 4, "a" * 300, "ab" * 200 + "c" * 9 + "ab" * 7, fibonacci(400), thue]
    out += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    for _ in range(60):
        unit = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        out.append("".join(rng.choice("abcd") for _ in range(rng.randint(0, 20))) + unit * rng.randint(2, 9) + unit[: rng.randint(0, len(unit))] + "x" * rng.randint(0, 7) + (unit * 5) * 2)
    return out


def test_runs_are_those_of_every_period():
    rng = random.Random(3)
    for lot in (sequences(rng), ["ab" * 6], [""]):
        size = np.array([len(s) for s in lot], np.int64)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        symbols = np.array([1000 * d + ord(c) for d, s in enumerate(lot) for c in s], np.int64)
        doc, start, length, period = runs.find_runs(symbols, first, size)
        got = list(zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True))
        want = [(d, *r) for d, s in enumerate(lot) for r in brute_runs(s if len(s) < 2000 else s[:0])]
        long = {d for d, s in enumerate(lot) if len(s) >= 2000}  # the overlap-free sequence has no fourth power
        assert [g for g in got if g[0] not in long] == want
        assert not [g for g in got if g[0] in long]


def test_suffixes_extensions_and_minima():
    rng = random.Random(5)
    for n, letters in ((1, 2), (2, 1), (60, 1), (200, 2), (400, 5)):
        s = np.array([rng.randrange(letters) for _ in range(n)], np.int64)
        order, rank = runs.suffix_array(s)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist()) and rank[order].tolist() == list(range(n))
        e = runs.Extensions(s)
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n)][:: max(1, n // 40)]
        if pairs:
            i, j = np.array(pairs).T
            want = [next((k for k in range(n - b) if s[a + k] != s[b + k]), n - b) for a, b in pairs]
            assert e.of(i, j).tolist() == want


def test_grid_in_parts(monkeypatch):
    rng = random.Random(9)
    lot = ["a" * 500, "".join(rng.choice("ab") for _ in range(300)), "abc" * 100]
    size = np.array([len(s) for s in lot], np.int64)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    symbols = np.array([1000 * d + ord(c) for d, s in enumerate(lot) for c in s], np.int64)
    whole = [c.tolist() for c in runs.find_runs(symbols, first, size)]
    monkeypatch.setattr(runs, "CELLS", 32)
    assert [c.tolist() for c in runs.find_runs(symbols, first, size)] == whole


def test_digests(spark, tmp_path):
    rng = random.Random(11)
    texts = mixed() + [" ".join(s) for s in sequences(rng) if len(s) < 1000] + ["\x85   " * 9, " a\x0ba\x0ca\ta\r\na  a "]
    ids = list(range(100, 100 + len(texts)))
    docs = clashing(documents(spark, texts, ids=ids))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids) > 5
    assert got == {i: brute(i, t) for i, t in zip(ids, texts, strict=True)}


def test_odd_rows(spark):
    odd = documents(spark, ["a a a a a a b", "a a a a a a b", None, ""], ids=[None, None, 4, 4])
    got = sorted((str(r["doc_id"]), r["n_words"], len(r["runs"]), bytes(r["kept"])) for r in runs.periodic_runs(odd, runs.repeat_tail).collect())
    assert got == [("4", 0, 0, b""), ("4", 0, 0, b""), ("None", 7, 1, b"a b"), ("None", 7, 1, b"a b")]
    assert runs.periodic_runs(documents(spark, [])).collect() == []
    long = documents(spark, ["w " * 300_000 + " ".join(str(i) for i in range(100_000))], ids=[1])
    row = runs.periodic_runs(long).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 300_000, 1)] and len(row["kept"].split()) == 100_001
