"""Operators 2 and 7 against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.helpers import clashing, documents, mixed, prose, rows

from tesserae.llm import common, substring, suffixes


def brute_words(texts, window):
    docs = [(t or "").encode().split() for t in texts]
    seen, out = set(), []
    order = sorted(range(len(docs)), key=lambda i: i)
    gone = [set() for _ in docs]
    for i in order:
        for s in range(len(docs[i]) - window + 1):
            key = tuple(docs[i][s : s + window])
            if key in seen:
                gone[i].update(range(s, s + window))
            seen.add(key)
    for i, ws in enumerate(docs):
        out.append((i, len(ws), len(gone[i]), b" ".join(w for j, w in enumerate(ws) if j not in gone[i]).decode()))
    return sorted(out, key=repr)


def brute_bytes(texts, length):
    docs = [(t or "").encode() for t in texts]
    count = Counter(d[s : s + length] for d in docs for s in range(len(d) - length + 1))
    out = []
    for i, d in enumerate(docs):
        hit = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if count[d[s : s + length]] > 1:
                hit[s : s + length] = b"\1" * length
        spans = sum(hit[j] and (j == 0 or not hit[j - 1]) for j in range(len(d)))
        out.append((i, len(d), sum(hit), spans, bytes(x for x, h in zip(d, hit) if not h)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [20, 40])
def test_words(spark, window):
    texts = mixed()
    out = substring.remove_repeats(clashing(documents(spark, texts)), window)
    assert rows(out, "doc_id", "n_words", "n_removed", "kept_text") == brute_words(texts, window)


def test_words_of_one_document_and_repeated_rows(spark):
    rng = random.Random(3)
    p = prose(rng, 30)
    texts = [p + " " + p + " " + p, p]
    assert rows(substring.remove_repeats(documents(spark, texts)), "doc_id", "n_words", "n_removed", "kept_text") == brute_words(texts, 20)
    twice = documents(spark, [p, p], ids=[5, 5])
    assert sorted(r["n_removed"] for r in substring.remove_repeats(twice).collect()) == [0, 30]
    texts = [p + f" {i}" for i in range(6)]  # one id, several texts: all but one lose the passage, or all of a null id
    for i in (5, None):
        assert sorted(r["n_removed"] for r in substring.remove_repeats(documents(spark, texts, ids=[i] * 6)).collect()) == [0] + [30] * 5
    alone = documents(spark, [p, p], ids=[None, 5])
    assert {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(alone).collect()} == {None: 0, 5: 30}


def test_window_must_double():
    with pytest.raises(ValueError):
        substring._short_lengths(21, 5)


@pytest.mark.parametrize("length", [400, 64, 100])
def test_bytes(spark, length):
    texts = mixed(11)
    out = suffixes.remove_repeats(clashing(documents(spark, texts)), length)
    assert rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == brute_bytes(texts, length)


def test_passages_of_just_under_and_over_400_bytes(spark):
    """Passages of over 50 words that repeat, some of 390 to 410 bytes: only those of 400 and more are repeats by the contract."""
    rng = random.Random(15)
    texts, under, over = [], [], []
    for size in [*range(390, 411), 500, 700]:
        passage = prose(rng, 120).encode()[:size].decode()
        assert len(passage.split()) > 50
        (over if size >= 400 else under).extend((len(texts), len(texts) + 1))
        # other bytes on either side, so that a repeat is the passage and no more
        texts += [prose(rng, 30) + a + passage + b + prose(rng, 30) for a, b in ("<>", "()")]
    got = rows(suffixes.remove_repeats(documents(spark, texts)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert got == brute_bytes(texts, 400)
    removed = {r[0]: r[2] for r in got}
    assert all(removed[i] > 0 for i in over) and not any(removed[i] for i in under)


def test_bytes_with_shared_edges(spark):
    rng = random.Random(5)
    passage = prose(rng, 40)
    texts = [prose(rng, 3)[: rng.randint(1, 9)] + passage[: rng.randint(150, len(passage))] + prose(rng, 5) for _ in range(30)]
    out = suffixes.remove_repeats(documents(spark, texts), 128)
    assert rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == brute_bytes(texts, 128)


def test_windows_are_judged_by_the_array():
    """Equal strings of two blocks, a string alone with its core, and two strings that share their left side and two bytes after the core."""
    side = lambda s: np.frombuffer(s.ljust(7, b"\0") + b"\0", np.uint64)[0]
    sent = [
        [(1, b"abcdefg", b"hijklmn"), (2, b"abcdefg", b"hijklmn"), (3, b"abcdefg", b"hixxxxx")],
        [(1, b"abcdefg", b"hijklmn"), (3, b"abcdefg", b"hiyyyyy")],
    ]
    out = []
    for block, strings in enumerate(sent):
        core, left, right = (np.array([f(s) for s in strings], np.uint64) for f in (lambda s: s[0], lambda s: side(s[1]), lambda s: side(s[2])))
        out += common.send(block, np.zeros(len(strings), np.int32), 1, core, left, right, np.zeros(len(strings), np.uint8))
    judged = suffixes._judge_windows((pa.scalar(0),), common.packed_rows(out))
    assert [list(p) for p in judged["payload"].to_pylist()] == [[255, 0, 7], [255, 7]]


@pytest.mark.parametrize("hot", [2, 40])
def test_frequent_cores_are_split(spark, hot):
    """A footer amid surroundings that agree for some bytes: equal to brute force, whether its strings are split or not."""
    rng = random.Random(23)
    footer = prose(rng, 60)
    edges = ["", "a", "ba", "cba", "xcba", "yxcba", "zyxcba", "qzyxcba"]
    texts = [prose(rng, rng.randint(0, 4)) + "." + rng.choice(edges) + footer[rng.randint(0, 3) :] + rng.choice(edges)[::-1] + "." + prose(rng, rng.randint(0, 4)) for _ in range(120)] + mixed(12)
    out = suffixes.remove_repeats(documents(spark, texts), 96, hot=hot)
    assert rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == brute_bytes(texts, 96)


def test_arrays_hold_whole_cores(monkeypatch):
    """Strings of a bucket judged in arrays of a few give what one array gives."""
    rng = np.random.default_rng(3)
    n = 4000
    core = rng.integers(0, 300, n).astype(np.uint64)
    left, right = ((rng.integers(0, 3, (n, 8)) + 65).astype(np.uint8) for _ in range(2))
    left[:, 7] = right[:, 7] = 0
    payload = common.packed_rows(common.send(0, np.zeros(n, np.int32), 1, core, left.view(np.uint64)[:, 0], right.view(np.uint64)[:, 0], np.zeros(n, np.uint8)))
    whole = suffixes._judge_windows((pa.scalar(0),), payload)["payload"].to_pylist()
    monkeypatch.setattr(suffixes, "ARRAY", 50)
    assert suffixes._judge_windows((pa.scalar(0),), payload)["payload"].to_pylist() == whole


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(400):
        text = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))] + [0]
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_empty_tables(spark):
    none = documents(spark, [])
    assert substring.remove_repeats(none).collect() == []
    assert suffixes.remove_repeats(none).collect() == []
