"""Operators 3, 4, 5, 6, 8, 9, 10 on small cases, against brute force where there is one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tests.llm.helpers import clashing, documents, mixed, prose, rows

from tesserae.llm import common, langid, licences, packing, personal, quotes, tiling, topk

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and personal.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


PERSONAL = [None, "", "é mail me@host.co.uk, a.b@c or a@b@c.de", "1.2.3.4.5.6.7.8 999.1.1.1 010.0.0.255", "4111 1111 1111 1111 and 4111111111111112, 4111-1111-1111-1111", "+1 (555) 555-0100 +49 30 1234567 (415) 555-2671", "x" * 30000 + "@" + "y" * 30000, "1" * 40000 + ".1.1", "jane (at) example (dot) com", "a@b.c" * 3, "+1+2+3 + 5"]


def test_strict_spans_are_those_of_the_patterns():
    for t in PERSONAL + [p for p in mixed() if p]:
        assert sorted((a, k, b) for k, a, b, ok in personal.strict(t or "") if ok) == base_spans(t)


def test_personal_data(spark):
    docs = documents(spark, PERSONAL)
    got = {r["doc_id"]: r["spans"] for r in personal.find(clashing(docs), "doc_id").collect()}
    for i, t in enumerate(PERSONAL):
        assert [(s["start"], s["kind"], s["end"]) for s in got[i] if s["base"]] == base_spans(t)
        assert got[i] == sorted(got[i])
    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in personal.mask(docs).collect()}
    assert masked[0] == (None, None) and masked[2][0].startswith("é mail <EMAIL>, a.b@c") and masked[2][1] == len(masked[2][0])
    assert personal.find(documents(spark, []), "doc_id").collect() == []


def test_reliabilities_are_learned():
    good, bad = personal._code(3, [1, 1, 1, 1, 0, 0], [2, 1, 1, 0, 2, 0, 0]), personal._code(3, [-1, -1, 0, 0, -1, -1], [2, 0, 0, 0, 2, 1, 1])
    odd = personal._code(3, [0, 1, 0, 1, 0, 0], [2, 1, 1, 0, 2, 0, 0])
    assert personal._decode(good) == (3, [1, 1, 1, 1, 0, 0], [2, 1, 1, 0, 2, 0, 0])
    p = personal.train({good: 500, bad: 400, odd: 20})
    assert p[good] > 0.9 and p[bad] < 0.1 and p[odd] > 0.5
    assert personal.train({}) == {}


def test_a_span_meets_any_that_stays():
    rng = random.Random(6)
    for _ in range(200):
        spans = [(a, a + rng.randint(1, 30)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 9)))]
        a = rng.randrange(70)
        b = a + rng.randint(1, 5)
        assert personal._Taken(spans).meets(a, b) == any(x < b and y > a for x, y in spans)


def test_estimation_is_that_of_each_candidate():
    """EM over counted patterns against EM over every candidate by itself."""
    rng = random.Random(8)
    counts = {}
    for _ in range(300):
        true = rng.random() < 0.4
        v = [(1 if rng.random() < 0.8 else -1 if rng.random() < 0.5 else 0) * (1 if true else -1) for _ in range(6)]
        code = personal._code(1, v, [1, 0, 0, 0, 0, 0, 0])
        counts[code] = counts.get(code, 0) + 1
    rows = [personal._decode(c)[1] for c, n in counts.items() for _ in range(n)]
    p = [1 / (1 + np.exp(-1.5 * sum(v))) for v in rows]
    for _ in range(50):
        t = {}
        for side, prior in ((1, (0.5, 1.0, 1.5)), (0, (1.5, 1.0, 0.5))):
            for j in range(6):
                mass = [prior[x + 1] + sum((q if side else 1 - q) for q, v in zip(p, rows, strict=True) if v[j] == x) for x in (-1, 0, 1)]
                t[side, j] = [m / sum(mass) for m in mass]
        share = (sum(p) + 1) / (len(p) + 2)
        logit = [np.log(share / (1 - share)) + sum(np.log(t[1, j][v[j] + 1] / t[0, j][v[j] + 1]) for j in range(6)) for v in rows]
        p = [1 / (1 + np.exp(-x)) for x in np.clip(logit, -30, 30)]
    got = personal.estimate(counts)
    want = dict(zip((c for c, n in counts.items() for _ in range(n)), p, strict=True))
    assert all(abs(got[c] - want[c]) < 1e-6 for c in counts)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_quotes(spark):
    data = [
        (1, 0, "user", "Where is the Station?\nIt rains."), (1, 1, "assistant", "> where is the station\nAt the market."), (1, 2, "user", ">> Where is the station?\n> At the market.\nThanks"),
        (1, 3, "user", "> never said\nHm"), (2, 0, "user", "> It rains.\nHere too"), (2, 1, "user", None), (2, 2, "user", ""), (None, 4, "user", "> it rains"), (1, 4, "user", "> Thanks"), (1, 4, "user", "> Thanks"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(clashing(spark.createDataFrame(data, CONVERSATIONS))).collect()}
    assert len(got) == 9
    assert got[1, 1]["reply_turn"] == 0 and got[1, 1]["clean_text"] == "At the market." and got[1, 1]["n_linked"] == 1
    assert (got[1, 2]["reply_turn"], got[1, 2]["max_level"], got[1, 2]["n_passages"], got[1, 2]["n_linked"], got[1, 2]["reply_depth"], got[1, 2]["thread_turn"]) == (1, 2, 2, 2, 2, 0)
    assert got[1, 3]["reply_turn"] is None and got[1, 3]["n_passages"] == 1
    assert (got[2, 0]["reply_conv"], got[2, 0]["reply_turn"], got[2, 0]["thread_conv"]) == (1, 0, 1)
    assert got[2, 1]["clean_text"] is None and got[2, 2]["clean_text"] == "" and got[1, 4]["reply_depth"] == 3
    assert quotes.link_quotes(spark.createDataFrame([], CONVERSATIONS)).collect() == []


def quoted(seed=11, conversations=12):
    """Made-up conversations with nested quotes, quotes of quotes and of other conversations, ties, repeated rows and nulls."""
    rng, out = random.Random(seed), []
    for c in range(conversations):
        said = []
        for t in range(rng.randint(1, 7)):
            lines = []
            for _ in range(rng.randint(0, 2)):
                if said or out:
                    origin = (said[-1] if said and rng.random() < 0.6 else rng.choice(said or out))[3] or ""
                    lines += [("> " if rng.random() < 0.7 else ">> ") + x for x in origin.split("\n")[-rng.randint(1, 3) :]]
            lines += ["thanks", prose(rng, 4).capitalize() + "."][rng.randint(0, 1) : rng.randint(1, 3)]
            said.append((c, t, rng.choice(["user", "assistant"]), "\n".join(lines)))
        out += said
    return [*out, out[3], (2, 1, "user", None), (None, 1, "user", "> thanks"), (3, None, "user", "> thanks\nx"), (2, 1, None, "")]


def test_quotes_equal_their_sql_on_any_input(spark):
    import duckdb

    data = quoted()
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    want = db.execute(quotes.ORACLE)
    names = [d[0] for d in want.description]
    want = sorted(map(tuple, want.fetchall()), key=repr)
    assert sum(r[names.index("n_linked")] for r in want) > 20 and max(r[names.index("reply_depth")] for r in want) > 2
    source = spark.createDataFrame(data, CONVERSATIONS)
    from pyspark.sql import functions as F

    for given in (source, source.repartition(7), source.orderBy(F.rand(5))):
        linked = quotes.link_quotes(given)
        assert sorted((tuple(r[n] for n in names) for r in linked.collect()), key=repr) == want
    threads = quotes.conversations(linked).collect()
    assert sum(len(t["messages"]) for t in threads) == sum(r[0] is not None and r[1] is not None for r in want)
    assert all(not line.lstrip().startswith(">") for t in threads for m in t["messages"] for line in (m["text"] or "").split("\n"))


def test_tiling(spark):
    rng = random.Random(4)
    item = prose(rng, 40)
    w = item.split()
    turned = " ".join(w[20:] + w[:20])
    broken = " ".join(x if i % 4 else "zz" for i, x in enumerate(w))
    texts = [item, "Intro. " + turned.upper() + "!", broken, prose(rng, 300), None, "", " ".join(w[:20]), prose(rng, 3000) + " " + item + " " + prose(rng, 50)]
    bench = spark.createDataFrame([(9, item, "x"), (8, "too short", "x"), (7, None, "x"), (None, item, "x")], "item_id long, text string, block string")
    assert rows(tiling.contaminated(clashing(documents(spark, texts)), bench), "doc_id", "item_id") == [(0, 9), (1, 9), (7, 9)]
    assert [r["doc_id"] for r in tiling.uncontaminated(documents(spark, texts), bench).orderBy("doc_id").collect()] == [2, 3, 4, 5, 6]
    assert tiling.contaminated(documents(spark, texts), bench.limit(0)).collect() == []
    assert tiling.contaminated(documents(spark, []), bench).collect() == []


def test_tiling_takes_several_passes(spark, monkeypatch):
    rng = random.Random(6)
    items = [prose(rng, 30) for _ in range(6)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, items[::-1])
    once = rows(tiling.contaminated(docs, bench), "doc_id", "item_id")
    monkeypatch.setattr(tiling, "PASS_TOKENS", 50)
    assert rows(tiling.contaminated(docs, bench), "doc_id", "item_id") == once == [(i, 5 - i) for i in range(6)]


def test_short_and_unspaced_items(spark):
    items = ["What is love?", "敏捷的棕色狐狸跳过了懒狗", "yes", "...", "what IS", "สวัสดีครับผม"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["So what is love, they asked", "我说敏捷的棕色狐狸跳过了懒狗吗", "yesterday", "Yes\u2014\u201cYES\u201d", "love is what", "what\nis\u00a0LOVE", "พูดว่าสวัสดีครับผมแล้ว", None]
    assert rows(tiling.contaminated(documents(spark, texts), bench), "doc_id", "item_id") == [(0, 0), (0, 4), (1, 1), (3, 2), (5, 0), (5, 4), (6, 5)]
    assert [r["doc_id"] for r in tiling.uncontaminated(documents(spark, texts), bench).orderBy("doc_id").collect()] == [2, 4, 7]


def test_tokens_go_by_unicode_class():
    def cut(*texts):
        data = [t.encode() for t in texts]
        return [x.tolist() for x in tiling.tokens(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))]

    plain = cut("it s a no break space 7", "x")
    assert plain == cut("\u201cIt\u2019s a\u00a0no\u2014break\u2026 space 7\u201d", "X") and plain[1] == [0, 7, 8]
    assert cut("ЁЖ É")[0] == cut("ёж é")[0] and len(cut("e\u0301a हिन्दी")[0]) == 2
    assert len(cut("漢字aかな 1")[0]) == 6 and len(cut("ก้ข a🙂b")[0]) == 4


def greedy(item, text, least=5):
    """Greedy string tiling by its definition."""
    a, b, covered = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return covered / len(item)
        a[i : i + k], b[j : j + k] = [True] * k, [True] * k
        covered += k


def test_running_hashes_are_those_of_windows():
    words = np.random.default_rng(4).integers(0, 9, 50).astype(np.uint64)
    for length in (1, 3, 20):
        starts = np.arange(len(words) - length + 1)
        assert (tiling.Running(words).at(starts, length) == common.window_hashes(words, length)).all()


def test_one_repeated_token_in_a_long_text():
    item, text = np.full(40, 7, np.uint64), np.full(200_000, 7, np.uint64)
    assert tiling.coverage(item, text) == 1.0


def test_coverage_by_definition():
    rng = random.Random(8)
    for _ in range(150):
        item, text = ([rng.randrange(6) for _ in range(rng.randint(5, 40))] for _ in range(2))
        got = tiling.coverage(*(np.array(x, np.uint64) for x in (item, text)))
        assert got == pytest.approx(greedy(item, text))


def test_tokens_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    other, encode = Tokenizer.from_file(path), packing.encoder(path)
    for t in [p or "" for p in mixed()] + ["a <|endoftext|> b<|endoftext|>", "  two  spaces\n\n\nlines \t", "日本語 テスト 🙂🙂 naïve I'm we'LL", "0123456789" * 50, "<|endoftext|"]:
        assert list(encode(t)) == other.encode(t, add_special_tokens=False).ids


def test_long_white_space_is_encoded():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    other, encode = Tokenizer.from_file(path), packing.encoder(path)
    for run in (" " * 3_000_000, "\n" * 2_000_000, " \t\n" * 700_000, "\u3000" * 1_100_000, " " * 99_999, " " * 100_000):
        for t in ("a b" + run + "c", run + "<|endoftext|>", run):
            assert list(encode(t)) == other.encode(t, add_special_tokens=False).ids


def test_packing(spark):
    docs = documents(spark, mixed() + ["w" * 3, prose(random.Random(2), 9000)])
    got = packing.pack(clashing(docs), packing.default_tokenizer(), keep_ids=True).collect()
    encode = packing.encoder(packing.default_tokenizer())
    by_doc = {}
    for r in got:
        assert r["length"] == len(r["ids"]) <= 1024 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d in docs.collect():
        parts = sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])
        assert [x for p in parts for x in p["ids"]] == [*encode(d["text"] or ""), 2]
        assert [p["start"] for p in parts] == [sum(q["length"] for q in parts[:i]) for i in range(len(parts))]
        assert all(p["length"] == 1024 for p in parts[1:])
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(documents(spark, []), packing.default_tokenizer()).collect() == []
    ids = {r["sequence_id"]: r["ids"] for r in packing.sequences(packing.pack(docs, packing.default_tokenizer(), keep_ids=True)).collect()}
    assert sum(map(len, ids.values())) == sum(r["length"] for r in got)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(9)
    for _ in range(60):
        cap = rng.choice([10, 37, 100])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 150))]
        left = []
        for x in sorted(lengths, reverse=True):
            fits = [b for b in range(len(left)) if left[b] >= x]
            if fits:
                left[min(fits, key=lambda b: left[b])] -= x
            else:
                left.append(cap - x)
        runs, bins = packing.plan({x: lengths.count(x) for x in set(lengths)}, cap)
        assert bins == len(left)
        used = {}
        for length, lo, hi, first, per, offset in runs.tolist():
            for r in range(hi - lo):
                used.setdefault(first + r // per, []).append((offset + r % per * length, length))
        assert sorted(cap - sum(n for _, n in v) for v in used.values()) == sorted(left)
        for v in used.values():
            assert all(a + n <= b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:]))


@pytest.mark.parametrize("least", [-9, 0])
def test_top_k_is_exact(least):
    """Over shards, with scores carried on; sparse postings leave many entries unread."""
    rng = np.random.default_rng(3)
    c = rng.integers(least, 9, (3000, 24)) * (rng.random((3000, 24)) < (0.2 if least == 0 else 1)) * np.where(np.arange(24) < 3, 9, 1)
    ids, read = np.arange(3000), 0
    shards = [topk.Shard(ids[lo : lo + 1000], c[lo : lo + 1000]) for lo in range(0, 3000, 1000)]
    for i in range(40):
        have = None
        for shard in shards:
            *have, some = topk.best(i, c[i], shard, 20, have)
            read += some
        exact = c @ c[i]
        order = [j for j in np.lexsort((ids, -exact)) if j != i][:20]
        assert have[0].tolist() == order and have[1].tolist() == exact[order].tolist()
    assert read < 0.9 * 40 * 3000 * 24


def test_products_that_pass_64_bits_are_an_error():
    block = topk._Queries([{"vec_id": 0, "q": [1 << 40, 1]}])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([5], pa.int64()), pa.array([[1 << 40, 1]], pa.list_(pa.int64()))], ["vec_id", "q"])
    with pytest.raises(OverflowError):
        list(block.search(iter([batch]), 3))


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 7)
    monkeypatch.setattr(topk, "QUERY_CELLS", 4)
    rng = random.Random(1)
    data = [(i, [rng.uniform(-1, 1) for _ in range(4)], 1) for i in range(30)] + [(40, None, 1), (60, [0.1, None, 0.2, 0.3], 1), (80, [float("nan")] * 4, 1), (None, [1.0] * 4, 1), (100, [0.5, 0.5], 1), (3, [1.0] * 4, 1)]
    q = topk.quantise(spark.createDataFrame(data, "vec_id long, embedding array<float>, block int"))
    got = {}
    for r in topk.top_k(q, q.where("vec_id % 20 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = [(r["vec_id"], r["q"]) for r in q.where("vec_id IS NOT NULL").collect()]
    for i in (0, 20):
        own = next(x for k, x in v if k == i)
        best = sorted((-sum(a * b for a, b in zip(own, x)), k) for k, x in v if k != i and len(x) == 4)[:5]
        assert sorted(got[i]) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert set(got) == {0, 20}
    assert topk.top_k(q.limit(0), q.limit(0)).collect() == []


def test_licences(spark):
    texts = ["Intro\nReleased under the MIT license!\nmore", None, "", "word", "licensed under CC-BY-NC 4.0", "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software\nand associated documentation files.", "the the the the the " * 500, "released under the"]
    got = rows(licences.scan(clashing(documents(spark, texts))), "doc_id", "segment", "licence")
    assert got == sorted([(0, -1, "MIT"), (0, 1, "MIT"), (0, -2, "MIT"), (4, 0, "CC-BY-NC-4.0"), (4, -2, "CC-BY-NC-4.0"), (5, -1, "MIT"), (5, -2, "MIT")], key=repr)
    assert licences.scan(documents(spark, [])).collect() == []
    many = rows(licences.scan(documents(spark, texts), [("a", "Released under the MIT License."), ("b", "")]), "doc_id", "licence")
    assert many == [(0, "a")] * 3  # the line, the text and the run


def test_licences_amid_other_words(spark):
    body = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 500)
    words = (prose(random.Random(2), 40) + " " + body + " " + prose(random.Random(3), 40)).split()
    wrapped = "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))
    texts = [wrapped, "Copyright 2020 Jane Doe. Released under the MIT License. See the file.", prose(random.Random(4), 300)]
    got = licences.scan(documents(spark, texts)).where("segment = -2").collect()
    assert {(r["doc_id"], r["licence"]) for r in got} == {(0, "MIT"), (1, "MIT")}
    assert any(r["doc_id"] == 0 and r["start"] == 40 and r["dice"] == 1.0 for r in got)


def test_anchors_lose_no_segment():
    words = licences.anchors(licences.TEMPLATES, 0.8)
    for _, body in licences.TEMPLATES:
        w = licences._words(body)
        grams = set(zip(w, w[1:]))
        assert sum(not set(words) & set(g) for g in grams) < 0.8 / 1.2 * len(grams)


def test_languages(spark):
    sounds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "ich", "ung", "ver"], "cc": ["ció", "ñe", "ll", "os"]}
    rng = random.Random(2)
    make = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    langs = [rng.choice(list(sounds)) for _ in range(240)]
    texts = [make(x, rng.randint(3, 80)) for x in langs]
    docs = documents(spark, [*texts, None, "", "12 34 !!", texts[0].upper()], [*langs, "aa", None, "bb", None])
    got = {r["doc_id"]: r for r in langid.identify(clashing(docs), *langid.train(docs)).collect()}
    right = [got[i]["lang_pred"] == x for i, x in enumerate(langs) if langid.held_out_by_hand(i)]
    assert len(right) > 50 and sum(right) / len(right) > 0.97
    assert [got[i]["lang_pred"] for i in (240, 241, 242)] == ["und"] * 3 and got[243]["lang_pred"] == langs[0]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", langid.is_held_out(docs["doc_id"]).alias("h")).collect()}
    assert all(held[i] == langid.held_out_by_hand(i) for i in held)
    nothing = langid.identify(docs, *langid.train(docs.where("lang IS NULL"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_held_out_labels_are_never_read(spark):
    rng = random.Random(5)
    texts = [prose(rng, 20) for _ in range(60)]
    langs = ["x" if langid.held_out_by_hand(i) else "y" for i in range(60)]
    assert {lang for lang, _ in langid.training_sample(documents(spark, texts, langs))} == {"y"}


def test_scores_are_those_of_the_kernel(spark):
    """The folded matrix against kernel, landmarks and regression by definition."""
    rng = random.Random(21)
    sample = [(lang, " ".join(rng.choice(words) for _ in range(30))) for lang, words in (("a", ["uno", "dos", "tres"]), ("b", ["eins", "zwei", "drei"]), ("c", ["un", "deux", "trois"])) for _ in range(7)]
    langs, matrix = langid.fit(sample, landmarks=9)
    find = langid.Presence()
    grams = lambda t: set(find(langid.fold(np.frombuffer(t.encode(), np.uint8))).tolist())
    k = lambda x, y: len(x & y) / np.sqrt(len(x) * len(y))
    sets = [grams(t) for _, t in sample]
    chosen = [i for _, i in sorted((sum(x == lang for x, _ in sample[:i]), i) for i, (lang, _) in enumerate(sample))][:9]
    full = np.array([[k(x, sets[j]) for j in chosen] for x in sets])
    target = np.array([[1.0 if lang == x else -1.0 for x in langs] for lang, _ in sample])
    w = np.full(len(sample), 1 / 7 / 3)
    alpha = np.linalg.solve((full * w[:, None]).T @ full + langid.RIDGE * full[chosen] + 1e-9 * np.eye(9), (full * w[:, None]).T @ target)
    tests = ["uno zwei trois", "drei drei", "x"]
    want = np.array([[k(grams(t), sets[j]) for j in chosen] for t in tests]) @ alpha
    data = "".join(tests).encode()
    offsets = np.cumsum([0, *map(len, tests)])
    got = langid.score_batch(np.frombuffer(data, np.uint8), offsets, matrix, langid.Presence())
    assert np.allclose(got, want, atol=1e-5)
    # places of short grams are exact, so presence is that of the grams themselves on such texts
    assert len(grams("abcab")) == len({"abcab"[i : i + n] for n in range(1, 5) for i in range(6 - n)})


def test_every_language_is_learned(spark):
    rng = random.Random(11)
    sounds = {f"l{k:02d}": [prose(rng, 1)[:2] + chr(97 + k % 26) + chr(97 + (7 * k + k // 26) % 26) for _ in range(4)] for k in range(80)}
    langs = [x for x in sounds for _ in range(12)]
    texts = [" ".join(rng.choice(sounds[x]) for _ in range(30)) for x in langs]
    sample = langid.training_sample(documents(spark, texts, langs))
    assert {lang for lang, _ in sample} == set(sounds)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(documents(spark, texts), *langid.fit(sample)).collect()}
    held = [i for i in range(len(langs)) if langid.held_out_by_hand(i)]
    assert sum(got[i] == langs[i] for i in held) / len(held) > 0.9


def test_long_texts_are_taken_by_excerpt(spark):
    long = ["1 " * 15_000 + "schrich ung " * 2_000, "ka lo mi tu " * 2_000, "ka lo mi"]
    ids = [i for i in range(40) if not langid.held_out_by_hand(i)][:3]
    sample = langid.training_sample(documents(spark, long, ["bb", "aa", "aa"], ids))
    assert sorted((lang, len(text), text[:5]) for lang, text in sample) == [("aa", 8, "ka lo"), ("aa", 20_000, "ka lo"), ("bb", 20_000, "schri")]
    assert {r["lang_pred"] for r in langid.identify(documents(spark, long[:1]), *langid.fit(sample)).collect()} == {"bb"}


def test_digest_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_number_signs_are_no_letters(spark):
    texts = ["½ ½ ½", "②", "Ⅷ", "12 ٣ _", "ª", "一", "a", "👍", None, ""]
    trained = langid.fit([("en", "the cat sat on the mat"), ("de", "die katze saß auf der matte")])
    got = {r["doc_id"]: r["lang_pred"] != "und" for r in langid.identify(documents(spark, texts), *trained).collect()}
    assert got == {i: bool(t and __import__("regex").search(r"\p{L}", t)) for i, t in enumerate(texts)}


def test_long_texts_are_marked_in_pieces(monkeypatch):
    rng = random.Random(21)
    text = "".join(rng.choice("aÄéX zß 1一ÿ×Þ") for _ in range(3000)).encode()
    data = np.frombuffer(text, np.uint8)
    whole = langid.Presence()(langid.fold(data))
    for piece in (5, 64, 1000):
        monkeypatch.setattr(langid, "PIECE", piece)
        find = langid.Presence()
        for part in (data, data[:100], data):
            assert set(find.long(part).tolist()) == set(langid.Presence()(langid.fold(part)).tolist())
            assert len(find.long(part)) == len(set(find.long(part).tolist()))
    assert sorted(set(whole.tolist())) == sorted(whole.tolist())


def test_memory_of_a_long_text():
    import tracemalloc

    langs, matrix = langid.fit([("en", "the cat sat on the mat"), ("de", "die katze lag auf der matte")])
    data = np.tile(np.frombuffer(b"the cat sat on the mat and so on. ", np.uint8), 3_000_000)  # 102 MB
    find = langid.Presence()
    tracemalloc.start()
    d = langid.score_batch(data, np.array([0, len(data)]), matrix, find)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert langs[int(d[0].argmax())] == "en" and peak < 200 << 20


WHOLE = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_whole_licence_texts_are_named_as_themselves(spark):
    import os

    folder = "/usr/share/common-licenses"
    files = [f for f in WHOLE if os.path.exists(f"{folder}/{f}")]
    if not files:
        pytest.skip("no licence texts on this machine")
    texts = ["Some words before.\n" + open(f"{folder}/{f}", encoding="utf-8").read() for f in files]
    got = {}
    for r in licences.scan(documents(spark, texts)).collect():
        got.setdefault(files[r["doc_id"]], set()).add(r["licence"])
    assert {f: got.get(f, set()) - {"proprietary"} for f in files} == {f: {WHOLE[f]} for f in files}


def test_versions_tell_licences_apart(spark):
    notice = next(t for n, t in licences.TEMPLATES if n == "GPL-2.0" and t.startswith("This program is free"))
    bsd = {n: max((t for m, t in licences.TEMPLATES if m == n), key=len) for n in ("BSD-2-Clause", "BSD-3-Clause")}
    texts = [notice, notice.replace("version 2", "version 3"), notice.replace("version 2", "version 9"), "words " * 30 + bsd["BSD-2-Clause"] + " words" * 30, "words " * 30 + bsd["BSD-3-Clause"] + " words" * 30]
    got = {}
    for r in licences.scan(documents(spark, texts)).where("segment = -2").collect():
        got.setdefault(r["doc_id"], set()).add(r["licence"])
    assert got == {0: {"GPL-2.0"}, 1: {"GPL-3.0"}, 3: {"BSD-2-Clause"}, 4: {"BSD-3-Clause"}}
    assert licences.telling("GNU Lesser General Public License, version 2.1") == ["2 1", "gnu lesser", "lesser general", "version 2"]
