"""The stages keep what they should, and the whole gives the rows that its parts give by hand."""

import random

import corpus_pipeline
from tests.llm.helpers import documents, mixed, prose
from tests.llm.test_neardup import brute as classes
from tests.llm.test_others import base_spans

from tesserae.llm import packing


def test_run_is_its_stages(spark, tmp_path):
    rng = random.Random(12)
    item = prose(rng, 40)
    texts = [*mixed(), prose(rng, 20) + " " + item, "123 456", "write to me@host.org now please", prose(rng, 70)]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    first = dict(classes([texts[i] for i in left]))
    left = [i for n, i in enumerate(left) if first[n] == n]
    left = [i for i in left if item not in texts[i]]
    encode, want = packing.encoder(packing.default_tokenizer()), {}
    for i in left:
        t = texts[i]
        for a, k, b in reversed(base_spans(t)):
            t = t[:a] + f"<{['EMAIL', 'IP', 'CARD', 'PHONE'][k]}>" + t[b:]
        want[i] = len(encode(t)) + 1
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == want


def test_stages_keep_the_columns(spark, tmp_path):
    docs = documents(spark, mixed())
    spark.createDataFrame([(1, "nothing like it at all here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "personal_data", "pack"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_language_keeps_texts_with_letters_without_labels(spark, tmp_path):
    docs = documents(spark, ["some words here", "12 34", None, ""], [None] * 4)
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()] == [0]


def test_texts_of_a_repeated_id_are_kept(spark, tmp_path):
    rng = random.Random(14)
    one, other, third, fourth = (prose(rng, 40 + k) for k in range(4))
    texts, ids = [one, other, one, third, third, None, None, fourth, fourth], [1, 1, 2, 3, 3, 4, 4, 5, None]
    want = sorted([(1, one), (1, other), (3, third), (4, None), (5, fourth), (None, fourth)], key=repr)
    for order in (1, -1):
        docs = documents(spark, texts[::order], ids=ids[::order])
        kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
        assert kept.dtypes == docs.dtypes
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == want


def test_stages_keep_columns_that_are_called_like_their_own(spark, tmp_path):
    from pyspark.sql import functions as F

    rng = random.Random(15)
    spark.createDataFrame([(1, "nothing like it at all here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["spans", "_", "_spans", "score", "lang_pred", "block", "text_key", "_text", "_row", "_rest", "class_id", "n", "count", "kept"]
    texts = [prose(rng, 30) for _ in range(6)]
    for ids in (None, [1, 1, 2, 2, None, 3]):
        docs = documents(spark, texts, ids=ids).withColumns({n: F.concat(F.lit(n), "text") for n in names})
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.dtypes == docs.dtypes
            rows = out.collect()
            assert len(rows) == 6 and all(r[n] == n + r["text"] for r in rows for n in names)
