"""A part of the queries against their SQL at the smallest scale; the driver compares all of them."""

import os

import duckdb
import pytest
from tests.conftest import ROOT

from tesserae import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
SOME = ["task_confusion_by_producer", "rejection_modes", "order_disagreement_then_random", "budget_curve_sc_judge", "query_metrics", "expected_update_curve", "donor_pools_grouping_sets", "strata_proportional", "bounds_d0_max_window", "connected_components", "budget_ledger", "two_run_agreement", "shard_packing", "verdict_rules", "bounds_d1_min", "nested_half_random", "staged_reveal", "mechanism_summary", "recovered_counts", "channel_subsets", "first_mass_position", "ledger_states", "retry_rounds", "witness_totals", "forecast_comparison", "content_digest", "indexed_records", "masked_labels", "positional_differences", "seed_accuracy", "normal_texts"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, db, name):
    want = db.execute(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda x: sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_the_rest_stands_without_the_corpus_operators():
    """No module outside of the corpus subpackage imports it."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tesserae")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, f), encoding="utf-8").read(), f


def test_the_rest_runs_without_the_corpus_folders(tmp_path):
    """In a copy without the corpus folders and pipeline the entry imports, and every other query is there; a broken import in them shows."""
    import shutil
    import subprocess
    import sys

    left_out = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    code = "import __spark_entry__ as e, sys; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    from tesserae import catalog

    assert run().stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES)), "False", "False"]
    broken = tmp_path / "copy" / "tesserae" / "llm"
    broken.mkdir()
    (broken / "__init__.py").write_text("")
    (broken / "queries.py").write_text("import nowhere_to_be_found")
    (tmp_path / "copy" / "corpus_pipeline.py").write_text("")
    assert "nowhere_to_be_found" in run().stderr


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_what_a_query_writes_can_be_removed(spark):
    from tesserae.operators import storage

    before = storage.made()
    rows = catalog.QUERIES["content_differences"](spark, DATA).collect()
    own = [p for p in storage.made() if p not in before]
    exists = lambda p: os.path.exists(p.removeprefix("file:"))
    assert rows and own and all(map(exists, own))
    storage.release(spark, own)
    assert storage.made() == before and not any(map(exists, own))
