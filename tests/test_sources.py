"""Files, validation, text verdicts, components and the ledger on small cases."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import graph, validation
from tesserae.sources import files
from tesserae.streaming import ledger

HEAD = "run,domain,task_id,criterion_id,criterion_index,category,provider,model,gold,prediction\n"


def runs(tmp_path, *lines):
    path = tmp_path / "runs.csv"
    path.write_text(HEAD + "".join(f"r,d,{x},k,p,m,{y}\n" for x, y in lines))
    return str(path)


def test_runs(spark, tmp_path):
    good = runs(tmp_path, ("t1,c1,0", "True,False"), ("t1,c2,1", "0,1"), ("t2,c1,0", "False,False"))
    assert sorted((r["task_id"], r["slot"], r["gold"], r["prediction"]) for r in files.read_runs(spark, good).collect()) == [("t1", 0, 1, 0), ("t1", 1, 0, 1), ("t2", 0, 0, 0)]


@pytest.mark.parametrize("lines", [[("t1,c1,0", "True,2")], [("t1,c1,2", "True,True")], [("t1,c1,0", "1,1"), ("t1,c1,1", "1,1")], [("t1,c1,0", "1,1"), ("t1,c2,0", "1,1")], [(",c1,0", "1,1")], [("t1,c1,0", "yes,1")]])
def test_broken_runs_are_errors(spark, tmp_path, lines):
    with pytest.raises(ValueError):
        files.read_runs(spark, runs(tmp_path, *lines))


def test_csv(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write('x,y\n1,"a, ""b"""\n2,\n')
    got = files.read_csv(spark, str(tmp_path / "a.csv.gz"), ["x", "y"])
    assert sorted((r["x"], r["y"]) for r in got.collect()) == [("1", 'a, "b"'), ("2", None)]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "a.csv.gz"), ["x", "z"])
    files.project_csv(spark, str(tmp_path / "a.csv.gz"), ["x", "y"], ["y"], str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["y"]


def test_repeated_keys_show(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"a": 1, "b": 2, "a": 3}')
    assert {r["key"]: r["n"] for r in files.json_entries(spark, str(tmp_path / "j.json")).collect()} == {"a": 2, "b": 1}
    with pytest.raises(ValueError):
        json.loads('{"a": 1, "a": 2}', object_pairs_hook=files.reject_repeated_keys)


def test_score_status(spark):
    cases = {"0.0": "present", "1": "present", "1.5": "unparseable", "-1": "unparseable", "NaN": "unparseable", "true": "unparseable", '"0.8"': "unparseable", '"ERR"': "error", "null": "missing", None: "missing", "1e-1": "present"}
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", files.score_status(F.col("v")).alias("s")).collect()
    assert {r["v"]: r["s"] for r in got} == cases


def test_receipt_and_row_count(spark, tmp_path):
    files.write_json_receipt(str(tmp_path / "r.json"), {"b": 1, "a": [2]})
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": [2], "b": 1}
    with pytest.raises(ValueError):
        files.write_json_receipt(str(tmp_path / "n.json"), {"a": float("nan")})
    assert files.write_rows(spark.range(7), str(tmp_path / "rows")) == 7


def test_comparisons(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double")
    assert validation.compare_tables(a, spark.createDataFrame([(1, 1.0 + 1e-12), (2, None)], "k int, v double"), ["k"]).isEmpty()
    assert validation.compare_tables(a, spark.createDataFrame([(1, 1.1), (3, None)], "k int, v double"), ["k"]).count() == 3
    validation.assert_close({"a": [1, 2.0]}, {"a": [1, 2.0 + 1e-12]})
    with pytest.raises(AssertionError):
        validation.assert_close({"a": 1}, {"a": 1.0})
    with pytest.raises(ValueError):
        validation.require_aligned(a, a.withColumn("v", F.lit(2.0)), ["k"], ["v"])


VERDICTS = [
    ("Yes, it does.", 1, "v1-yes-no"), ("I say no", 0, "v1-yes-no"), ("", None, "missing-empty"), (None, None, "missing-empty"), ("  \n ", None, "missing-empty"), ("Oui, c'est bon", 1, "first-word-lexicon"),
    ("**Нет**, это не так", 0, "first-word-lexicon"), ("是的，可以", 1, "first-word-lexicon"), ("The constraint is fully satisfied.", 1, "verdict-phrase"), ("It was not met.", 0, "verdict-phrase"),
    ("The text fails to satisfy it", 0, "verdict-phrase"), ("This is partially met", None, "missing-partial"), ("Not applicable here", None, "missing-abstain"), ("It is satisfied but not fulfilled", None, "missing-conflict"),
    ("To determine if it is satisfied, look", None, "missing-no-verdict"), ('He said "it is met" there', None, "missing-no-verdict"), ("\n\nHello there everyone out in space", None, "missing-no-verdict"),
]


def test_verdicts(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(VERDICTS)], "i int, t string").select("i", text.verdict(F.col("t")).alias("v"), text.verdict(F.col("t"), True).alias("w")).collect()
    got = {r["i"]: r for r in rows}
    for i, (t, label, rule) in enumerate(VERDICTS):
        assert (got[i]["v"]["label"], got[i]["v"]["rule"]) == (label, rule), t
    assert got[11]["w"]["label"] == 0


def test_money(spark):
    got = spark.createDataFrame([(1, "0.0000000001"), (2, "1.5")], "i int, s string").select("i", text.nanodollars(F.col("s").cast("decimal(28,12)")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {1: 1, 2: 1_500_000_000}


def test_components(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None), (6, "d"), (7, "d"), *((i, f"e{i // 2}") for i in range(20, 40)), *((i + 1, f"e{i // 2}") for i in range(21, 39, 2))]
    got = {r["node"]: r["component"] for r in graph.by_tokens(spark.createDataFrame(rows, "node long, token string")).collect()}
    assert {got[i] for i in (1, 2, 3)} == {1} and got[4] == 4 and got[5] == 5 and got[7] == 6
    assert {got[i] for i in range(20, 40)} == {20}


def test_ledger(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "account string, job_id string, cost long"
    spark.createDataFrame([("a", "1", 40), ("a", "2", 50), ("b", "3", 200)], schema).coalesce(1).write.mode("append").parquet(source)
    ledger.run_ledger(spark, source, out, str(tmp_path / "cp"), 100)
    spark.createDataFrame([("a", "1", 40), ("a", "4", 20), ("a", "5", 5)], schema).coalesce(1).write.mode("append").parquet(source)
    ledger.run_ledger(spark, source, out, str(tmp_path / "cp"), 100)
    got = {r["job_id"]: r["admitted"] for r in spark.read.parquet(out).collect()}
    assert got == {"1": True, "2": True, "3": False, "4": False, "5": True}


def test_scores_round_as_doubles_do(spark, tmp_path):
    """A score of 1.005 is below the half: its nearest double times a hundred is 100.49999999999999."""
    from tesserae.plans import ingestion

    for name, rows in (("half", [(6, 100.5)]), ("over", [(6, 101.0)])):
        spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/{name}/events.parquet")
        (got,) = ingestion.QUERIES["masked_status"](spark, f"{tmp_path}/{name}").collect()
        assert got["status"] == {"half": "present", "over": "unparseable"}[name]
