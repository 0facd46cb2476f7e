"""What queries on samples, strata and forecasts read and carry: a frame once, and no ranks where a cut or a count will do."""

import hashlib
from collections import Counter

from tests.test_grid import some_frame

from tesserae.operators import accounting, ranking
from tesserae.plans import estimation, forecasts


def _tasks(rows):
    out = {}
    for r in rows:
        out.setdefault(r["task_id"], []).append(r)
    return out


def test_sizes_of_tasks_take_no_join(spark):
    frame = some_frame(spark, 11)
    sized = estimation._sized(frame)
    assert "Join" not in sized._jdf.queryExecution().executedPlan().toString()
    k = {t: len(rows) for t, rows in _tasks(frame.collect()).items()}
    assert all(r["k"] == k[r["task_id"]] for r in sized.collect())


def test_sample_of_tasks_is_cut_not_ranked(spark, monkeypatch):
    def ranked(*args, **kwargs):
        raise AssertionError("all tasks are ranked")

    frame = some_frame(spark, 12)
    monkeypatch.setattr(estimation.ranking, "global_offset", ranked)
    got = estimation.task_srs_estimates(frame).first()
    tasks = _tasks(frame.collect())
    some = sorted(tasks, key=lambda t: hashlib.sha256(b"sample|1|%d" % t).hexdigest())[: len(tasks) // 5]
    agree = sum(r["gold"] == r["prediction"] for t in some for r in tasks[t])
    queries = sum(len(tasks[t]) for t in some)
    assert (got["sample"], got["population"], got["queries"], got["ratio_estimate"]) == (len(some), len(tasks), queries, round(agree / queries, 9))


def test_permuted_gold_ranks_narrow_rows(spark, monkeypatch):
    frame, carried, real = some_frame(spark, 13), [], ranking.global_offset

    def watched(df, *args, **kwargs):
        carried.append(set(df.columns) - {"k", "prediction", "category", "head", "key"})
        return real(df, *args, **kwargs)

    monkeypatch.setattr(estimation.ranking, "global_offset", watched)
    got = {(r["reference_pass"], r["predicted_pass"]): r["tasks"] for r in estimation.permuted_gold_margins(frame).collect()}
    assert carried == [{"task_id"}, {"gold"}]
    tasks = _tasks(frame.collect())
    strata = {}
    for t, rows in tasks.items():
        for r in rows:
            strata.setdefault((len(rows), r["prediction"], r["category"]), []).append(r)
    dealt = {t: 1 for t in tasks}
    for rows in strata.values():
        order = lambda seed, rows=rows: sorted(rows, key=lambda r: hashlib.sha256(b"permute|%d|%d|%d" % (seed, r["task_id"], r["slot"])).hexdigest())
        for to, of in zip(order(1), order(2), strict=True):
            dealt[to["task_id"]] = min(dealt[to["task_id"]], of["gold"])
    assert got == Counter((dealt[t], min(r["prediction"] for r in rows)) for t, rows in tasks.items())


def test_forecasts_make_units_once(spark, monkeypatch):
    made, real = [], estimation.units

    def counted(frame):
        made.append(frame)
        return real(frame)

    monkeypatch.setattr(estimation, "units", counted)
    rows = forecasts.forecast_comparison(some_frame(spark, 14, 60)).collect()
    assert len(made) == 1 and "zero" in {r["predictor"] for r in rows}


def test_random_curve_ranks_nothing(spark, monkeypatch):
    """The curve of the random order is the transcript's, at budgets in any order and with ends amid the frame, and without its ranks."""
    frame = some_frame(spark, 15).cache()
    shares = (50, 0, 7, 93)
    want = {r["share"]: r for r in accounting.curve(frame, ranking.transcript(frame, "random_criterion"), shares).collect()}

    def ranked(*args, **kwargs):
        raise AssertionError("all criteria are ranked")

    monkeypatch.setattr(ranking, "global_offset", ranked)
    got = accounting.random_curve(frame, shares).collect()
    assert len(got) == 4
    for r in got:
        assert all(r[f] == want[r["share"]][f] for f in accounting.FIELDS), r["share"]
