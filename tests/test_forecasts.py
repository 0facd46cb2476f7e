"""Combined inference against its definition, forecasts that know nothing of references, composed texts."""

import math
import random
import unicodedata

from tests.test_policies import SCHEMA

from tesserae.functions import exact, text
from tesserae.plans import forecasts


def frame(spark, seed=4, tasks=220):
    rng, rows = random.Random(seed), []
    for t in range(tasks):
        for s in range(rng.randint(1, 6)):
            rows.append((t, s, t % 60, f"p{t % 2}", "c", int(rng.random() < 0.8), int(rng.random() < 0.7), [1]))
    return spark.createDataFrame(rows, SCHEMA)


def test_combined_interval(spark):
    import hashlib

    df = frame(spark)
    strata = {}
    for r in df.collect():
        key = hashlib.sha256(f"combined|1|{r['task_id']}|{r['slot']}".encode()).hexdigest()
        s = strata.setdefault((r["producer"], r["prediction"]), [0, 0, 0, 0, 0])
        hit = int(r["gold"] == r["prediction"])
        s[0] += 1
        if key < "08":
            s[1] += hit
        else:
            s[2] += 1
            s[3] += key < "30"
            s[4] += hit and key < "30"
    for r in forecasts.combined_interval(df).collect():
        mine = [s for (p, _), s in strata.items() if p == r["producer"]]
        open_ = [s for s in mine if s[3] < s[2]]
        total = sum(s[0] for s in mine)
        low = high = est = var = 0
        for s in mine:
            lo, hi = (s[4], s[4]) if s[3] == s[2] else exact.interval(s[2], s[3], s[4], str(0.05 / len(open_)))
            low, high = low + s[1] + lo, high + s[1] + hi
            est += s[1] + s[2] * s[4] / s[3]
            var += 0 if s[3] == s[2] else s[2] ** 2 * (1 - s[3] / s[2]) * s[4] * (s[3] - s[4]) / (s[3] * (s[3] - 1)) / s[3]
        assert r["total"] == total and math.isclose(r["ci_lower"], low / total, abs_tol=1e-9) and math.isclose(r["ci_upper"], high / total, abs_tol=1e-9)
        assert math.isclose(r["estimate"], est / total, abs_tol=1e-9) and math.isclose(r["normal_lower"], max(0, est / total - forecasts.Z * math.sqrt(var) / total), abs_tol=1e-9)


def test_forecasts_read_no_later_reference(spark):
    """Other references beyond the pilot change no forecast, and at budgets of nothing and all there is nothing to tell."""
    from pyspark.sql import functions as F

    from tesserae.plans import estimation

    df = frame(spark).cache()
    pilot = estimation.split(df)
    other = df.join(pilot, "base_id").withColumn("gold", F.when(F.col("pilot"), F.col("gold")).otherwise(1 - F.col("gold"))).select(*df.columns)
    rows = lambda f: sorted((r["producer"], r["share"], r["predictor"], round(r["forecast"], 9)) for r in forecasts.predictions(f, (0, 30, 100)).collect())
    got = rows(df)
    assert got == rows(other) and len(got) == 2 * 3 * 4
    assert all(abs(v) < 1e-9 for _, share, _, v in got if share in (0, 100)) and any(abs(v) > 0.01 for _, share, p, v in got if share == 30 and p != "zero")


def test_composed_texts(spark):
    texts = ["é", "é", None, "", "ﬁ 가", "ạ̇"]
    got = [r["t"] for r in text.composed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").orderBy("i").collect()]
    assert got == [t if t is None else unicodedata.normalize("NFC", t) for t in texts]
