"""Queries on whole families drawn anew: totals, curves with bands, forecasts held against outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import accounting, resampling
from tesserae.operators.storage import stored
from tesserae.plans import estimation
from tesserae.sources import frames
from tesserae.sources.frames import ORDERS_SQL, TASKS_SQL

QUERIES: dict = {}
ORACLES: dict = {}
REPLICATES, SEED = 399, 20261008
SHARES = tuple(range(0, 101))
PATTERN = ["k", "pf", "gf", "cf"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(frames.orders_frame(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH {ORDERS_SQL}, {TASKS_SQL}{sql}"
        return f

    return add


def _patterns(frame: DataFrame) -> DataFrame:
    return accounting.tasks(frame).select("base_id", "k", *[F.col(c).cast("long").alias(c) for c in PATTERN[1:]], F.lit(1).alias("one"))


@query("resampled_families", f" SELECT CAST(rep AS INTEGER) AS rep, (SELECT count(DISTINCT base_id) FROM crit) AS families FROM (SELECT unnest(range(1, {REPLICATES + 1})) AS rep)")
def resampled_families(frame: DataFrame) -> DataFrame:
    """How many families each replicate draws, summed from the counts of the single families: as many as there are."""
    families = frame.select("base_id").distinct().withColumn("one", F.lit(1))
    return resampling.totals(families, "base_id", [], "one", REPLICATES, SEED).select("rep", F.col("n").alias("families"))


def curves(hist: DataFrame, shares: tuple[int, ...] = SHARES) -> DataFrame:
    """(rep, share, introduced, delayed, delta) per hundred tasks from patterns with their numbers n; total and drawn criteria are those of the replicate."""
    total = hist.groupBy("rep").agg(F.sum(F.col("k") * F.col("n")).cast("long").alias("total"), F.sum("n").alias("units"))
    caps = total.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).withColumn("drawn", F.bround(F.col("share") * F.col("total") / 100).cast("long"))
    live = hist.where("pf > 0 AND pf < k AND (gf = 0 OR cf = 0)")  # the others have no chance of either event
    sums = estimation._events(live.join(caps, "rep")).groupBy("rep", "share").agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in "AD"])
    rows = caps.join(sums, ["rep", "share"], "left").withColumnsRenamed({"A": "early", "D": "late"})
    part = lambda c: 100 * F.coalesce(c, F.lit(0.0)) / F.col("units")
    return rows.select("rep", "share", "total", part("early").alias("introduced"), part("late").alias("delayed"), (part("late") - part("early")).alias("delta"))


@query("cluster_curve_bands")
def cluster_curve_bands(frame: DataFrame) -> DataFrame:
    """The expected update curve over 101 budgets, with what 399 draws of whole families make of it.

    Each replicate has its own totals. Pointwise quantiles, and a band as wide as the 95 % quantile of the largest deviation of a
    replicate's curve from the original one.
    """
    patterns = stored(_patterns(frame), "patterns")
    drawn = stored(curves(resampling.totals(patterns, "base_id", PATTERN, "one", REPLICATES, SEED)), "curves")
    hist = patterns.groupBy(*PATTERN).agg(F.count("*").alias("n")).withColumn("rep", F.lit(0))
    original = curves(hist).select("share", F.col("delta").alias("original"))
    point = drawn.groupBy("share").agg(*[F.expr(f"percentile(delta, {q})").alias(name) for q, name in ((0.025, "low"), (0.5, "median"), (0.975, "high"))])
    radius = drawn.join(F.broadcast(original), "share").groupBy("rep").agg(F.max(F.abs(F.col("delta") - F.col("original"))).alias("far")).agg(F.expr("percentile(far, 0.95)").alias("radius"))  # 101 rows
    rows = original.join(point, "share").crossJoin(F.broadcast(radius))  # one row
    r = lambda c: F.round(c, 9)
    return rows.select("share", *[r(F.col(c)).alias(c) for c in ("original", "low", "median", "high")], r(F.col("original") - F.col("radius")).alias("band_low"), r(F.col("original") + F.col("radius")).alias("band_high"))


def scored(hist: DataFrame, fitted: DataFrame, share: float = 0.2) -> DataFrame:
    """(rep, producer, forecast, observed) per hundred units, from patterns of producers with their numbers n.

    fitted has the pilot's rates for (producer, k, pf), which stay; totals and units are the replicate's.
    """
    total = hist.groupBy("rep", "producer").agg(F.sum("n").alias("units"), F.sum(F.col("k") * F.col("n")).cast("long").alias("total")).withColumn("drawn", F.bround(F.col("total") * F.lit(int(share * 10)) / 10).cast("long"))
    happened = estimation._events(hist.join(total, ["rep", "producer"])).groupBy("rep", "producer").agg((100 * F.sum(F.col("n") * (F.col("D") - F.col("A"))) / F.max("units")).alias("observed"))
    cells = hist.where("pf > 0 AND pf < k").groupBy("rep", "producer", "k", "pf").agg(F.sum("n").alias("n")).join(F.broadcast(fitted.select("producer", "k", "pf", "q_pass", "q_fail")), ["producer", "k", "pf"])  # a row for each kind of target
    cells = cells.join(total, ["rep", "producer"]).withColumn("rf", F.explode(F.sequence(F.lit(0), (F.col("k") - F.col("pf")).cast("int"))))
    said = cells.groupBy("rep", "producer").agg((100 * F.sum(F.col("n") * estimation.margin_term()) / F.max("units")).alias("forecast"))
    return happened.join(said, ["rep", "producer"], "left").withColumn("forecast", F.coalesce("forecast", F.lit(0.0)))


@query("forecast_mae_interval")
def forecast_mae_interval(frame: DataFrame) -> DataFrame:
    """The margin forecast's mean absolute error, its bias, and their ranges over 399 draws of whole families beyond the pilot.

    The pilot's fit never changes; every replicate has its own totals, forecasts and exact outcomes.
    """
    later = stored(estimation.units(frame).where("NOT pilot").select("base_id", "producer", *PATTERN, F.lit(1).alias("one")), "later-units")
    fitted = stored(estimation.ladder(frame), "fitted")
    drawn = resampling.totals(later, "base_id", ["producer", *PATTERN], "one", REPLICATES, SEED)
    own = later.groupBy("producer", *PATTERN).agg(F.count("*").alias("n")).withColumn("rep", F.lit(0))
    rows = scored(own.select("producer", *PATTERN, "rep", F.col("n").cast("long").alias("n")).unionByName(drawn), fitted)
    off = F.col("forecast") - F.col("observed")
    by_rep = stored(rows.groupBy("rep").agg(F.avg(F.abs(off)).alias("mae"), F.avg(off).alias("bias"), F.count("*").alias("producers")), "errors")
    long = by_rep.select("rep", "producers", F.explode(F.create_map(F.lit("mae"), F.col("mae"), F.lit("bias"), F.col("bias"))).alias("measure", "value"))
    r = lambda c: F.round(c, 9)
    out = long.groupBy("measure").agg(F.max(F.when(F.col("rep") == 0, F.col("value"))).alias("point"), F.expr("percentile(CASE WHEN rep > 0 THEN value END, 0.025)").alias("low"), F.expr("percentile(CASE WHEN rep > 0 THEN value END, 0.975)").alias("high"), F.min("producers").alias("least_producers"), F.count_if(F.col("rep") > 0).alias("replicates"))
    return out.select("measure", r("point").alias("point"), r("low").alias("low"), r("high").alias("high"), "least_producers", "replicates")
