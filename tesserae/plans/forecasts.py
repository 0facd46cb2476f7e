"""Queries on forecasts of the update margin at every budget, combined inference over strata, and strict loading of paired sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import exact
from tesserae.operators import ranking
from tesserae.operators.storage import stored
from tesserae.plans import estimation
from tesserae.sources import frames
from tesserae.sources.frames import ORDERS_SQL, TASKS_SQL

QUERIES: dict = {}
ORACLES: dict = {}
SHARES = tuple(range(0, 101, 5))
LEAST = estimation.LEAST


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(frames.orders_frame(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH {ORDERS_SQL}, {TASKS_SQL}{sql}"
        return f

    return add


def _r(c):
    return F.round(c, 9)


# ---------------------------------------------------------------- donor pools and predictors


def _patterns(units: DataFrame) -> DataFrame:
    """Patterns of mixed pilot units, with how many have each: a small table."""
    return units.where("pilot AND pf > 0 AND pf < k").groupBy("producer", "k", "pf", "gf", "cf").agg(F.count("*").alias("count"))


def _rates(pools: DataFrame) -> DataFrame:
    return pools.withColumns({"q_pass": (F.col("pass_fails") + 0.5) / (F.col("passes") + 1), "q_fail": (F.col("fail_fails") + 0.5) / (F.col("fails") + 1)})


def predictions(frame: DataFrame, shares: tuple[int, ...] = SHARES) -> DataFrame:
    return predictions_of(stored(estimation.units(frame), "units"), shares)


def predictions_of(u: DataFrame, shares: tuple[int, ...] = SHARES) -> DataFrame:
    """(producer, share, predictor, early, late, forecast) per hundred later units, from the pilot's fit and unlabelled units; u: stored units.

    task_linked averages the event chances of the patterns in a target's pool; matched_margin takes the pool's two rates as
    independent; producer_margin takes those of the producer's pool, or of all where it has too few families; zero forecasts nothing.
    """
    fitted = stored(estimation.ladder_of(u), "fitted")
    pools = stored(_rates(estimation.pools_of(u)), "pools")
    later = u.where("NOT pilot").groupBy("producer").agg(F.count("*").alias("units"), F.sum("k").alias("total"))
    caps = later.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("drawn", F.bround(F.col("share") * F.col("total") / 100).cast("long"))
    caps = F.broadcast(caps)  # a row for each producer and share
    # linked: each target's pool by its patterns, whose own sizes go into the chances
    p = _patterns(u).select(*[F.col(c).alias(f"p_{c}") for c in ("producer", "k", "pf", "gf", "cf", "count")])
    level = F.col("level")
    fits = (level == 7) | ((F.col("p_k") == F.col("k")) & ((level == 5) | ((F.col("p_pf") == F.col("pf")) & ((level == 4) | (F.col("p_producer") == F.col("producer"))))))
    inside = fitted.select("producer", "k", "pf", "n", "level").join(F.broadcast(p), fits)  # patterns are few
    target = inside.select("producer", F.struct("k", "pf").alias("target"), "n", *[F.col(f"p_{c}").alias(c) for c in ("k", "pf", "gf", "cf", "count")]).join(caps, "producer")
    mean = lambda c: F.sum(F.col("count") * F.col(c)) / F.sum("count")
    linked = estimation._events(target).groupBy("producer", "share", "units", "target", "n").agg(mean("A").alias("early"), mean("D").alias("late"))
    # margins: reference failures among predicted passes are summed out
    own = F.broadcast(pools.where((F.col("level") == 3) & (F.col("n_clusters") >= LEAST)).select("producer", F.col("q_pass").alias("o_pass"), F.col("q_fail").alias("o_fail")))
    every = F.broadcast(pools.where("level = 7").select(F.col("q_pass").alias("e_pass"), F.col("q_fail").alias("e_fail")))
    both = fitted.join(own, "producer", "left").crossJoin(every)  # one row
    matched = both.select("producer", "k", "pf", "n", "q_pass", "q_fail", F.lit("matched_margin").alias("predictor"))
    simple = both.select("producer", "k", "pf", "n", F.coalesce("o_pass", "e_pass").alias("q_pass"), F.coalesce("o_fail", "e_fail").alias("q_fail"), F.lit("producer_margin").alias("predictor"))
    cells = matched.unionByName(simple).join(caps, "producer").withColumn("rf", F.explode(F.sequence(F.lit(0), (F.col("k") - F.col("pf")).cast("int"))))
    term = estimation.margin_term()
    cells = cells.withColumns({"late": F.when(F.col("rf") == 0, F.greatest(term, F.lit(0.0))).otherwise(0.0), "early": F.when(F.col("rf") > 0, -term).otherwise(0.0)})
    rows = cells.select("producer", "share", "units", "predictor", "n", "early", "late").unionByName(linked.select("producer", "share", "units", F.lit("task_linked").alias("predictor"), "n", "early", "late"))
    rows = rows.unionByName(caps.select("producer", "share", "units", F.lit("zero").alias("predictor"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("early"), F.lit(0.0).alias("late")))
    part = lambda c: 100 * F.sum(F.col("n") * F.col(c)) / F.max("units")
    out = rows.groupBy("producer", "share", "predictor").agg(part("early").alias("early"), part("late").alias("late"))
    return out.withColumn("forecast", F.col("late") - F.col("early"))


_A = estimation._A
_D = estimation._D
_SHARES_SQL = f", fs AS (SELECT producer, count(*) AS units, CAST(sum(k) AS BIGINT) AS total, share, CAST(round_even(share * sum(k) / 100.0, 0) AS BIGINT) AS drawn FROM units, (SELECT unnest([{', '.join(map(str, SHARES))}]) AS share) WHERE NOT pilot GROUP BY producer, share)"
_EVENT = exact.event_sql
_PREDICT = f"""{estimation._SPLIT}{estimation._UNITS}{estimation._POOLS}{estimation._LADDER}{_SHARES_SQL},
    fit AS (SELECT * FROM chosen WHERE place = 1), pp AS (SELECT producer AS p_producer, k AS p_k, pf AS p_pf, gf AS p_gf, cf AS p_cf, count(*) AS c FROM units WHERE pilot AND pf > 0 AND pf < k GROUP BY ALL),
    lk AS (SELECT producer, share, units, n, tk, tpf, sum(c * ({_A})) / sum(c) AS early, sum(c * ({_D})) / sum(c) AS late FROM (SELECT t.producer, t.n, t.k AS tk, t.pf AS tpf, p_k AS k, p_pf AS pf, p_gf AS gf, p_cf AS cf, c, share, units, total, drawn
        FROM fit t JOIN fs ON fs.producer = t.producer JOIN pp ON t.level = 7 OR (p_k = t.k AND (t.level = 5 OR (p_pf = t.pf AND (t.level = 4 OR p_producer = t.producer))))) GROUP BY producer, share, units, n, tk, tpf),
    ow AS (SELECT producer, (pass_fails + 0.5) / (passes + 1) AS o_pass, (fail_fails + 0.5) / (fails + 1) AS o_fail FROM pools WHERE level = 3 AND n_clusters >= {LEAST}), ev AS (SELECT (pass_fails + 0.5) / (passes + 1) AS e_pass, (fail_fails + 0.5) / (fails + 1) AS e_fail FROM pools WHERE level = 7),
    mg AS (SELECT producer, k, pf, n, q_pass, q_fail, 'matched_margin' AS predictor FROM fit UNION ALL SELECT f.producer, k, pf, n, coalesce(o_pass, e_pass), coalesce(o_fail, e_fail), 'producer_margin' FROM fit f LEFT JOIN ow ON ow.producer = f.producer, ev),
    ce AS (SELECT m.*, share, units, total, drawn, unnest(range(0, m.k - m.pf + 1)) AS rf FROM mg m JOIN fs ON fs.producer = m.producer),
    tm AS (SELECT producer, share, units, predictor, n, CASE WHEN rf = 0 THEN greatest(pow(1 - q_fail, pf) * pow(1 - q_pass, k - pf) * ({_EVENT('total', 'drawn', 'pf', '0')} - {_EVENT('total', 'drawn', 'k', '0')}), 0.0) ELSE 0.0 END AS late,
        CASE WHEN rf > 0 THEN pow(1 - q_fail, pf) * coalesce(list_product([(k - pf - j)::DOUBLE / (j + 1) FOR j IN range(rf)]), 1.0) * pow(q_pass, rf) * pow(1 - q_pass, k - pf - rf) * {_EVENT('total', 'drawn', 'pf', 'rf')} ELSE 0.0 END AS early FROM ce),
    al AS (SELECT producer, share, units, predictor, n, early, late FROM tm UNION ALL SELECT producer, share, units, 'task_linked', n, early, late FROM lk UNION ALL SELECT producer, share, units, 'zero', 0, 0.0, 0.0 FROM fs),
    pr AS (SELECT producer, share, predictor, 100 * sum(n * early) / max(units) AS early, 100 * sum(n * late) / max(units) AS late FROM al GROUP BY 1, 2, 3)"""


@query("forecast_frame", f"{_PREDICT} SELECT producer, share, predictor, round(early, 6) AS early, round(late, 6) AS late, round(late - early, 6) AS forecast FROM pr")
def forecast_frame(frame: DataFrame) -> DataFrame:
    """Four predictors of the update margin for every producer and share; see predictions_of()."""
    rows = predictions(frame)
    return rows.select("producer", "share", "predictor", *[F.round(c, 6).alias(c) for c in ("early", "late", "forecast")])


_OUTCOMES = f""", oc AS (SELECT producer, share, 100 * sum(({_D}) - ({_A})) / max(units) AS observed FROM (SELECT u.*, share, units, total, drawn FROM units u JOIN fs ON fs.producer = u.producer WHERE NOT pilot) GROUP BY 1, 2)"""


@query("forecast_comparison", f"""{_PREDICT}{_OUTCOMES} SELECT predictor, count(*) AS cells, round(avg(abs(late - early - observed)), 6) AS mae, round(avg(late - early - observed), 6) AS bias, count(*) FILTER (abs(late - early) < 1) AS near_zero, count(*) FILTER (abs(late - early) >= 1) AS material,
    count(*) FILTER (abs(late - early) >= 1 AND (late - early) * observed < 0) AS opposite_sign FROM pr JOIN oc USING (producer, share) GROUP BY 1""")
def forecast_comparison(frame: DataFrame) -> DataFrame:
    """Each predictor held against the exact outcomes over producers and shares: error, bias, and forecasts near zero, material, of the wrong sign."""
    every = stored(estimation.units(frame), "units")
    u = every.where("NOT pilot")
    later = u.groupBy("producer").agg(F.count("*").alias("units"), F.sum("k").alias("total"))
    caps = later.withColumn("share", F.explode(F.array(*map(F.lit, SHARES)))).withColumn("drawn", F.bround(F.col("share") * F.col("total") / 100).cast("long"))
    hist = u.groupBy("producer", "k", "pf", "gf", "cf").agg(F.count("*").alias("n"))
    seen = estimation._events(hist.join(F.broadcast(caps), "producer")).groupBy("producer", "share").agg((100 * F.sum(F.col("n") * (F.col("D") - F.col("A"))) / F.max("units")).alias("observed"))
    rows = predictions_of(every).join(seen, ["producer", "share"])
    off, size = F.col("forecast") - F.col("observed"), F.abs("forecast")
    return rows.groupBy("predictor").agg(
        F.count("*").alias("cells"), F.round(F.avg(F.abs(off)), 6).alias("mae"), F.round(F.avg(off), 6).alias("bias"), F.count_if(size < 1).alias("near_zero"), F.count_if(size >= 1).alias("material"),
        F.count_if((size >= 1) & (F.col("forecast") * F.col("observed") < 0)).alias("opposite_sign"),
    )


_NAMES = {0: "producer_k_pf", 4: "k_pf", 5: "k", 7: "all", 3: "producer"}
_POOL_NAME = "CASE level " + " ".join(f"WHEN {level} THEN '{name}'" for level, name in _NAMES.items()) + " END"


@query("donor_pool_levels", f"{estimation._SPLIT}{estimation._UNITS}{estimation._POOLS}, nm AS (SELECT {_POOL_NAME} AS pool, n_units, n_clusters, (pass_fails + 0.5) / (passes + 1) AS q_pass, (fail_fails + 0.5) / (fails + 1) AS q_fail FROM pools UNION ALL SELECT 'k_any_pf', n_units, n_clusters, (pass_fails + 0.5) / (passes + 1), (fail_fails + 0.5) / (fails + 1) FROM pools WHERE level = 5) SELECT pool, count(*) AS pools, CAST(sum(n_units) AS BIGINT) AS units, count(*) FILTER (n_clusters >= {LEAST}) AS supported, round(min(q_pass), 9) AS least_q_pass, round(max(q_fail), 9) AS most_q_fail FROM nm GROUP BY 1")
def donor_pool_levels(frame: DataFrame) -> DataFrame:
    """The six levels of donor pools with their support. k_any_pf and k are one set of units, as units of pf 0 and k are never fitted."""
    rows = _rates(estimation.pools(frame)).withColumn("pool", F.expr(_POOL_NAME))
    rows = rows.unionByName(rows.where("level = 5").withColumn("pool", F.lit("k_any_pf")))
    return rows.groupBy("pool").agg(F.count("*").alias("pools"), F.sum("n_units").alias("units"), F.count_if(F.col("n_clusters") >= LEAST).alias("supported"), _r(F.min("q_pass")).alias("least_q_pass"), _r(F.max("q_fail")).alias("most_q_fail"))


# ---------------------------------------------------------------- combined inference over strata

Z = 1.959963984540054


@query("combined_interval")
def combined_interval(frame: DataFrame) -> DataFrame:
    """One interval for each producer's agreement from a pilot and a sample of what it left in each stratum.

    The pilot's criteria are known; of the rest of each stratum of predictions a hashed sample is drawn. Exact bounds of the strata that
    weren't read whole, at the level shared out over them, are summed with the pilot's hits. The normal interval is null where a sampled
    stratum has under two draws, the estimate where one has none. covers: whether the exact one holds the truth.
    """
    key = ranking.priority("combined", 1, "task_id", "slot")
    rows = frame.select("producer", "prediction", (F.col("gold") == F.col("prediction")).alias("hit"), key.alias("key"))
    pilot, drawn = F.col("key") < "08", F.col("key") < "30"
    per = rows.groupBy("producer", "prediction").agg(
        F.count_if(pilot & F.col("hit")).alias("known"), F.count("*").alias("size"), F.count_if("hit").alias("hits"), F.count_if(~pilot).alias("population"), F.count_if(~pilot & drawn).alias("drawn"), F.count_if(~pilot & drawn & F.col("hit")).alias("seen"),
    )
    per = stored(per, "strata")
    open_ = per.where("drawn < population")
    count = open_.groupBy("producer").agg(F.count("*").cast("int").alias("strata"))
    out = None
    for strata in (1, 2):  # predictions are bits; a level for each number of strata that weren't read whole
        some = open_.join(count.where(F.col("strata") == strata), "producer", "left_semi")
        part = estimation.with_intervals(some, str(0.05 / strata))
        out = part if out is None else out.unionByName(part)
    whole = per.where("drawn = population").withColumns({"lower": F.col("seen"), "upper": F.col("seen")})
    every = out.unionByName(whole.select(*out.columns))
    n, big, x = F.col("drawn"), F.col("population"), F.col("seen")
    part = F.when(n == big, 0.0).when(n >= 2, big * big * (1 - n / big) * (x * (n - x) / (n * (n - 1))) / n)
    agg = every.groupBy("producer").agg(
        F.sum("size").alias("total"), F.sum("hits").alias("hits"), F.sum(F.col("known") + F.col("lower")).alias("lower"), F.sum(F.col("known") + F.col("upper")).alias("upper"),
        F.when(F.count_if((n == 0) & (big > 0)) == 0, F.sum(F.col("known") + F.when(n > 0, big * x / n).otherwise(0.0))).alias("estimate"), F.when(F.count_if(part.isNull()) == 0, F.sum(part)).alias("variance"),
    )
    m, half = F.col("total"), Z * F.sqrt("variance") / F.col("total")
    value = F.col("estimate") / m
    return agg.select(
        "producer", "total", _r(value).alias("estimate"), _r(F.col("lower") / m).alias("ci_lower"), _r(F.col("upper") / m).alias("ci_upper"),
        _r(F.greatest(F.lit(0.0), value - half)).alias("normal_lower"), _r(F.least(F.lit(1.0), value + half)).alias("normal_upper"), F.col("hits").between(F.col("lower"), F.col("upper")).alias("covers"),
    )


# ---------------------------------------------------------------- seeds

SEEDS = tuple(range(1, 33))


@query("seed_accuracy", f""", u AS (SELECT seed, count(*) AS n, count(*) FILTER (gold = prediction) AS a FROM crit, (SELECT unnest(range(1, {len(SEEDS) + 1})) AS seed) WHERE sha256('accuracy|' || seed || '|' || task_id || '|' || slot) < '33' GROUP BY 1),
    t AS (SELECT avg(CASE WHEN gold = prediction THEN 1.0 ELSE 0.0 END) AS truth FROM crit), e AS (SELECT seed, n, a / n AS est, a / n - truth AS err, {Z} * sqrt((1 - n / (SELECT count(*) FROM crit)) * (a / n) * (1 - a / n) / (n - 1)) AS half FROM u, t)
    SELECT count(*) AS seeds, round(quantile_cont(est, 0.5), 9) AS median, round(quantile_cont(est, 0.05), 9) AS p05, round(quantile_cont(est, 0.95), 9) AS p95, round(avg(err), 9) AS bias, round(sqrt(avg(err * err)), 9) AS rmse, count(*) FILTER (abs(err) <= 0.005) AS within_half_point, count(*) FILTER (abs(err) <= half) AS covered FROM e""")
def seed_accuracy(frame: DataFrame) -> DataFrame:
    """Agreement from hashed fifths over 32 seeds: median and percentiles, bias, root mean square error, how many are near, how many cover."""
    hit = (F.col("gold") == F.col("prediction")).cast("int")
    rows = frame.select("task_id", "slot", hit.alias("hit"), F.explode(F.array(*map(F.lit, SEEDS))).alias("seed"))
    drawn = F.sha2(F.concat_ws("|", F.lit("accuracy"), "seed", "task_id", "slot"), 256) < "33"
    per = rows.where(drawn).groupBy("seed").agg(F.count("*").alias("n"), F.sum("hit").alias("a"))
    truth = frame.agg(F.avg(hit.cast("double")).alias("truth"), F.count("*").alias("m"))
    per = per.crossJoin(F.broadcast(truth))  # one row
    n, p = F.col("n"), F.col("a") / F.col("n")
    per = per.withColumns({"est": p, "err": p - F.col("truth"), "half": Z * F.sqrt((1 - n / F.col("m")) * p * (1 - p) / (n - 1))})
    q = lambda c: _r(F.percentile("est", c))
    return per.agg(
        F.count("*").alias("seeds"), q(0.5).alias("median"), q(0.05).alias("p05"), q(0.95).alias("p95"), _r(F.avg("err")).alias("bias"), _r(F.sqrt(F.avg(F.col("err") * F.col("err")))).alias("rmse"),
        F.count_if(F.abs("err") <= 0.005).alias("within_half_point"), F.count_if(F.abs("err") <= F.col("half")).alias("covered"),
    )
