"""Contrasts over seeds and configurations, signs of corrections, recovered counts, channel sets, ledger states and retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import accounting, ranking, storage
from tesserae.plans import grid
from tesserae.sources import frames
from tesserae.sources.frames import ORDERS_SQL

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str, frame: bool = False, swept: bool = False):
    """Register f(spark, sf_dir), or f(frame) over the stored orders frame, whose SQL may use crit; swept: f takes curves of it or packed tasks."""
    made = grid.packed_orders if swept else grid.stored_frame

    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(made(spark, sf_dir))) if frame else f
        ORACLES[name] = f"WITH {ORDERS_SQL}, {sql}" if frame else sql
        return f

    return add


def big(c):
    return F.sum(c).cast("long")


# ---------------------------------------------------------------- contrasts over seeds and configurations

_PAIR = ("sc_disagreement", "random_criterion")
_PAIR_ORDERS = ("release", "random")
_PAIR_SEEDS = grid.SEEDS
_PAIR_SHARES = (5, 10, 20, 30, 40, 50, 60, 70, 80, 90)


@query("mechanism_summary", f"""{grid.curves_sql(_PAIR, _PAIR_ORDERS, _PAIR_SEEDS, _PAIR_SHARES)}, ps AS (SELECT task_order, share, seed, a.C AS ca, b.C AS cb, a.eager_errors AS ea, b.eager_errors AS eb, a.C - b.C AS dc, a.eager_errors - b.eager_errors AS de, a.gate_errors - b.gate_errors AS dg, (a.C - a.CW) - (b.C - b.CW) AS di
    FROM gr a JOIN gr b USING (task_order, share, seed) WHERE a.policy = '{_PAIR[0]}' AND b.policy = '{_PAIR[1]}')
    SELECT task_order, share, count(*) AS seeds, round(avg(dc), 9) AS certified_mean, round(quantile_cont(dc, 0.5), 9) AS certified_paired_median, round(quantile_cont(ca, 0.5) - quantile_cont(cb, 0.5), 9) AS certified_marginal_medians,
    round(avg(de), 9) AS eager_mean, round(quantile_cont(de, 0.5), 9) AS eager_paired_median, round(quantile_cont(ea, 0.5) - quantile_cont(eb, 0.5), 9) AS eager_marginal_medians, round(avg(dg), 9) AS gated_mean,
    round(CASE WHEN sum(dc) > 0 THEN sum(di) / sum(dc) END, 9) AS initial_correct_share, CASE WHEN sum(dc) > 0 THEN sum(di) / sum(dc) > 0.5 END AS initial_correct_majority, count(*) FILTER (dc > 0) AS gains, count(*) FILTER (dc > 0 AND de >= 0) AS gains_without_fewer_errors,
    count(*) FILTER (dc > 0 AND de > 0) AS gains_with_more_errors, count(*) FILTER (de < 0) AS better, count(*) FILTER (de = 0) AS equal, count(*) FILTER (de > 0) AS worse FROM ps GROUP BY 1, 2""", frame=True, swept=True)
def mechanism_summary(frame: DataFrame) -> DataFrame:
    """Two policies paired by seed: means, paired medians against differences of marginal medians, and how seeds divide.

    Shares of a gain are null unless there is a gain. Pairs are made by one aggregation of the grid's rows, not by a join.
    """
    of = lambda c, p: F.max(F.when(F.col("policy") == p, F.col(c)))
    rows = grid.curves(frame, _PAIR, _PAIR_ORDERS, _PAIR_SEEDS, _PAIR_SHARES).withColumn("I", F.col("C") - F.col("CW"))
    names = {"C": "c", "eager_errors": "e", "gate_errors": "g", "I": "i"}
    rows = rows.groupBy("task_order", "share", "seed").agg(*[of(c, p).alias(n + s) for c, n in names.items() for p, s in zip(_PAIR, "ab", strict=True)])
    rows = rows.withColumns({f"d{n}": F.col(f"{n}a") - F.col(f"{n}b") for n in names.values()})
    mid = lambda c: F.percentile(c, 0.5)
    r = lambda c, name: F.round(c, 9).alias(name)
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    share = F.when(F.sum("dc") > 0, F.sum("di") / F.sum("dc"))
    return rows.groupBy("task_order", "share").agg(
        F.count("*").alias("seeds"), r(F.avg("dc"), "certified_mean"), r(mid("dc"), "certified_paired_median"), r(mid("ca") - mid("cb"), "certified_marginal_medians"),
        r(F.avg("de"), "eager_mean"), r(mid("de"), "eager_paired_median"), r(mid("ea") - mid("eb"), "eager_marginal_medians"), r(F.avg("dg"), "gated_mean"),
        r(share, "initial_correct_share"), (share > 0.5).alias("initial_correct_majority"), n("dc > 0", "gains"), n("dc > 0 AND de >= 0", "gains_without_fewer_errors"), n("dc > 0 AND de > 0", "gains_with_more_errors"),
        n("de < 0", "better"), n("de = 0", "equal"), n("de > 0", "worse"),
    )


_CROSS_SHARES = tuple(range(0, 101, 10))
_HYBRID, _STRONG = (grid.curves_sql((p,), ("random",), (1,), _CROSS_SHARES) for p in ("sc_disagreement", "sc_judge"))


@query("configuration_contrast", f"""ha AS (WITH {_HYBRID} SELECT * FROM gr), other AS (SELECT * EXCLUDE (prediction, second), second AS prediction, prediction AS second FROM crit),
    hb AS (WITH crit AS (SELECT * FROM other), {_STRONG} SELECT * FROM gr)
    SELECT a.share, a.cap = b.cap AS same_cap, a.actual_queries AS queries_a, b.actual_queries AS queries_b, a.C - b.C AS d_certified, a.eager_errors - b.eager_errors AS d_eager, a.gate_errors - b.gate_errors AS d_gate FROM ha a JOIN hb b ON a.share = b.share""", frame=True)
def configuration_contrast(frame: DataFrame) -> DataFrame:
    """One primary with disagreement first against another primary with its own order, on the same tasks and budgets."""
    other = frame.withColumns({"prediction": F.col("secondary")[0], "secondary": F.array("prediction")})
    keep = ["cap", "actual_queries", "C", "eager_errors", "gate_errors"]
    a, b = (grid.curves(f, (p,), ("random",), (1,), _CROSS_SHARES).select("share", *[F.col(c).alias(c + s) for c in keep]) for f, p, s in ((frame, "sc_disagreement", "_a"), (other, "sc_judge", "_b")))
    d = lambda c, name: (F.col(c + "_a") - F.col(c + "_b")).alias(name)
    return a.join(b, "share").select("share", F.expr("cap_a = cap_b").alias("same_cap"), F.col("actual_queries_a").alias("queries_a"), F.col("actual_queries_b").alias("queries_b"), d("C", "d_certified"), d("eager_errors", "d_eager"), d("gate_errors", "d_gate"))


@query("saved_controls", f"""{ranking.transcript_sql('random_criterion')}, {accounting.curve_sql()} SELECT share, C AS certified, eager_errors, gate_errors, CAST(1 AS BIGINT) AS saved, true AS equal FROM cv""", frame=True)
def saved_controls(frame: DataFrame) -> DataFrame:
    """The control of a study made anew, against the same control saved by another plan, joined one to one."""
    fields = ["C", "eager_errors", "gate_errors"]
    saved = storage.stored(accounting.random_curve(frame).select("share", *fields), "controls")
    saved = saved.groupBy("share").agg(F.count("*").alias("saved"), *[F.max(c).alias(f"s_{c}") for c in fields])
    new = grid.curves(frame, ("random_criterion",), ("random",), (1,), accounting.SHARES).select("share", *fields)
    same = F.expr(" AND ".join(f"{c} <=> s_{c}" for c in fields))
    return new.join(saved, "share", "full_outer").select("share", F.col("C").alias("certified"), "eager_errors", "gate_errors", F.coalesce("saved", F.lit(0).cast("long")).alias("saved"), same.alias("equal"))


_SIGN_POLICIES = ("sc_judge", "sc_random", "random_criterion")
_SIGN = "CASE WHEN 100 * lo > 1e-9 THEN 'positive' WHEN 100 * hi < -1e-9 THEN 'negative' WHEN greatest(abs(100 * lo), abs(100 * hi)) < 1e-9 THEN 'zero' ELSE 'unresolved' END"


@query("correction_signs", f"""{grid.curves_sql(_SIGN_POLICIES, ('random',), (1,))}, tk AS (SELECT min(prediction) AS p FROM crit GROUP BY task_id), t AS (SELECT count(*) AS n, sum(p) AS passed FROM tk),
    x AS (SELECT policy, share, (certified_pass - passed) / n AS lo, (n - certified_fail - passed) / n AS hi FROM gr, t) SELECT policy, share, round(100 * lo, 9) AS least, round(100 * hi, 9) AS most, {_SIGN} AS sign FROM x""", frame=True, swept=True)
def correction_signs(frame: DataFrame) -> DataFrame:
    """Which way the primary's pass rate would have to be corrected, as far as the certified tasks of each budget tell."""
    if "codes" in frame.columns:  # 2: the prediction's bit
        tasks = frame.select(F.forall("codes", lambda c: c.bitwiseAND(F.lit(2).cast("tinyint")) == 2).cast("int").alias("p"))
    else:
        tasks = frame.groupBy("task_id").agg(F.min("prediction").alias("p"))
    tasks = tasks.agg(F.count("*").alias("n"), F.sum("p").alias("passed"))
    rows = grid.curves(frame, _SIGN_POLICIES, ("random",), (1,)).crossJoin(F.broadcast(tasks))  # one row
    rows = rows.selectExpr("policy", "share", "(certified_pass - passed) / n AS lo", "(n - certified_fail - passed) / n AS hi")
    return rows.selectExpr("policy", "share", "round(100 * lo, 9) AS least", "round(100 * hi, 9) AS most", f"{_SIGN} AS sign")


# ---------------------------------------------------------------- recovered counts


@query("recovered_counts", """s AS (SELECT producer, count(*) AS m, count(*) FILTER (prediction = 0) AS a, count(*) FILTER (prediction = 0 AND gold = 0) AS ca, count(*) FILTER (prediction = 1 AND r) AS n, count(*) FILTER (prediction = 1 AND r AND gold = 1) AS x
    FROM (SELECT *, substr(sha256('saved|' || task_id || '|' || slot), 1, 1) < '4' AS r FROM crit) GROUP BY 1)
    SELECT producer, m, a, n, CASE WHEN n > 0 AND n < m - a THEN x END AS first_count, CASE WHEN n > 0 AND n < m - a THEN ca END AS second_count, n > 0 AND n < m - a AS sound FROM s""", frame=True)
def recovered_counts(frame: DataFrame) -> DataFrame:
    """The counts behind a saved estimate (correct of all flagged and of a sample of the others), recovered by algebra from the estimate.

    They are sound if whole to 1e-6 and possible. A census, or no sample, leaves them undetermined.
    """
    rows = frame.withColumn("r", F.sha2(F.concat_ws("|", F.lit("saved"), "task_id", "slot"), 256) < "4")
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    saved = rows.groupBy("producer").agg(F.count("*").alias("m"), n("prediction = 0", "a"), n("prediction = 1 AND r", "n"), n("prediction = gold AND (prediction = 0 OR r)", "correct"), n("prediction = 0 AND gold = 0", "ca"))
    saved = saved.selectExpr("producer", "m", "a", "n", "correct", "n > 0 AND n < m - a AS open", "(ca + (correct - ca) * (m - a) / n) / m AS estimate").drop("ca")
    real = saved.withColumn("real", F.expr("CASE WHEN open THEN (estimate * m - correct) / ((m - a) / n - 1) END")).withColumn("x", F.round("real").cast("long"))
    sound = F.expr("open AND abs(real - x) <= 1e-6 AND x BETWEEN 0 AND n AND correct - x BETWEEN 0 AND a")
    return real.select("producer", "m", "a", "n", F.col("x").alias("first_count"), (F.col("correct") - F.col("x")).alias("second_count"), sound.alias("sound"))


# ---------------------------------------------------------------- channels, paths, positions

_BIT = "1 << (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1)"


@query("channel_subsets", f"WITH m AS (SELECT o_custkey, bit_or({_BIT}) AS mask FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1), s AS (SELECT CAST(unnest(range(1, 32)) AS INTEGER) AS subset) SELECT subset, bit_count(subset) AS size, count(m.mask) AS covered, count(*) FILTER (m.mask = subset) AS exactly FROM s LEFT JOIN m ON mask & subset = subset GROUP BY 1, 2")
def channel_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that every channel of a set covers, for all sets of the five channels: families are counted by mask first."""
    rows = frames.table(spark, sf_dir, "orders").where("o_orderpriority IS NOT NULL").groupBy("o_custkey").agg(F.expr(f"bit_or({_BIT})").alias("mask"))
    masks = rows.groupBy("mask").agg(F.count("*").alias("n"))  # 31 rows at most
    sets = spark.range(1, 32).select(F.col("id").cast("int").alias("subset"))
    held = sets.join(F.broadcast(masks), F.col("mask").bitwiseAND(F.col("subset")) == F.col("subset"), "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return held.groupBy("subset").agg(count("n").alias("covered"), count(F.when(F.col("mask") == F.col("subset"), F.col("n"))).alias("exactly")).withColumn("size", F.bit_count("subset").cast("byte"))


_PATH = r"^[a-z][a-z0-9+.-]*://[^/]*/?([^?#]*)"


@query("safe_paths", rf"""WITH p AS (SELECT page_id, regexp_extract(url, '{_PATH}', 1) AS path FROM pages WHERE url IS NOT NULL)
    SELECT page_id, path, path <> '' AND path NOT LIKE '/%' AND NOT contains(path, chr(92)) AND NOT list_has_any(string_split(path, '/'), ['.', '..', '']) AS safe FROM p""")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that stay below a folder when they are joined to it: relative, without back slashes and empty, `.` or `..` parts."""
    pages = frames.table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", F.regexp_extract("url", _PATH, 1).alias("path"))
    bad = F.arrays_overlap(F.split("path", "/"), F.array(F.lit("."), F.lit(".."), F.lit("")))
    safe = (F.col("path") != "") & ~F.col("path").startswith("/") & ~F.contains("path", F.lit("\\")) & ~bad
    return pages.select("page_id", "path", safe.alias("safe"))


MASS = 2.0


@query("first_mass_position", f"""WITH m AS (SELECT vec_id, list_transform(range(0, len(embedding) // 4), lambda j: list_sum(list_transform(embedding[4 * j + 1:4 * j + 4], lambda x: exp(-20 * abs(CAST(x AS DOUBLE)))))) AS mass FROM embeddings),
    w AS (SELECT vec_id, mass, list_filter(range(0, len(mass)), lambda j: mass[j + 1] > {MASS}) AS heavy FROM m) SELECT vec_id, coalesce(CAST(heavy[1] AS INTEGER), -1) AS position, round(mass[heavy[1] + 1], 6) AS mass FROM w""")
def first_mass_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first position of an answer whose candidates hold enough mass, and that mass; -1 and null if none does. Four components stand for a position."""
    part = lambda j: F.aggregate(F.slice("embedding", j * 4 + 1, F.lit(4)), F.lit(0.0), lambda a, x: a + F.exp(-20 * F.abs(x.cast("double"))))
    count = F.floor(F.size("embedding") / 4).cast("int")
    rows = frames.table(spark, sf_dir, "embeddings").select("vec_id", F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), part)).alias("mass"))
    heavy = F.get(F.filter(F.transform("mass", lambda m, j: F.struct(j.alias("position"), m.alias("mass"))), lambda s: s["mass"] > MASS), 0)
    return rows.select("vec_id", F.coalesce(heavy["position"], F.lit(-1)).alias("position"), F.round(heavy["mass"], 6).alias("mass"))


# ---------------------------------------------------------------- ledger states and retries

# an event stands for a reservation, its type and id for what became of it
_COST = "CAST(ceil(CAST(value AS DECIMAL(28, 12)) * 10000000) AS BIGINT)"
_STATE = "CASE WHEN event_type = 'error' THEN 'released' WHEN event_id % 13 = 5 THEN 'unknown' WHEN event_id % 17 = 3 THEN 'inflight' ELSE 'settled' END"
ACCOUNT_CAP = 60_000_000_000


@query("ledger_states", f"""WITH e AS (SELECT user_id, {_COST} AS reserved, {_STATE} AS state FROM events), c AS (SELECT *, CASE state WHEN 'released' THEN 0 WHEN 'settled' THEN reserved - reserved // 8 ELSE reserved END AS charged FROM e)
    SELECT user_id, count(*) AS jobs, CAST(sum(reserved) AS BIGINT) AS reserved, CAST(sum(charged) AS BIGINT) AS charged, count(*) FILTER (state = 'settled') AS settled, count(*) FILTER (state = 'released') AS released, count(*) FILTER (state = 'unknown' OR state = 'inflight') AS kept,
    CAST(coalesce(sum(charged) FILTER (state IN ('unknown', 'inflight')), 0) AS BIGINT) AS kept_charge, sum(charged) <= {ACCOUNT_CAP} AS within FROM c GROUP BY 1""")
def ledger_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each account is charged in the end: a settled reservation its true cost, a released one nothing; one whose reply was lost, or that a crash left in flight, keeps its whole charge."""
    rows = frames.table(spark, sf_dir, "events").selectExpr("user_id", f"{_COST} AS reserved", f"{_STATE} AS state")
    rows = rows.withColumn("charged", F.expr("CASE state WHEN 'released' THEN 0 WHEN 'settled' THEN reserved - reserved DIV 8 ELSE reserved END"))
    kept = F.col("state").isin("unknown", "inflight")
    n = lambda c: F.count_if(c)
    return rows.groupBy("user_id").agg(
        F.count("*").alias("jobs"), big("reserved").alias("reserved"), big("charged").alias("charged"), n(F.col("state") == "settled").alias("settled"), n(F.col("state") == "released").alias("released"), n(kept).alias("kept"),
        F.coalesce(big(F.when(kept, F.col("charged"))), F.lit(0).cast("long")).alias("kept_charge"), (F.sum("charged") <= ACCOUNT_CAP).alias("within"),
    )


ROUNDS = 3
_REPLY = "CASE WHEN (event_id * 31 + round * 15) % 7 < 3 THEN 'retryable' WHEN (event_id * 13 + round) % 19 = 0 THEN 'definite' ELSE 'done' END"


@query("retry_rounds", f"""WITH RECURSIVE r AS (SELECT event_id, 1 AS round, {_REPLY.replace('round', '1')} AS reply FROM events UNION ALL SELECT event_id, round + 1, {_REPLY.replace('round', '(round + 1)')} FROM r WHERE reply = 'retryable' AND round < {ROUNDS})
    SELECT round, count(*) AS submitted, count(*) FILTER (reply = 'done') AS done, count(*) FILTER (reply = 'definite') AS definite, count(*) FILTER (reply = 'retryable') AS retryable, count(*) FILTER (reply = 'retryable' AND round = {ROUNDS}) AS given_up FROM r GROUP BY 1""")
def retry_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs submitted in each of three rounds: only those whose earlier replies were all retryable come again. One pass, no join."""
    replies = F.array(*[F.expr(_REPLY.replace("round", str(k))) for k in range(1, ROUNDS + 1)])
    rows = frames.table(spark, sf_dir, "events").select(replies.alias("r"))
    last = F.array_position(F.transform("r", lambda x: x == "retryable"), False)  # 0 if every round's reply is retryable
    asked = F.slice("r", 1, F.when(last == 0, ROUNDS).otherwise(last).cast("int"))
    rows = rows.select(F.posexplode(asked).alias("at", "reply")).withColumn("round", F.col("at") + 1)
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return rows.groupBy("round").agg(F.count("*").alias("submitted"), n("reply = 'done'", "done"), n("reply = 'definite'", "definite"), n("reply = 'retryable'", "retryable"), n(f"reply = 'retryable' AND round = {ROUNDS}", "given_up"))
