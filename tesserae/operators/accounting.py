"""What a queried prefix tells: certified tasks, eager and gated verdicts, and their errors, at any budget of a transcript.

Along a transcript every outcome of a task holds on one interval of budgets, so a task needs one row and no replay; outcomes at given
budgets are conditional sums over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARES = tuple(range(0, 101, 10))
FIELDS = ("C", "CW", "certified_pass", "certified_fail", "D", "A", "eager_fp", "eager_ff", "U", "tasks_touched", "E0", "eager_errors", "gate_errors", "gate_fp", "gate_ff", "update_delta")


def tasks(frame: DataFrame) -> DataFrame:
    """Snapshot of each task: k, gf and pf (reference and predicted failures), cf (both), truth and initial verdict."""
    g, p = 1 - F.col("gold"), 1 - F.col("prediction")
    agg = frame.groupBy("task_id").agg(F.min("base_id").alias("base_id"), F.min("producer").alias("producer"), F.count("*").alias("k"), F.sum(g).alias("gf"), F.sum(p).alias("pf"), F.sum(g * p).alias("cf"))
    kind = F.when(F.col("gf") == 0, F.when(F.col("pf") == 0, "TP").otherwise("FF")).otherwise(F.when(F.col("pf") == 0, "FP").otherwise("TN"))
    return agg.withColumn("kind", kind).withColumn("susceptible", (F.col("gf") > 0) & (F.col("pf") > 0) & (F.col("cf") == 0))


def times(frame: DataFrame, asked: DataFrame, gold: str = "gold") -> DataFrame:
    """For each task the budgets at which things happen; L is the transcript's length, L + 1 stands for never.

    gold may name another reference column than the one the transcript was made with.
    """
    length = asked.agg(F.count("*").alias("L"))
    return _times(frame.join(asked.select("task_id", "slot", "qnum"), ["task_id", "slot"], "left").crossJoin(F.broadcast(length)), gold)  # one row


def _times(ranks: DataFrame, gold: str) -> DataFrame:
    """times() of criteria with qnum, null for never, and L."""
    never = F.col("L") + 1
    rank, g, p = F.coalesce("qnum", never), F.col(gold), F.col("prediction")
    out = ranks.groupBy("task_id").agg(
        F.max("L").alias("L"), F.min("base_id").alias("base_id"),
        (F.min(g) == 1).alias("truth"), (F.min(p) == 1).alias("initial"), F.min(rank).alias("first"), F.max(rank).alias("last"),
        F.min(F.when(g == 0, rank)).alias("first_fail"), F.max(F.when((g == 0) & (p == 0), 1).otherwise(0)).alias("shared"),
        F.max(F.when((p == 0) & (g == 1), rank).otherwise(0)).alias("repaired"),
        F.min(F.when((p == 1) & (g == 0), rank).otherwise(never)).alias("broken"),
    )
    cert = F.when(F.col("truth"), F.col("last")).otherwise(F.col("first_fail"))
    left = F.when(F.col("shared") == 1, F.col("L") + 1).otherwise(F.col("repaired"))
    return out.select("task_id", "base_id", "L", "truth", "initial", "first", cert.alias("cert"), left.alias("left"), (F.col("broken") - 1).alias("right"))


def at_caps(points: DataFrame, caps: list[int] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """FIELDS at each cap, over all tasks or by keys. points: times(), with a column cap where caps is None."""
    rows = points if caps is None else points.withColumn("cap", F.explode(F.array(*[F.lit(c).cast("long") for c in caps])))
    used = F.least("cap", "L")
    t, i = F.col("truth"), F.col("initial")
    done = F.col("cert") <= used
    inside = lambda start, end: (F.col(start) <= used) & (used <= end)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = rows.groupBy(*keys, "cap").agg(
        n(done).alias("C"), n(done & (t != i)).alias("CW"), n(done & t).alias("certified_pass"),
        n(t & ~i & inside("left", F.col("cert") - 1)).alias("D"), n(~t & ~i & inside("left", F.col("right"))).alias("A"),
        n(~t & inside("left", F.col("right"))).alias("eager_fp"), n(t & (used < F.col("left"))).alias("eager_ff"),
        n(inside("first", F.col("cert") - 1)).alias("U"), n(F.col("first") <= used).alias("tasks_touched"),
        n(t != i).alias("E0"), n(~t & i).alias("_fp"), n(~t & i & done).alias("_fpc"),
    )
    gate, eager = F.col("E0") - F.col("CW"), F.col("eager_fp") + F.col("eager_ff")
    gate_fp = F.col("_fp") - F.col("_fpc")
    return out.withColumns({"certified_fail": F.col("C") - F.col("certified_pass"), "eager_errors": eager, "gate_errors": gate, "gate_fp": gate_fp, "gate_ff": gate - gate_fp, "update_delta": gate - eager}).select(*keys, "cap", *FIELDS)


def share_caps(frame: DataFrame, shares=SHARES) -> DataFrame:
    """(share, cap): budgets for percentages of the criteria, halves to even."""
    one = frame.agg(F.count("*").alias("m"))
    return one.select(F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"), "m").select("share", F.bround(F.col("share") * F.col("m") / 100).cast("long").alias("cap"))


def curve(frame: DataFrame, asked: DataFrame, shares=SHARES, gold: str = "gold") -> DataFrame:
    """FIELDS for each share. The shares, a few rows, are joined to every task; sums are formed before anything is shuffled."""
    points = times(frame, asked, gold).crossJoin(F.broadcast(share_caps(frame, shares)))
    return at_caps(points, keys=("share",))


def random_curve(frame: DataFrame, shares=SHARES, seed: int = 1, gold: str = "gold") -> DataFrame:
    """curve() of the random_criterion transcript, for which no criterion is ranked: the keys at which budgets end tell the first that holds it."""
    from tesserae.operators import ranking

    rows = frame.withColumn("item_key", ranking.priority("criterion", seed, "task_id", "slot"))
    caps = sorted((r["cap"], r["share"]) for r in share_caps(frame, shares).collect())  # a row for each share
    found = ranking.cuts(rows, "item_key", [(0, i, cap) for i, (cap, _) in enumerate(caps)])
    # budgets count from 1 in their order; past is what none of them holds
    qnum = sum((F.when(F.col("item_key") > found[i][0], 1).otherwise(0) for i in range(len(caps))), F.lit(1))
    points = _times(rows.withColumns({"qnum": qnum.cast("long"), "L": F.lit(len(caps) + 1).cast("long")}), gold)
    at = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("cap"), F.lit(share).alias("share")) for i, (_, share) in enumerate(caps)])
    return at_caps(points.withColumn("x", F.explode(at)).select("*", "x.*").drop("x"), keys=("share",))


def curve_sql(tr: str = "tr", shares=SHARES, gold: str = "gold", name: str = "cv") -> str:
    """The same curve as SQL over crit and a transcript."""
    n = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""{name}_n AS (SELECT count(*) AS L FROM {tr}),
    {name}_r AS (SELECT c.*, coalesce(t.qnum, L + 1) AS rank, L FROM crit c CROSS JOIN {name}_n LEFT JOIN {tr} t ON c.task_id = t.task_id AND c.slot = t.slot),
    {name}_t AS (SELECT task_id, min(base_id) AS base_id, max(L) AS L, min({gold}) = 1 AS t, min(prediction) = 1 AS i, min(rank) AS first,
        CASE WHEN min({gold}) = 1 THEN max(rank) ELSE min(rank) FILTER ({gold} = 0) END AS cert,
        CASE WHEN count(*) FILTER ({gold} = 0 AND prediction = 0) > 0 THEN max(L) + 1 ELSE coalesce(max(rank) FILTER (prediction = 0 AND {gold} = 1), 0) END AS lft,
        coalesce(min(rank) FILTER (prediction = 1 AND {gold} = 0), max(L) + 1) - 1 AS rgt FROM {name}_r GROUP BY task_id),
    {name}_c AS (SELECT s AS share, CAST(round_even(s * (SELECT count(*) FROM crit) / 100.0, 0) AS BIGINT) AS cap FROM (SELECT unnest([{', '.join(map(str, shares))}]) AS s)),
    {name}_x AS (SELECT *, least(cap, L) AS u FROM {name}_t CROSS JOIN {name}_c),
    {name} AS (SELECT share, cap, C, CW, certified_pass, C - certified_pass AS certified_fail, D, A, eager_fp, eager_ff, U, tasks_touched, E0,
        eager_fp + eager_ff AS eager_errors, E0 - CW AS gate_errors, fp - fpc AS gate_fp, E0 - CW - (fp - fpc) AS gate_ff, E0 - CW - eager_fp - eager_ff AS update_delta
        FROM (SELECT share, cap, {n('cert <= u')} AS C, {n('cert <= u AND t <> i')} AS CW, {n('cert <= u AND t')} AS certified_pass,
        {n('t AND NOT i AND lft <= u AND u <= cert - 1')} AS D, {n('NOT t AND NOT i AND lft <= u AND u <= rgt')} AS A, {n('NOT t AND lft <= u AND u <= rgt')} AS eager_fp,
        {n('t AND u < lft')} AS eager_ff, {n('first <= u AND u <= cert - 1')} AS U, {n('first <= u')} AS tasks_touched, {n('t <> i')} AS E0,
        {n('NOT t AND i')} AS fp, {n('NOT t AND i AND cert <= u')} AS fpc FROM {name}_x GROUP BY share, cap))"""


def states(rows: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """Literal state of each task after each of several queried sets: certificates, verdicts, errors by initial type.

    rows are criteria, sets the conditions under which a criterion is in a set; the columns of a set are named <set>_<field>.
    """
    g, p = F.col("gold"), F.col("prediction")
    aggs = [F.min("base_id").alias("base_id"), F.count("*").alias("n_criteria"), (F.min(g) == 1).alias("t"), (F.min(p) == 1).alias("i")]
    for name, seen in sets.items():
        aggs += [
            F.sum(F.when(seen, 1).otherwise(0)).alias(f"queried_{name}"), (F.min(F.when(seen, g).otherwise(p)) == 1).alias(f"e_{name}"),
            (F.max(F.when(seen & (g == 0), 1).otherwise(0)) == 1).alias(f"failed_{name}"), F.sum(F.when(seen & (g != p), 1).otherwise(0)).alias(f"found_{name}"),
        ]
    tasks = rows.groupBy("task_id").agg(*aggs)
    t, i = F.col("t"), F.col("i")
    kind = F.when(t, F.when(i, "TP").otherwise("FF")).otherwise(F.when(i, "FP").otherwise("TN"))
    out = ["task_id", "base_id", kind.alias("kind"), "n_criteria"]
    for name in sets:
        e, queried = F.col(f"e_{name}"), F.col(f"queried_{name}")
        cert = F.col(f"failed_{name}") | (t & (queried == F.col("n_criteria")))
        values = (queried, F.col(f"found_{name}"), cert, cert & t, cert & ~t, cert & (t != i), e != t, e & ~t, ~e & t, (t != i) & ~cert, (kind == "FP") & ~e, (kind == "FF") & e, (kind == "TN") & e)
        out += [(v if n < 2 else v.cast("int")).alias(f"{name}_{f}") for n, (f, v) in enumerate(zip(UNIT_FIELDS, values, strict=True))]
    return tasks.select(*out)


def unit_states(frame: DataFrame, chosen: DataFrame) -> DataFrame:
    """states() of one queried set chosen (task_id, slot), without a name before the fields."""
    seen = frame.join(chosen.select("task_id", "slot", F.lit(1).alias("seen")), ["task_id", "slot"], "left")
    rows = states(seen, {"x": F.col("seen").isNotNull()})
    return rows.withColumnsRenamed({f"x_{f}": f for f in UNIT_FIELDS})


UNIT_FIELDS = ("queried", "criterion_errors_found", "certified_tasks", "certified_pass", "certified_fail", "certified_initial_wrong", "residual_errors", "residual_fp", "residual_ff", "gated_residual_errors", "fixed_initial_fp", "fixed_initial_ff", "introduced_fp")


def unit_states_sql(chosen: str, name: str) -> str:
    b = lambda c: f"CAST({c} AS INTEGER)"
    return f"""{name}_s AS (SELECT c.*, CASE WHEN q.slot IS NULL THEN 0 ELSE 1 END AS seen FROM crit c LEFT JOIN {chosen} q ON c.task_id = q.task_id AND c.slot = q.slot),
    {name}_a AS (SELECT task_id, min(base_id) AS base_id, count(*) AS n_criteria, sum(seen) AS queried, min(gold) = 1 AS t, min(prediction) = 1 AS i,
        min(CASE WHEN seen = 1 THEN gold ELSE prediction END) = 1 AS e, count(*) FILTER (seen = 1 AND gold = 0) > 0 AS kf, count(*) FILTER (seen = 1 AND gold <> prediction) AS criterion_errors_found
        FROM {name}_s GROUP BY task_id),
    {name}_b AS (SELECT *, kf OR (t AND queried = n_criteria) AS cert, CASE WHEN t THEN CASE WHEN i THEN 'TP' ELSE 'FF' END WHEN i THEN 'FP' ELSE 'TN' END AS kind FROM {name}_a),
    {name} AS (SELECT task_id, base_id, kind, n_criteria, queried, criterion_errors_found, {b('cert')} AS certified_tasks, {b('cert AND t')} AS certified_pass, {b('cert AND NOT t')} AS certified_fail,
        {b('cert AND t <> i')} AS certified_initial_wrong, {b('e <> t')} AS residual_errors, {b('e AND NOT t')} AS residual_fp, {b('NOT e AND t')} AS residual_ff, {b('t <> i AND NOT cert')} AS gated_residual_errors,
        {b("kind = 'FP' AND NOT e")} AS fixed_initial_fp, {b("kind = 'FF' AND e")} AS fixed_initial_ff, {b("kind = 'TN' AND e")} AS introduced_fp FROM {name}_b)"""


def half_and_random(frame: DataFrame, cap_share: int = 20, seed: int = 1) -> DataFrame:
    """A query set at one budget: the first half from the judge-first policy, the rest a simple random sample of what that left."""
    from tesserae.operators import ranking

    caps = share_caps(frame, (cap_share,))
    first = ranking.transcript(frame, "sc_judge", "random", seed).crossJoin(F.broadcast(caps)).where("qnum <= floor(cap / 2)").select("task_id", "slot")
    size = first.agg(F.count("*").alias("n_first")).crossJoin(caps)
    left = frame.join(first, ["task_id", "slot"], "left_anti").withColumn("key", ranking.priority("fresh", seed, "task_id", "slot"))
    rest = ranking.global_offset(left, ranking.by_hash(left, "key"), ["key"]).crossJoin(F.broadcast(size)).where("offset < cap - n_first").select("task_id", "slot")
    return first.withColumn("phase", F.lit("certify")).unionByName(rest.withColumn("phase", F.lit("random")))


def half_and_random_sql(cap_share: int = 20, seed: int = 1, name: str = "mix") -> str:
    return f"""{name}_cap AS (SELECT CAST(round_even({cap_share} * count(*) / 100.0, 0) AS BIGINT) AS cap FROM crit),
    {name}_a AS (SELECT task_id, slot FROM trj, {name}_cap WHERE qnum <= cap // 2),
    {name}_l AS (SELECT c.task_id, c.slot, row_number() OVER (ORDER BY sha256('fresh|{seed}|' || c.task_id || '|' || c.slot)) AS n FROM crit c ANTI JOIN {name}_a a ON c.task_id = a.task_id AND c.slot = a.slot),
    {name} AS (SELECT task_id, slot, 'certify' AS phase FROM {name}_a UNION ALL SELECT task_id, slot, 'random' FROM {name}_l, {name}_cap WHERE n <= cap - (SELECT count(*) FROM {name}_a))"""
