"""The study grid as data: policies, task orders and seeds are columns of one plan over a frame that is stored once.

Within a task a policy's order doesn't depend on the order of tasks, so positions are found once for each policy and seed; an order of
tasks only adds each task's start. An outcome of a task holds on one interval of budgets, so it adds one at the first share that
reaches the interval and takes it away after the last: shares cost two rows an outcome, not a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators import accounting, ranking, storage, sweeps
from tesserae.sources import frames
from tesserae.sources.frames import ORDERS_SQL

QUERIES: dict = {}
ORACLES: dict = {}
RUN = ("policy", "task_order", "seed")
SHARES = tuple(range(101))
SEEDS = tuple(range(1, 33))
_COUNTS = ("C", "CW", "certified_pass", "D", "A", "eager_fp", "eager_ff", "U", "tasks_touched", "E0", "fp0", "fpc")


def query(name: str, sql: str, swept: bool = False):
    """Register f(frame); swept: it takes nothing but curves of the frame."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f((packed_orders if swept else stored_frame)(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


def stored_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders frame, joined and numbered once."""
    return storage.stored(frames.orders_frame(spark, sf_dir), "frame")


def packed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders frame for curves(): a row for each task, dealt and stored once; where a task is too large for this, the frame itself."""
    rows, known = frames.orders_codes(spark, sf_dir)
    tasks = sweeps.gathered(rows, known, LARGE_TASK, lambda ids: numbered(rows, known, ids))
    return stored_frame(spark, sf_dir) if tasks is None else tasks


def numbered(rows: DataFrame, known: DataFrame, ids: DataFrame) -> DataFrame:
    """(task_id, slot, code) of some orders, by all that numbers their lines."""
    by_task = W.partitionBy("task_id").orderBy(*[F.asc_nulls_last(c) for c in frames.LINE_ORDER])
    return rows.join(ids, "task_id", "left_semi").join(known.join(ids, "task_id", "left_semi"), "task_id").select("task_id", (F.row_number().over(by_task) - 1).alias("slot"), F.col("code").cast("tinyint").alias("code"))


def _values(frame: DataFrame, names: tuple, column: str) -> DataFrame:
    """A few values as rows, to be broadcast."""
    return F.broadcast(frame.sparkSession.createDataFrame([(v,) for v in names], f"{column} {'int' if column == 'seed' else 'string'}"))


def positions(frame: DataFrame, policies: tuple, seeds: tuple) -> DataFrame:
    """A row for each policy, seed and criterion: pos, its place among the queries of its task, or place, among all; null if never asked.

    place is for queries in one random order over all tasks, which begin after `flagged` others (0 but for disagreement_then_random).
    """
    rows = frame.withColumn("flag", ranking.flagged()).crossJoin(_values(frame, seeds, "seed"))
    rows = rows.withColumn("item_key", F.sha2(F.concat_ws("|", F.lit("criterion"), "seed", "task_id", "slot"), 256)).crossJoin(_values(frame, policies, "policy"))
    p = F.col("policy")
    free = (p == "random_criterion") | ((p == "disagreement_then_random") & ~F.col("flag"))
    inside = ~free & (p.startswith("sc_") | F.col("flag"))
    tier = F.when(F.col("flag"), 0).when(F.col("prediction") == 0, 1).otherwise(2)
    first = F.when(p == "sc_judge", F.col("prediction")).when(p == "sc_disagreement", tier).otherwise(0)
    tie = F.when((p == "sc_natural") | (F.col("seed") == 0), F.lit("")).otherwise(F.col("item_key"))
    rows = rows.withColumns({"free": free, "inside": inside, "w1": first, "w2": tie})
    by_task = W.partitionBy("policy", "seed", "task_id")
    pos = F.when(F.col("inside"), F.row_number().over(by_task.orderBy(F.desc("inside"), "w1", "w2", "slot")))
    asked = rows.where("NOT free").withColumn("pos", pos)
    stop = F.min(F.when(p.startswith("sc_") & (F.col("gold") == 0), F.col("pos"))).over(by_task)
    asked = asked.withColumn("stop", stop).withColumn("pos", F.when(F.col("stop").isNull() | (F.col("pos") <= F.col("stop")), F.col("pos")))
    both = tuple(q for q in policies if q in ("random_criterion", "disagreement_then_random"))
    keep = ["policy", "seed", "task_id", "slot", "gold", "prediction"]
    none = F.lit(None).cast("long")
    asked = asked.select(*keep, F.col("pos").cast("long").alias("pos"), none.alias("place"))
    return asked.unionByName(_loose(frame, both, seeds)) if both else asked


#: Criteria from which a task is ordered by windows over its rows, not as one array.
LARGE_TASK = 10_000
_FACTS = [f"{c}_{name}" for name in ("first", "last", "fail", "fixed", "broken") for c in ("pos", "place")]


def facts(frame: DataFrame, policies: tuple, seeds: tuple) -> DataFrame:
    """What every policy and seed makes of each task: how many of its criteria are asked and left out, and where what happens first.

    A task's criteria are gathered once; policies and seeds sort that array by themselves. What is asked in one random order over all
    tasks is ranked once a policy and seed. Tasks of over LARGE_TASK criteria are ordered row by row.
    """
    if set(policies) == {"random_criterion"}:  # no task has an order of its own
        return _from_rows(_loose(frame, policies, seeds))
    sizes = frame.groupBy("task_id").agg(F.count("*").alias("k"))
    large = storage.stored(sizes.where(F.col("k") > LARGE_TASK), "large-tasks")
    if large.isEmpty():
        return _gathered(frame, policies, seeds, frame)
    small = frame.join(large, "task_id", "left_anti")
    rows = positions(frame, policies, seeds).join(large, "task_id", "left_semi")
    return _gathered(small, policies, seeds, frame).unionByName(_from_rows(rows))


def _from_rows(rows: DataFrame) -> DataFrame:
    g, p = F.col("gold"), F.col("prediction")
    both = lambda f, name, cond: [f(F.when(cond, F.col(c))).alias(f"{c}_{name}") for c in ("pos", "place")]
    never_asked = F.col("pos").isNull() & F.col("place").isNull()
    return rows.groupBy("policy", "seed", "task_id").agg(
        F.count("pos").alias("n_pos"), F.count("place").alias("n_place"), F.count_if(never_asked).alias("missed"), F.count_if(never_asked & (p == 0) & (g == 1)).alias("unrepaired"),
        F.min(g).alias("g"), F.min(p).alias("p"), F.sum(1 - p).alias("fail_count"), F.max(F.when((g == 0) & (p == 0), 1).otherwise(0)).alias("shared"),
        *both(F.min, "first", F.lit(True)), *both(F.max, "last", F.lit(True)), *both(F.min, "fail", g == 0), *both(F.max, "fixed", (p == 0) & (g == 1)), *both(F.min, "broken", (p == 1) & (g == 0)),
    )


def _gathered(frame: DataFrame, policies: tuple, seeds: tuple, whole: DataFrame) -> DataFrame:
    """facts() of tasks that fit an array; whole has the rows of all tasks, over which one random order runs."""
    tasks = frame.withColumn("flag", ranking.flagged()).groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("slot", "gold", "prediction", "flag"))).alias("slots"))
    key = lambda s: F.sha2(F.concat_ws("|", F.lit("criterion"), F.col("seed").cast("string"), F.col("task_id").cast("string"), s["slot"].cast("string")), 256)
    # a criterion's code tells both bits: 2 * prediction + gold
    keyed = F.transform("slots", lambda s: F.struct(key(s).alias("key"), s["slot"].alias("slot"), (2 * s["prediction"] + s["gold"]).alias("code"), s["flag"].alias("flag")))
    rows = tasks.crossJoin(_values(frame, seeds, "seed")).withColumn("slots", keyed)
    inside = tuple(p for p in policies if p != "random_criterion")
    rows = rows.crossJoin(_values(frame, inside, "policy")) if inside else None
    p = F.col("policy")
    out = None
    if rows is not None:
        asked = F.filter("slots", lambda s: p.startswith("sc_") | s["flag"])
        judged = lambda s: F.when(s["code"] >= 2, 1).otherwise(0)
        tier = lambda s: F.when(s["flag"], 0).otherwise(1 + judged(s))
        first = lambda s: F.when(p == "sc_judge", judged(s)).when(p == "sc_disagreement", tier(s)).otherwise(0)
        tie = lambda s: F.when((p == "sc_natural") | (F.col("seed") == 0), F.lit("")).otherwise(s["key"])
        ordered = F.transform(F.array_sort(F.transform(asked, lambda s: F.struct(first(s).alias("a"), tie(s).alias("b"), s["slot"].alias("slot"), s["code"].alias("code")))), lambda s: s["code"])
        at = lambda c, code: F.nullif(F.array_position(c, code), F.lit(0).cast("long"))
        rows = rows.select("policy", "seed", "task_id", F.transform("slots", lambda s: s["code"]).alias("all"), ordered.alias("codes"))
        fail = F.least(at("codes", 0), at("codes", 2))
        rows = rows.withColumn("codes", F.when(p.startswith("sc_"), F.slice("codes", 1, F.coalesce(fail.cast("int"), F.size("codes")))).otherwise(F.col("codes")))
        n = F.size("codes").cast("long")
        some = lambda c, code: F.size(F.filter(c, lambda x: x == code)).cast("long")
        none = F.lit(None).cast("long")
        out = rows.select(
            "policy", "seed", "task_id", n.alias("n_pos"), F.lit(0).cast("long").alias("n_place"),
            (F.size("all") - n).alias("missed"), (some("all", 1) - some("codes", 1)).alias("unrepaired"), F.array_min(F.transform("all", lambda x: x % 2)).alias("g"), F.array_min(F.transform("all", lambda x: F.floor(x / 2).cast("int"))).alias("p"),
            F.size(F.filter("all", lambda x: x < 2)).cast("long").alias("fail_count"), F.array_contains("all", 0).cast("int").alias("shared"),
            *[c.alias(f"pos_{name}") for name, c in (("first", F.when(n > 0, F.lit(1).cast("long"))), ("last", F.when(n > 0, n)), ("fail", fail), ("fixed", n + 1 - at(F.reverse("codes"), 1)), ("broken", at("codes", 2)))],
            *[none.alias(f"place_{name}") for name in ("first", "last", "fail", "fixed", "broken")],
        )
    loose = tuple(q for q in policies if q in ("random_criterion", "disagreement_then_random"))
    if not loose:
        return out
    placed = _from_rows(_loose(whole, loose, seeds).join(tasks.select("task_id"), "task_id", "left_semi") if whole is not frame else _loose(frame, loose, seeds))
    if out is None:
        return placed
    # of disagreement_then_random the flagged criteria of a task come from its array, the others from the random order
    half = out.where("policy = 'disagreement_then_random'").unionByName(placed.where("policy = 'disagreement_then_random'"))
    merged = half.groupBy("policy", "seed", "task_id").agg(
        F.sum("n_pos").alias("n_pos"), F.sum("n_place").alias("n_place"), F.min("g").alias("g"), F.min("p").alias("p"), F.max("fail_count").alias("fail_count"), F.max("shared").alias("shared"),
        *[(F.max if c.endswith(("last", "fixed")) else F.min)(c).alias(c) for c in _FACTS],
    )
    merged = merged.withColumns({"missed": F.lit(0).cast("long"), "unrepaired": F.lit(0).cast("long")})
    return out.where("policy <> 'disagreement_then_random'").unionByName(merged).unionByName(placed.where("policy = 'random_criterion'"))


def _loose(frame: DataFrame, policies: tuple, seeds: tuple) -> DataFrame:
    """The criteria that policies ask in one random order over all tasks, with place; those of the others are left out."""
    rows = frame.withColumn("flag", ranking.flagged()).crossJoin(_values(frame, seeds, "seed"))
    rows = rows.withColumn("item_key", F.sha2(F.concat_ws("|", F.lit("criterion"), "seed", "task_id", "slot"), 256)).crossJoin(_values(frame, policies, "policy"))
    p = F.col("policy")
    flagged = frame.agg(F.count_if(ranking.flagged()).alias("n_flagged"))
    rows = rows.where((p == "random_criterion") | ~F.col("flag"))
    ranked = ranking.global_offset(rows, ranking.by_hash(frame, "item_key"), ["item_key"], within=("policy", "seed")).crossJoin(F.broadcast(flagged))  # one row
    place = F.col("offset") + 1 + F.when(p == "disagreement_then_random", F.col("n_flagged")).otherwise(0)
    return ranked.select("policy", "seed", "task_id", "slot", "gold", "prediction", F.lit(None).cast("long").alias("pos"), place.alias("place"))


def times(frame: DataFrame, policies: tuple = ranking.POLICIES, orders: tuple = ranking.TASK_ORDERS, seeds: tuple = (1,)) -> tuple[DataFrame, DataFrame]:
    """For each run and task the budgets at which things happen, as accounting.times() has them for one run; and a row (RUN, L) for each run."""
    made = storage.stored(facts(frame, policies, seeds).withColumn("task_key", F.sha2(F.concat_ws("|", F.lit("task"), "seed", "task_id"), 256)), "facts")
    length = storage.stored(made.groupBy("policy", "seed").agg(F.sum(F.col("n_pos") + F.col("n_place")).alias("L")), "lengths")
    rows = made.crossJoin(_values(frame, orders, "task_order"))
    o = F.col("task_order")
    hashed = (o == "random") | ((o == "predicted_fail_count") & (F.col("seed") != 0))
    rows = rows.withColumns({"o1": F.when(o == "predicted_fail_count", F.col("fail_count")).otherwise(0), "o2": F.when(hashed, F.col("task_key")).otherwise("")})
    d = ranking.digits(frame.sparkSession)
    number = lambda bits: F.when(F.col("o2") == "", F.floor(F.col("task_id") / (1 << bits))).otherwise(0)
    levels = [[F.col("o1"), F.substring("o2", 1, d // 2), number(24)], [F.substring("o2", d // 2 + 1, d - d // 2), number(12)]]
    if set(policies) == {"random_criterion"}:
        rows = rows.withColumn("start", F.lit(0).cast("long"))
    else:
        rows = ranking.global_offset(rows, levels, ["o1", "o2", "task_id"], F.col("n_pos"), "start", within=RUN)
    rows = rows.join(F.broadcast(length), ["policy", "seed"])  # a row for each policy and seed
    never = F.col("L") + 1
    least = lambda name: F.least(F.col("start") + F.col(f"pos_{name}"), F.col(f"place_{name}"))
    most = lambda name: F.greatest(F.col("start") + F.col(f"pos_{name}"), F.col(f"place_{name}"))
    last = F.when(F.col("missed") > 0, never).otherwise(most("last"))
    left = F.when(F.col("shared") == 1, never).when(F.col("unrepaired") > 0, never).otherwise(F.coalesce(most("fixed"), F.lit(0)))
    rows = rows.select(
        *RUN, "L", (F.col("g") == 1).alias("truth"), (F.col("p") == 1).alias("initial"), F.coalesce(least("first"), never).alias("first"),
        F.when(F.col("g") == 1, last).otherwise(F.coalesce(least("fail"), never)).alias("cert"), left.alias("left"), (F.coalesce(least("broken"), never) - 1).alias("right"),
    )
    return rows, length.crossJoin(_values(frame, orders, "task_order"))


def _ranked_counts(frame: DataFrame, policies: tuple, orders: tuple, seeds: tuple, shares: tuple) -> DataFrame:
    """RUN, share, cap, L and the counts of a curve from exact ranks of all queries."""
    m = frame.agg(F.count("*").alias("m"))
    rows, runs = times(frame, policies, orders, seeds)
    rows, runs = rows.crossJoin(F.broadcast(m)), runs.crossJoin(F.broadcast(m))  # one row

    def reached(at):
        """The first share whose budget, share * m / 100 with halves to even, is `at` or more; 101 past the transcript's end."""
        twice = (2 * at - 1) * 100
        whole = F.floor(twice / (2 * F.col("m")))
        exact = (F.pmod(twice, 2 * F.col("m")) == 0) & (at % 2 == 0)
        return F.when(at > F.col("L"), 101).when(at <= 0, 0).otherwise(F.when(exact, whole).otherwise(whole + 1)).cast("int")

    t, i, cert, end = F.col("truth"), F.col("initial"), F.col("cert"), F.col("L") + 1
    spans = {
        "C": (F.lit(True), cert, end), "CW": (t != i, cert, end), "certified_pass": (t, cert, end), "D": (t & ~i, F.col("left"), cert), "A": (~t & ~i, F.col("left"), F.col("right") + 1),
        "eager_fp": (~t, F.col("left"), F.col("right") + 1), "eager_ff": (t, F.lit(0).cast("long"), F.col("left")), "U": (F.lit(True), F.col("first"), cert), "tasks_touched": (F.lit(True), F.col("first"), end),
        "E0": (t != i, F.lit(0).cast("long"), end), "fp0": (~t & i, F.lit(0).cast("long"), end), "fpc": (~t & i, cert, end),
    }
    spots = {"first": F.col("first"), "cert": cert, "left": F.col("left"), "right": F.col("right") + 1}
    bits = F.lit(0).cast("long")
    for n, (cond, start, after) in enumerate(spans.values()):
        bits = bits.bitwiseOR(F.when(cond & (start < after), 1 << n).otherwise(0))
    # tasks that change alike at the same shares are counted together
    alike = rows.select(*RUN, bits.alias("bits"), *[reached(c).alias(name) for name, c in spots.items()]).groupBy(*RUN, "bits", *spots).agg(F.count("*").alias("n"))
    place = {str(c): F.col(name) for name, c in spots.items()} | {str(end): F.lit(101), str(F.lit(0).cast("long")): F.lit(0)}
    parts = []
    for n, (_, start, after) in enumerate(spans.values()):
        for sign, at in ((1, start), (-1, after)):
            parts.append(F.struct(F.lit(n).alias("field"), place[str(at)].alias("share"), F.when(F.col("bits").bitwiseAND(1 << n) > 0, sign * F.col("n")).otherwise(0).alias("n")))
    steps = alike.select(*RUN, F.explode(F.array(*parts)).alias("x")).select(*RUN, "x.*").where("share <= 100 AND n <> 0").groupBy(*RUN, "field", "share").agg(F.sum("n").alias("n"))
    # every share of every run, whether anything happens at it or not
    field = F.explode(F.sequence(F.lit(0), F.lit(len(spans) - 1))).alias("field")
    blank = runs.select(*RUN, field).select(*RUN, "field", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("share"), F.lit(0).cast("long").alias("n"))
    dense = steps.unionByName(blank).groupBy(*RUN, "field", "share").agg(F.sum("n").alias("n"))
    summed = dense.withColumn("v", F.sum("n").over(W.partitionBy(*RUN, "field").orderBy("share"))).where(F.col("share").isin(*shares))
    wide = summed.groupBy(*RUN, "share").agg(*[F.sum(F.when(F.col("field") == n, F.col("v"))).cast("long").alias(name) for n, name in enumerate(_COUNTS)])
    return wide.join(F.broadcast(runs), list(RUN)).withColumn("cap", F.bround(F.col("share") * F.col("m") / 100).cast("long"))  # a row for each run


def curves(frame: DataFrame, policies: tuple = ranking.POLICIES, orders: tuple = ranking.TASK_ORDERS, seeds: tuple = (1,), shares: tuple = SHARES) -> DataFrame:
    """policy, task_order, seed, share (of 0 to 100), cap, actual_queries and accounting.FIELDS. Shares are whole numbers.

    Tasks that fit into arrays are swept; where one has over LARGE_TASK criteria, all are ranked row by row. frame may be packed_orders().
    """
    shares = tuple(sorted(shares))
    fits = "codes" in frame.columns or frame.groupBy("task_id").agg(F.count("*").alias("k")).where(F.col("k") > LARGE_TASK).isEmpty()
    wide = (sweeps.curves if fits else _ranked_counts)(frame, policies, orders, seeds, shares)
    gate, eager = F.col("E0") - F.col("CW"), F.col("eager_fp") + F.col("eager_ff")
    gate_fp = F.col("fp0") - F.col("fpc")
    out = wide.withColumns({"actual_queries": F.least("cap", "L"), "certified_fail": F.col("C") - F.col("certified_pass"), "eager_errors": eager, "gate_errors": gate, "gate_fp": gate_fp, "gate_ff": gate - gate_fp, "update_delta": gate - eager})
    return out.select(*RUN, "share", "cap", "actual_queries", *accounting.FIELDS)


def _strings(values: tuple) -> str:
    return ", ".join(f"'{v}'" for v in values)


def curves_sql(policies: tuple = ranking.POLICIES, orders: tuple = ranking.TASK_ORDERS, seeds: tuple = (1,), shares: tuple = SHARES, name: str = "gr") -> str:
    """The same rows as SQL, row by row over all runs: CTEs up to `name`."""
    n = lambda c: f"CAST(count(*) FILTER ({c}) AS BIGINT)"
    return f"""runs AS (SELECT policy, task_order, seed FROM (SELECT unnest([{_strings(policies)}]) AS policy), (SELECT unnest([{_strings(orders)}]) AS task_order), (SELECT unnest([{', '.join(map(str, seeds))}]) AS seed)),
    ky AS (SELECT c.*, seed, sha256('criterion|' || seed || '|' || task_id || '|' || slot) AS item_key, sha256('task|' || seed || '|' || task_id) AS task_key, second <> prediction AS flag,
        sum(1 - prediction) OVER (PARTITION BY seed, task_id) AS fail_count FROM crit c, (SELECT DISTINCT seed FROM runs)),
    rw AS (SELECT k.*, policy, task_order, policy = 'random_criterion' OR (policy = 'disagreement_then_random' AND NOT flag) AS free, policy LIKE 'sc_%' AS serial,
        CASE WHEN task_order = 'predicted_fail_count' THEN fail_count ELSE 0 END AS o1, CASE WHEN task_order = 'random' OR (task_order = 'predicted_fail_count' AND k.seed <> 0) THEN task_key ELSE '' END AS o2,
        CASE policy WHEN 'sc_judge' THEN prediction WHEN 'sc_disagreement' THEN CASE WHEN flag THEN 0 WHEN prediction = 0 THEN 1 ELSE 2 END ELSE 0 END AS w1, CASE WHEN policy = 'sc_natural' OR k.seed = 0 THEN '' ELSE item_key END AS w2
        FROM ky k JOIN runs r ON k.seed = r.seed WHERE policy <> 'disagreement_only' OR flag),
    fb AS (SELECT *, coalesce(sum(1 - gold) OVER (PARTITION BY policy, task_order, seed, task_id ORDER BY w1, w2, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fails FROM rw),
    tq AS (SELECT policy, task_order, seed, task_id, slot, row_number() OVER (PARTITION BY policy, task_order, seed ORDER BY CASE WHEN free THEN 1 ELSE 0 END, CASE WHEN free THEN item_key ELSE '' END, o1, o2, task_id, w1, w2, slot) AS qnum FROM fb WHERE NOT serial OR fails = 0),
    ln AS (SELECT policy, task_order, seed, count(*) AS L FROM tq GROUP BY ALL),
    rk AS (SELECT c.*, l.policy, l.task_order, l.seed, L, coalesce(qnum, L + 1) AS rank FROM crit c CROSS JOIN ln l LEFT JOIN tq q ON q.policy = l.policy AND q.task_order = l.task_order AND q.seed = l.seed AND q.task_id = c.task_id AND q.slot = c.slot),
    tm AS (SELECT policy, task_order, seed, task_id, max(L) AS L, min(gold) = 1 AS t, min(prediction) = 1 AS i, min(rank) AS first, CASE WHEN min(gold) = 1 THEN max(rank) ELSE min(rank) FILTER (gold = 0) END AS cert,
        CASE WHEN count(*) FILTER (gold = 0 AND prediction = 0) > 0 THEN max(L) + 1 ELSE coalesce(max(rank) FILTER (prediction = 0 AND gold = 1), 0) END AS lft, coalesce(min(rank) FILTER (prediction = 1 AND gold = 0), max(L) + 1) - 1 AS rgt FROM rk GROUP BY ALL),
    cp AS (SELECT s AS share, CAST(round_even(s * (SELECT count(*) FROM crit) / 100.0, 0) AS BIGINT) AS cap FROM (SELECT unnest([{', '.join(map(str, shares))}]) AS s)),
    xx AS (SELECT *, least(cap, L) AS u FROM tm CROSS JOIN cp),
    {name} AS (SELECT policy, task_order, seed, share, cap, actual_queries, C, CW, certified_pass, C - certified_pass AS certified_fail, D, A, eager_fp, eager_ff, U, tasks_touched, E0, eager_fp + eager_ff AS eager_errors,
        E0 - CW AS gate_errors, fp - fpc AS gate_fp, E0 - CW - (fp - fpc) AS gate_ff, E0 - CW - eager_fp - eager_ff AS update_delta FROM (SELECT policy, task_order, seed, share, cap, max(u) AS actual_queries, {n('cert <= u')} AS C,
        {n('cert <= u AND t <> i')} AS CW, {n('cert <= u AND t')} AS certified_pass, {n('t AND NOT i AND lft <= u AND u <= cert - 1')} AS D, {n('NOT t AND NOT i AND lft <= u AND u <= rgt')} AS A, {n('NOT t AND lft <= u AND u <= rgt')} AS eager_fp,
        {n('t AND u < lft')} AS eager_ff, {n('first <= u AND u <= cert - 1')} AS U, {n('first <= u')} AS tasks_touched, {n('t <> i')} AS E0, {n('NOT t AND i')} AS fp, {n('NOT t AND i AND cert <= u')} AS fpc FROM xx GROUP BY policy, task_order, seed, share, cap))"""


GRID_SEEDS = (0, 1)


@query("policy_grid", f"WITH {ORDERS_SQL}, {curves_sql(seeds=GRID_SEEDS)} SELECT * FROM gr", swept=True)
def policy_grid(frame: DataFrame) -> DataFrame:
    """Every policy in every task order at every share from 0 to 100, with canonical ties (seed 0) and hashed ones."""
    return curves(frame, seeds=GRID_SEEDS)


def policy_grid_seeds(frame: DataFrame) -> DataFrame:
    """The whole study: every policy, task order and share over seed 0 and 32 more, summed up over the seeds."""
    rows = curves(frame, seeds=(0, *SEEDS))
    mean = lambda c: F.round(F.avg(c), 9).alias(f"{c}_mean")
    ends = [f(c).alias(f"{c}_{name}") for c in ("eager_errors", "update_delta") for f, name in ((F.min, "least"), (F.max, "most"))]
    canonical = F.max(F.when(F.col("seed") == 0, F.col("eager_errors"))).alias("canonical_eager_errors")
    return rows.groupBy("policy", "task_order", "share").agg(F.count("*").alias("seeds"), *[mean(c) for c in accounting.FIELDS], *ends, canonical)


# a row for each run, share and task is too much for the SQL beside it; runs of two seeds are held against it in policy_grid
QUERIES["policy_grid_seeds"] = lambda spark, sf_dir: policy_grid_seeds(packed_orders(spark, sf_dir))


@query("seed_summary_percentiles", f"""WITH {ORDERS_SQL}, {curves_sql(('random_criterion',), ('random',), SEEDS, (10, 20, 50, 80))} SELECT share, count(*) AS seeds, round(quantile_cont(eager_errors, 0.05), 9) AS p05, round(quantile_cont(eager_errors, 0.5), 9) AS median,
    round(quantile_cont(eager_errors, 0.95), 9) AS p95, round(avg(gate_errors), 9) AS mean_gated, min(update_delta) AS least_delta, max(update_delta) AS most_delta FROM gr GROUP BY 1""", swept=True)
def seed_summary_percentiles(frame: DataFrame) -> DataFrame:
    """Exact percentiles over 32 seeds; seed 0, the canonical one, is never among them."""
    q = lambda p: F.round(F.percentile("eager_errors", p), 9)
    rows = curves(frame, ("random_criterion",), ("random",), SEEDS, (10, 20, 50, 80))
    return rows.groupBy("share").agg(F.count("*").alias("seeds"), q(0.05).alias("p05"), q(0.5).alias("median"), q(0.95).alias("p95"), F.round(F.avg("gate_errors"), 9).alias("mean_gated"), F.min("update_delta").alias("least_delta"), F.max("update_delta").alias("most_delta"))


_DELTAS = "curve AS (SELECT policy, task_order, share, avg(update_delta) AS mean, min(update_delta) AS least, max(update_delta) AS most, quantile_cont(update_delta, 0.05) AS p05, quantile_cont(update_delta, 0.95) AS p95, count(*) FILTER (update_delta < 0) AS below, count(*) FILTER (update_delta = 0) AS equal, count(*) FILTER (update_delta > 0) AS above FROM gr GROUP BY 1, 2, 3)"


@query("update_delta_summary", f"""WITH {ORDERS_SQL}, {curves_sql(('sc_random', 'sc_judge', 'disagreement_then_random'), ('random', 'release'), SEEDS, tuple(range(0, 101, 5)))}, {_DELTAS}
    SELECT policy, task_order, share, round(mean, 9) AS mean, least, most, round(p05, 9) AS p05, round(p95, 9) AS p95, below, equal, above FROM curve""", swept=True)
def update_delta_summary(frame: DataFrame) -> DataFrame:
    """Gated less eager errors over seeds at each share: mean, extremes, percentiles and how often each side is better."""
    rows = curves(frame, ("sc_random", "sc_judge", "disagreement_then_random"), ("random", "release"), SEEDS, tuple(range(0, 101, 5)))
    d, n = F.col("update_delta"), lambda c: F.count_if(c)
    return rows.groupBy("policy", "task_order", "share").agg(F.round(F.avg(d), 9).alias("mean"), F.min(d).alias("least"), F.max(d).alias("most"), F.round(F.percentile(d, 0.05), 9).alias("p05"), F.round(F.percentile(d, 0.95), 9).alias("p95"), n(d < 0).alias("below"), n(d == 0).alias("equal"), n(d > 0).alias("above"))


@query("peak_plateaus", f"""WITH {ORDERS_SQL}, {curves_sql(('sc_random', 'sc_judge'), ('random',), (1,))}, pk AS (SELECT *, max(eager_errors) OVER (PARTITION BY policy) AS peak FROM gr)
    SELECT policy, peak, min(share) FILTER (abs(eager_errors - peak) <= 1e-12) AS first_share, max(share) FILTER (abs(eager_errors - peak) <= 1e-12) AS last_share FROM pk GROUP BY 1, 2""", swept=True)
def peak_plateaus(frame: DataFrame) -> DataFrame:
    """The largest eager error count along each curve, and the first and last share that have it."""
    rows = curves(frame, ("sc_random", "sc_judge"), ("random",), (1,)).withColumn("peak", F.max("eager_errors").over(W.partitionBy("policy")))
    on = F.when(F.abs(F.col("eager_errors") - F.col("peak")) <= 1e-12, F.col("share"))
    return rows.groupBy("policy", "peak").agg(F.min(on).alias("first_share"), F.max(on).alias("last_share"))


@query("order_sensitivity", f"""WITH {ORDERS_SQL}, {curves_sql(('sc_judge',), ranking.TASK_ORDERS, SEEDS, (20,))} SELECT task_order, count(*) AS seeds, round(avg(C), 9) AS certified, round(quantile_cont(eager_errors, 0.05), 9) AS p05,
    round(quantile_cont(eager_errors, 0.95), 9) AS p95, round(avg(gate_errors), 9) AS gate_errors FROM gr GROUP BY 1""", swept=True)
def order_sensitivity(frame: DataFrame) -> DataFrame:
    """One policy at a fifth of the budget under each order of tasks, over 32 seeds."""
    rows = curves(frame, ("sc_judge",), ranking.TASK_ORDERS, SEEDS, (20,))
    r = lambda c: F.round(c, 9)
    return rows.groupBy("task_order").agg(F.count("*").alias("seeds"), r(F.avg("C")).alias("certified"), r(F.percentile("eager_errors", 0.05)).alias("p05"), r(F.percentile("eager_errors", 0.95)).alias("p95"), r(F.avg("gate_errors")).alias("gate_errors"))


@query("curve_bands", f"""WITH {ORDERS_SQL}, {curves_sql(('random_criterion',), ('random',), SEEDS, (10, 20, 50, 80))}, dv AS (SELECT *, avg(C) OVER (PARTITION BY share) AS mean FROM gr), fr AS (SELECT *, max(abs(C - mean)) OVER (PARTITION BY seed) AS far FROM dv)
    SELECT share, round(avg(C), 9) AS mean, round(quantile_cont(C, 0.05), 9) AS p05, round(quantile_cont(C, 0.95), 9) AS p95, round(quantile_cont(far, 0.95), 9) AS band FROM fr GROUP BY 1""", swept=True)
def curve_bands(frame: DataFrame) -> DataFrame:
    """Quantiles over 32 seeds at each share, and a band for all shares at once from each seed's largest deviation."""
    rows = curves(frame, ("random_criterion",), ("random",), SEEDS, (10, 20, 50, 80)).withColumn("v", F.col("C").cast("double"))
    rows = rows.withColumn("mean", F.avg("v").over(W.partitionBy("share")))  # a row for each seed and share from here on
    rows = rows.withColumn("far", F.max(F.abs(F.col("v") - F.col("mean"))).over(W.partitionBy("seed")))
    r = lambda c: F.round(c, 9)
    return rows.groupBy("share").agg(r(F.avg("v")).alias("mean"), r(F.percentile("v", 0.05)).alias("p05"), r(F.percentile("v", 0.95)).alias("p95"), r(F.percentile("far", 0.95)).alias("band"))


_REPLAY = f"""WITH {ORDERS_SQL}, {ranking.transcript_sql('sc_judge')},
    rp AS (SELECT tr.*, k, gf, pf, CASE WHEN gold <> prediction THEN 1 ELSE 0 END AS error, sum(gold - prediction) OVER w AS moved, sum(1 - gold) OVER w AS failed, count(*) OVER w AS seen FROM tr
        JOIN (SELECT task_id, count(*) AS k, sum(1 - gold) AS gf, sum(1 - prediction) AS pf FROM crit GROUP BY 1) t ON tr.task_id = t.task_id WINDOW w AS (PARTITION BY tr.task_id ORDER BY qnum)),
    st AS (SELECT *, gf = 0 AS truth, pf = 0 AS initial, pf - moved = 0 AS eager, failed > 0 OR seen = k AS cert FROM rp),
    pv AS (SELECT *, lag(eager, 1, initial) OVER (PARTITION BY task_id ORDER BY qnum) AS eager0, lag(cert, 1, false) OVER (PARTITION BY task_id ORDER BY qnum) AS cert0 FROM st)"""
_B = "CAST({} AS INTEGER)"
_REPLAY_FIELDS = {
    "d_certified": "CAST(cert AS INTEGER) - CAST(cert0 AS INTEGER)", "d_certified_pass": "CAST(cert AND truth AS INTEGER) - CAST(cert0 AND truth AS INTEGER)", "d_certified_fail": "CAST(cert AND NOT truth AS INTEGER) - CAST(cert0 AND NOT truth AS INTEGER)",
    "d_corrected": "CAST(cert AND truth <> initial AS INTEGER) - CAST(cert0 AND truth <> initial AS INTEGER)", "d_eager_errors": "CAST(eager <> truth AS INTEGER) - CAST(eager0 <> truth AS INTEGER)", "d_eager_fp": "CAST(eager AND NOT truth AS INTEGER) - CAST(eager0 AND NOT truth AS INTEGER)",
    "d_eager_ff": "CAST(NOT eager AND truth AS INTEGER) - CAST(NOT eager0 AND truth AS INTEGER)", "d_gate_errors": "CAST(NOT cert AND truth <> initial AS INTEGER) - CAST(NOT cert0 AND truth <> initial AS INTEGER)", "d_touched": "CAST(seen = 1 AS INTEGER)", "error_found": "error",
}


def replay(frame: DataFrame, policy: str = "sc_judge") -> DataFrame:
    """What each query of a transcript changes: ten differences of certificates, eager and gated verdicts and their errors."""
    tasks = accounting.tasks(frame).select("task_id", "k", "gf", "pf")
    by_task = W.partitionBy("task_id").orderBy("qnum")
    rows = ranking.transcript(frame, policy).join(tasks, "task_id")
    run = lambda c: F.sum(c).over(by_task)
    rows = rows.withColumns({"error": (F.col("gold") != F.col("prediction")).cast("int"), "moved": run(F.col("gold") - F.col("prediction")), "failed": run(1 - F.col("gold")), "seen": F.count("*").over(by_task)})
    rows = rows.withColumns({"truth": F.col("gf") == 0, "initial": F.col("pf") == 0, "eager": F.col("pf") - F.col("moved") == 0, "cert": (F.col("failed") > 0) | (F.col("seen") == F.col("k"))})
    rows = rows.withColumns({"eager0": F.coalesce(F.lag("eager").over(by_task), "initial"), "cert0": F.coalesce(F.lag("cert").over(by_task), F.lit(False))})
    return rows.select("qnum", "task_id", "base_id", "slot", *[F.expr(e.replace("INTEGER", "INT")).alias(n) for n, e in _REPLAY_FIELDS.items()])


query("replay_deltas", f"{_REPLAY} SELECT qnum, task_id, slot, {', '.join(f'CAST({e} AS INTEGER) AS {n}' for n, e in _REPLAY_FIELDS.items())} FROM pv")(lambda frame: replay(frame).drop("base_id"))


@query("trace_summary", f"""{_REPLAY}, dl AS (SELECT qnum, {_REPLAY_FIELDS['d_eager_errors']} AS de, {_REPLAY_FIELDS['d_gate_errors']} AS dg, {_REPLAY_FIELDS['d_certified']} AS dc, {_REPLAY_FIELDS['d_eager_fp']} AS df, error FROM pv),
    ac AS (SELECT *, sum(dc) OVER (ORDER BY qnum) AS c, sum(de) OVER (ORDER BY qnum) AS e FROM dl)
    SELECT count(*) AS total_queries, CAST(sum(error) AS BIGINT) AS errors_found, CAST(sum(CASE WHEN df > 0 THEN 1 ELSE 0 END) AS BIGINT) AS new_fp, min(qnum) FILTER (c = (SELECT count(DISTINCT task_id) FROM crit)) AS first_all_certified,
    CAST(max(greatest(e, 0)) AS BIGINT) AS most_added, CAST(sum(de) AS BIGINT) AS eager_change, CAST(sum(dg) AS BIGINT) AS gate_change FROM ac""")
def trace_summary(frame: DataFrame) -> DataFrame:
    """Totals of a replay, where every task is certified first, and the most eager errors above the initial ones at any query.

    Running totals over the transcript are taken by levels of query numbers.
    """
    rows = replay(frame)
    tasks = frame.agg(F.count_distinct("task_id").alias("n_tasks"))
    for c in ("d_certified", "d_eager_errors"):
        rows = ranking.global_offset(rows, ranking.by_number("qnum"), ["qnum"], F.col(c), f"before_{c}")
    rows = rows.crossJoin(F.broadcast(tasks)).withColumns({"c": F.col("before_d_certified") + F.col("d_certified"), "e": F.col("before_d_eager_errors") + F.col("d_eager_errors")})  # one row
    big = lambda c: F.sum(c).cast("long")
    return rows.agg(
        F.count("*").alias("total_queries"), big("error_found").alias("errors_found"), F.count_if(F.col("d_eager_fp") > 0).alias("new_fp"), F.min(F.when(F.col("c") == F.col("n_tasks"), F.col("qnum"))).alias("first_all_certified"),
        F.max(F.greatest("e", F.lit(0))).cast("long").alias("most_added"), big("d_eager_errors").alias("eager_change"), big("d_gate_errors").alias("gate_change"),
    )


# ---------------------------------------------------------------- the nested half-and-random policy

_NESTED = f"""{ranking.transcript_sql('sc_judge', name='trj')}, uo AS (SELECT task_id, slot, row_number() OVER (ORDER BY sha256('fresh|1|' || task_id || '|' || slot)) AS u FROM crit),
    nl AS (SELECT count(*) AS S FROM trj), nc AS (SELECT s AS share, CAST(round_even(s * (SELECT count(*) FROM crit) / 100.0, 0) AS BIGINT) AS cap FROM (SELECT unnest([10, 20, 50, 80, 100]) AS s)),
    nr AS (SELECT uo.*, q.qnum, share, cap, least(cap // 2, S) AS a FROM uo LEFT JOIN trj q ON uo.task_id = q.task_id AND uo.slot = q.slot CROSS JOIN nl CROSS JOIN nc),
    nd AS (SELECT *, qnum IS NOT NULL AND qnum <= a AS certify, CASE WHEN qnum IS NULL OR qnum > a THEN row_number() OVER (PARTITION BY share, qnum IS NULL OR qnum > a ORDER BY u) END AS r FROM nr)"""


@query("nested_half_random", f"WITH {ORDERS_SQL}, {_NESTED} SELECT share, cap, count(*) FILTER (certify) AS certify, count(*) FILTER (NOT certify) AS random, CAST(sum(slot) AS BIGINT) AS slots, CAST(sum(task_id) AS BIGINT) AS tasks FROM nd WHERE certify OR r <= cap - a GROUP BY 1, 2")
def nested_half_random(frame: DataFrame) -> DataFrame:
    """A policy that grows by one query a step: half of a budget certifies, the rest is the shortest beginning of one random order that
    fills it with what isn't queried yet. Sets of smaller budgets lie within those of larger ones.

    At each budget the queries taken from the random order are those below a place of it that is found by counting, not by replay.
    """
    return nested(frame).groupBy("share", "cap").agg(F.count_if("certify").alias("certify"), F.count_if(~F.col("certify")).alias("random"), F.sum("slot").cast("long").alias("slots"), F.sum("task_id").alias("tasks"))


def judged(frame: DataFrame, seed: int) -> DataFrame:
    """Criteria with pos, their place in the judge-first order of their task, and asked, how many of the task it asks; stored."""
    by_task = W.partitionBy("task_id")
    rows = frame.select("task_id", "slot", "base_id", "gold", "prediction")
    rows = rows.withColumn("pos", F.row_number().over(by_task.orderBy("prediction", F.lit("") if seed == 0 else ranking.priority("criterion", seed, "task_id", "slot"), "slot")))
    stop = F.min(F.when(F.col("gold") == 0, F.col("pos"))).over(by_task)
    return storage.stored(rows.withColumn("asked", F.coalesce(stop, F.count("*").over(by_task))), "judged")


def before_cut(seed: int, key: Column, part: Column) -> Column:
    """Whether a criterion of judged() is asked in tasks of lower keys, or among the first `part` of the task of this key."""
    task = ranking.priority("task", seed, "task_id")
    return (F.col("pos") <= F.col("asked")) & ((task < key) | ((task == key) & (F.col("pos") <= part)))


def nested(frame: DataFrame, shares: tuple = (10, 20, 50, 80, 100), seed: int = 1) -> DataFrame:
    """(share, cap, task_id, slot, gold, prediction, certify) of the nested policy's queries at each share's budget.

    The two keys at which a share's queries end are found first; then each criterion is judged by itself.
    """
    spark, rows = frame.sparkSession, judged(frame, seed)
    m = rows.count()
    starts = rows.groupBy("task_id").agg(F.max("asked").alias("asked")).withColumn("task_key", ranking.priority("task", seed, "task_id"))
    serial = starts.agg(F.sum("asked")).first()[0] or 0
    caps = {s: round(s * m / 100) for s in shares}
    a = {s: min(cap // 2, serial) for s, cap in caps.items()}
    ends = ranking.cuts(starts, "task_key", [(0, s, n) for s, n in a.items()], F.col("asked"))
    table = spark.createDataFrame([(s, caps[s], *ends[s]) for s in shares], "share int, cap long, half string, part long")
    each = rows.withColumn("key", ranking.priority("fresh", seed, "task_id", "slot")).crossJoin(F.broadcast(table))  # a row for each share
    each = each.withColumn("certify", before_cut(seed, F.col("half"), F.col("part")))
    last = ranking.cuts(each.where("NOT certify"), "key", [(s, s, caps[s] - a[s]) for s in shares], within="share")
    lasts = spark.createDataFrame([(s, last[s][0]) for s in shares], "share int, last string")
    return each.join(F.broadcast(lasts), "share").where(F.col("certify") | (F.col("key") <= F.col("last"))).select("share", "cap", "task_id", "slot", "gold", "prediction", "certify")


@query("serial_unit_order", f"""WITH {ORDERS_SQL}, so AS (SELECT *, coalesce(sum(1 - gold) OVER (PARTITION BY task_id ORDER BY sha256('unit|1|' || task_id || '|' || slot), slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fails FROM crit)
    SELECT row_number() OVER (ORDER BY sha256('serial|1|' || task_id), task_id, sha256('unit|1|' || task_id || '|' || slot), slot) AS qnum, task_id, slot FROM so WHERE fails = 0""")
def serial_unit_order(frame: DataFrame) -> DataFrame:
    """Units in an order of their own hashes, criteria in one of theirs within the unit, each unit left at its first revealed failure."""
    rows = frame.withColumns({"item_key": ranking.priority("unit", 1, "task_id", "slot"), "unit_key": ranking.priority("serial", 1, "task_id")})
    by_task = W.partitionBy("task_id").orderBy("item_key", "slot")
    rows = rows.withColumn("fails", F.coalesce(F.sum(1 - F.col("gold")).over(by_task.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where("fails = 0")
    return ranking.global_offset(rows, ranking.by_hash(frame, "unit_key"), ["unit_key", "task_id", "item_key", "slot"]).select((F.col("offset") + 1).alias("qnum"), "task_id", "slot")


_ALLOC = f"WITH {ORDERS_SQL}, {_NESTED}, sl AS (SELECT share, cap, task_id, slot, certify FROM nd WHERE certify OR r <= cap - a)"


@query("accuracy_estimates", f"""{_ALLOC}, h AS (SELECT s.share, count(*) FILTER (certify) AS known, CAST(sum(CASE WHEN certify AND gold = prediction THEN 1 ELSE 0 END) AS BIGINT) AS known_agree, count(*) FILTER (NOT certify) AS drawn,
    CAST(sum(CASE WHEN NOT certify AND gold = prediction THEN 1 ELSE 0 END) AS BIGINT) AS drawn_agree FROM sl s JOIN crit c ON s.task_id = c.task_id AND s.slot = c.slot GROUP BY 1), n AS (SELECT count(*) AS M FROM crit)
    SELECT share, known, known_agree, drawn, drawn_agree, CASE WHEN drawn = 0 AND M > known THEN NULL ELSE round((known_agree + CASE WHEN M > known THEN (M - known) * drawn_agree / drawn ELSE 0 END) / M, 9) END AS accuracy FROM h, n""")
def accuracy_estimates(frame: DataFrame) -> DataFrame:
    """Agreement from what is known for certain and a random sample of the rest; null where a rest was left and nothing drawn of it."""
    total = frame.agg(F.count("*").alias("M"))
    agree = F.col("gold") == F.col("prediction")
    rows = nested(frame)
    n = lambda c: F.count_if(c)
    rows = rows.groupBy("share").agg(n(F.col("certify")).alias("known"), n(F.col("certify") & agree).alias("known_agree"), n(~F.col("certify")).alias("drawn"), n(~F.col("certify") & agree).alias("drawn_agree")).crossJoin(F.broadcast(total))  # one row
    rest = F.col("M") - F.col("known")
    value = (F.col("known_agree") + F.when(rest > 0, rest * F.col("drawn_agree") / F.col("drawn")).otherwise(0)) / F.col("M")
    return rows.select("share", "known", "known_agree", "drawn", "drawn_agree", F.when((F.col("drawn") == 0) & (rest > 0), None).otherwise(F.round(value, 9)).alias("accuracy"))


@query("accounting_identities", f"""WITH {ORDERS_SQL}, {curves_sql(seeds=(1,), shares=(0, 10, 50, 100))} SELECT count(*) AS rows, count(*) FILTER (certified_pass + certified_fail <> C) AS broken_certificates,
    count(*) FILTER (gate_fp + gate_ff <> gate_errors) AS broken_gate, count(*) FILTER (eager_fp + eager_ff <> eager_errors) AS broken_eager, count(*) FILTER (update_delta <> gate_errors - eager_errors) AS broken_delta, count(*) FILTER (abs(update_delta) > U) AS unbounded, count(*) FILTER (share = 0 AND (C <> 0 OR eager_errors <> E0)) AS broken_start FROM gr""", swept=True)
def accounting_identities(frame: DataFrame) -> DataFrame:
    """How many rows of the grid break an identity that all have to keep: all zero."""
    n = lambda name, e: F.count_if(F.expr(e)).alias(name)
    return curves(frame, seeds=(1,), shares=(0, 10, 50, 100)).agg(
        F.count("*").alias("rows"), n("broken_certificates", "certified_pass + certified_fail <> C"), n("broken_gate", "gate_fp + gate_ff <> gate_errors"), n("broken_eager", "eager_fp + eager_ff <> eager_errors"),
        n("broken_delta", "update_delta <> gate_errors - eager_errors"), n("unbounded", "abs(update_delta) > U"), n("broken_start", "share = 0 AND (C <> 0 OR eager_errors <> E0)"),
    )
