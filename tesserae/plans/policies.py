"""Queries on criterion frames: snapshots, policies, budget curves, allocations and contrasts. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators import accounting, ranking, validation
from tesserae.operators.storage import stored
from tesserae.plans import grid
from tesserae.sources import frames
from tesserae.sources.frames import ORDERS_SQL, TASKS_SQL

QUERIES: dict = {}
ORACLES: dict = {}
FIELDS = ", ".join(accounting.FIELDS)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def on_frame(name: str, sql: str, swept: bool = False):
    """Register f(frame) over the orders frame; its SQL may use crit and tasks.

    Where the SQL asks for a transcript, several steps read the frame, so it is stored first. swept: f takes nothing but curves of it.
    """
    made = grid.packed_orders if swept else grid.stored_frame if "item_key" in sql else frames.orders_frame

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(made(spark, sf_dir))
        ORACLES[name] = f"WITH {ORDERS_SQL}, {TASKS_SQL} {sql}" if not sql.startswith("WITH") else sql
        return f

    return add


def big(c):
    return F.sum(c).cast("long")


# ---------------------------------------------------------------- scans, checks, snapshots


@on_frame("frame_scan", "SELECT task_id, slot, base_id, producer, category, gold, prediction, second FROM crit")
def frame_scan(frame: DataFrame) -> DataFrame:
    return frame.select("task_id", "slot", "base_id", "producer", "category", "gold", "prediction", F.col("secondary")[0].alias("second"))


@query("frame_validate_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def frame_validate_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.repeated_keys(frames.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("frame_validate_contiguity", "SELECT l_orderkey AS task_id, false AS sound FROM lineitem GROUP BY 1 HAVING NOT (min(l_linenumber - 1) = 0 AND max(l_linenumber - 1) = count(*) - 1 AND count(DISTINCT l_linenumber) = count(*))")
def frame_validate_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_linenumber") - 1).alias("slot"))
    return validation.broken_slots(rows, ["task_id"])


@on_frame("disagreement_flags", "SELECT producer, count(*) AS n, CAST(count(*) FILTER (second <> prediction) AS BIGINT) AS flagged FROM crit GROUP BY 1")
def disagreement_flags(frame: DataFrame) -> DataFrame:
    return frame.groupBy("producer").agg(F.count("*").alias("n"), F.count_if(ranking.flagged()).alias("flagged"))


@on_frame("agreement_rate", "SELECT category, count(*) AS n, CAST(sum(CAST(gold = prediction AS INTEGER)) AS BIGINT) AS agree, round(sum(CAST(gold = prediction AS INTEGER)) / count(*), 9) AS rate FROM crit GROUP BY 1")
def agreement_rate(frame: DataFrame) -> DataFrame:
    agree = F.count_if(F.col("gold") == F.col("prediction"))
    return frame.groupBy("category").agg(F.count("*").alias("n"), agree.alias("agree"), F.round(agree / F.count("*"), 9).alias("rate"))


@on_frame("task_conjunction", "SELECT task_id, k, gf = 0 AS reference_pass, pf = 0 AS predicted_pass FROM tasks")
def task_conjunction(frame: DataFrame) -> DataFrame:
    return accounting.tasks(frame).select("task_id", "k", (F.col("gf") == 0).alias("reference_pass"), (F.col("pf") == 0).alias("predicted_pass"))


_CONFUSION = "count(*) AS tasks, count(*) FILTER (gf = 0 AND pf = 0) AS tp, count(*) FILTER (gf > 0 AND pf > 0) AS tn, count(*) FILTER (gf > 0 AND pf = 0) AS fp, count(*) FILTER (gf = 0 AND pf > 0) AS ff, count(*) FILTER (gf > 0 AND pf > 0 AND cf = 0) AS susceptible"


def confusion(frame: DataFrame, *keys: str) -> DataFrame:
    kinds = [F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("TP", "TN", "FP", "FF")]
    return accounting.tasks(frame).groupBy(*keys).agg(F.count("*").alias("tasks"), *kinds, F.count_if(F.expr("susceptible")).alias("susceptible"))


on_frame("task_confusion", f"SELECT {_CONFUSION} FROM tasks")(confusion)
on_frame("task_confusion_by_producer", f"SELECT producer, {_CONFUSION} FROM tasks GROUP BY 1")(lambda f: confusion(f, "producer"))


@on_frame("susceptible_tasks", "SELECT task_id, k, CAST(gf AS BIGINT) AS gf, CAST(pf AS BIGINT) AS pf, round(CAST(list_product([i / (gf + i) FOR i IN range(1, CAST(pf AS BIGINT) + 1)]) AS DOUBLE), 9) AS unmask FROM tasks WHERE gf > 0 AND pf > 0 AND cf = 0")
def susceptible_tasks(frame: DataFrame) -> DataFrame:
    """Tasks whose errors mask each other, with the chance 1 / C(f + q, q) that all false fails are revealed before any false pass."""
    one = F.aggregate(F.sequence(F.lit(1), F.col("pf").cast("int")), F.lit(1.0), lambda a, i: a * i / (F.col("gf") + i))
    return accounting.tasks(frame).where("susceptible").select("task_id", "k", F.col("gf").cast("long").alias("gf"), F.col("pf").cast("long").alias("pf"), F.round(one, 9).alias("unmask"))


@on_frame("certificate_lower_bound", "SELECT count(*) AS tasks, count(DISTINCT base_id) AS bases, CAST(sum(k) AS BIGINT) AS criteria, count(*) FILTER (gf = 0) AS reference_pass, count(*) FILTER (pf = 0) AS judge_pass, CAST(sum(CASE WHEN gf > 0 THEN 1 ELSE k END) AS BIGINT) AS certificate_lower_bound FROM tasks")
def certificate_lower_bound(frame: DataFrame) -> DataFrame:
    least = F.when(F.col("gf") > 0, 1).otherwise(F.col("k"))
    return accounting.tasks(frame).agg(F.count("*").alias("tasks"), F.count_distinct("base_id").alias("bases"), big("k").alias("criteria"), F.count_if(F.col("gf") == 0).alias("reference_pass"), F.count_if(F.col("pf") == 0).alias("judge_pass"), big(least).alias("certificate_lower_bound"))


@on_frame("criterion_mode_errors", "SELECT category, count(*) FILTER (gold = 0 AND prediction = 1) AS fp, count(*) FILTER (gold = 1 AND prediction = 0) AS ff FROM crit GROUP BY 1")
def criterion_mode_errors(frame: DataFrame) -> DataFrame:
    return frame.groupBy("category").agg(F.count_if(F.expr("gold = 0 AND prediction = 1")).alias("fp"), F.count_if(F.expr("gold = 1 AND prediction = 0")).alias("ff"))


@on_frame("rejection_modes", "SELECT modes, count(*) AS tasks FROM (SELECT task_id, string_agg(DISTINCT category, '+' ORDER BY category) FILTER (prediction = 0) AS modes FROM crit GROUP BY 1 HAVING min(gold) = 1 AND min(prediction) = 0) GROUP BY 1")
def rejection_modes(frame: DataFrame) -> DataFrame:
    modes = F.array_join(F.array_sort(F.collect_set(F.when(F.col("prediction") == 0, F.col("category")))), "+")
    tasks = frame.groupBy("task_id").agg(modes.alias("modes"), F.min("gold").alias("g"), F.min("prediction").alias("p")).where("g = 1 AND p = 0")
    return tasks.groupBy("modes").agg(F.count("*").alias("tasks"))


@on_frame("false_fail_coverage", """SELECT coverage, count(*) AS tasks FROM (SELECT task_id, CASE WHEN count(*) FILTER (second <> prediction) = 0 THEN 'no_flag'
    WHEN count(*) FILTER (second <> prediction AND prediction = 0) = 0 THEN 'only_predicted_pass' WHEN count(*) FILTER (second <> prediction AND prediction = 0) < count(*) FILTER (prediction = 0) THEN 'some' ELSE 'all' END AS coverage
    FROM crit GROUP BY 1 HAVING min(gold) = 1 AND min(prediction) = 0) GROUP BY 1""")
def false_fail_coverage(frame: DataFrame) -> DataFrame:
    """How the flags of wrongly rejected tasks lie on the criteria that reject them."""
    rows = frame.withColumn("flag", ranking.flagged())
    tasks = rows.groupBy("task_id").agg(F.min("gold").alias("g"), F.min("prediction").alias("p"), F.count_if(F.expr("flag")).alias("n"), F.count_if(F.col("flag") & (F.col("prediction") == 0)).alias("hit"), F.count_if(F.expr("prediction = 0")).alias("fails")).where("g = 1 AND p = 0")
    kind = F.when(F.col("n") == 0, "no_flag").when(F.col("hit") == 0, "only_predicted_pass").when(F.col("hit") < F.col("fails"), "some").otherwise("all")
    return tasks.groupBy(kind.alias("coverage")).agg(F.count("*").alias("tasks"))


# ---------------------------------------------------------------- policies

for _policy, _name in (("random_criterion", "order_random"), ("sc_natural", "order_sc_natural"), ("sc_random", "order_sc_random"), ("sc_judge", "order_sc_judge"), ("disagreement_only", "order_disagreement_only"), ("disagreement_then_random", "order_disagreement_then_random"), ("sc_disagreement", "order_sc_disagreement")):
    on_frame(_name, f"WITH {ORDERS_SQL}, {ranking.transcript_sql(_policy)} SELECT qnum, task_id, slot FROM tr")(lambda f, p=_policy: ranking.transcript(f, p).select("qnum", "task_id", "slot"))


def order_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All criteria in one random order: ids and priorities are stored once and ranked by levels; nothing else is read or written."""
    frame = frames.orders_frame(spark, sf_dir).select("task_id", "slot")
    keyed = stored(frame.withColumn("item_key", ranking.priority("criterion", 1, "task_id", "slot")), "keyed")
    return ranking.global_offset(keyed, ranking.by_hash(keyed, "item_key"), ["item_key"]).select((F.col("offset") + 1).alias("qnum"), "task_id", "slot")


QUERIES["order_random"] = order_random


@on_frame("task_order_predicted_fail", f"WITH {ORDERS_SQL}, {TASKS_SQL} SELECT task_id, row_number() OVER (ORDER BY pf, sha256('task|1|' || task_id), task_id) - 1 AS task_rank FROM tasks")
def task_order_predicted_fail(frame: DataFrame) -> DataFrame:
    return ranking.task_order(frame, "predicted_fail_count")


@on_frame("transcript_sc_judge", f"WITH {ORDERS_SQL}, {ranking.transcript_sql('sc_judge', 'release', 0)} SELECT qnum, task_id, slot, gold, prediction, CAST(gold <> prediction AS INTEGER) AS error_found FROM tr")
def transcript_sc_judge(frame: DataFrame) -> DataFrame:
    """Release order with canonical ties, as seed 0 has them."""
    return ranking.transcript(frame, "sc_judge", "release", 0).select("qnum", "task_id", "slot", "gold", "prediction", (F.col("gold") != F.col("prediction")).cast("int").alias("error_found"))


for _policy, _name in (("random_criterion", "budget_curve_random"), ("sc_judge", "budget_curve_sc_judge"), ("disagreement_then_random", "budget_curve_disagreement"), ("sc_disagreement", "budget_curve_sc_disagreement")):
    on_frame(_name, f"WITH {ORDERS_SQL}, {ranking.transcript_sql(_policy)}, {accounting.curve_sql(shares=grid.SHARES)} SELECT share, {FIELDS} FROM cv", swept=True)(lambda f, p=_policy: grid.curves(f, (p,), ("random",), (1,)).select("share", *accounting.FIELDS))


@on_frame("eager_vs_gated", f"WITH {ORDERS_SQL}, {ranking.transcript_sql('sc_random')}, {accounting.curve_sql()} SELECT share, eager_errors, gate_errors, update_delta, CAST(abs(update_delta) <= U AS BOOLEAN) AS bounded FROM cv")
def eager_vs_gated(frame: DataFrame) -> DataFrame:
    return accounting.curve(frame, ranking.transcript(frame, "sc_random")).select("share", "eager_errors", "gate_errors", "update_delta", (F.abs("update_delta") <= F.col("U")).alias("bounded"))


CAPS = (0, 10, 100, 500, 1000, 2500, 5000)


@on_frame("prefix_accounting", f"""WITH {ORDERS_SQL}, {ranking.transcript_sql('disagreement_only')}, {accounting.curve_sql()},
    caps AS (SELECT unnest([{', '.join(map(str, CAPS))}]) AS cap), x AS (SELECT t.*, caps.cap, least(caps.cap, L) AS u FROM cv_t t CROSS JOIN caps)
    SELECT CAST(cap AS BIGINT) AS cap, count(*) FILTER (cert <= u) AS C, count(*) FILTER (cert <= u AND t <> i) AS CW, count(*) FILTER (NOT t AND NOT i AND lft <= u AND u <= rgt) AS A,
    count(*) FILTER (t AND NOT i AND lft <= u AND u <= cert - 1) AS D, count(*) FILTER (first <= u AND u <= cert - 1) AS U FROM x GROUP BY cap""")
def prefix_accounting(frame: DataFrame) -> DataFrame:
    return accounting.at_caps(accounting.times(frame, ranking.transcript(frame, "disagreement_only")), list(CAPS)).select("cap", "C", "CW", "A", "D", "U")


def _first_share(frame: DataFrame, policy: str, share: int = 20) -> DataFrame:
    cap = accounting.share_caps(frame, (share,)).select("cap")
    return ranking.transcript(frame, policy).crossJoin(F.broadcast(cap)).where("qnum <= cap").select("task_id", "slot")


_SRS = f"{ranking.transcript_sql('random_criterion')}, capx AS (SELECT CAST(round_even(20 * count(*) / 100.0, 0) AS BIGINT) AS cap FROM crit), srs AS (SELECT task_id, slot FROM tr, capx WHERE qnum <= cap)"
_UNIT_SUMS = ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in accounting.UNIT_FIELDS)


@on_frame("query_metrics", f"""WITH {ORDERS_SQL}, {_SRS}, {accounting.unit_states_sql('srs', 'st')} SELECT CAST(sum(queried) AS BIGINT) AS actual_queries, CAST(sum(certified_tasks) AS BIGINT) AS certified_tasks,
    round(sum(certified_pass) / count(*), 9) AS pass_lower, round(1 - sum(certified_fail) / count(*), 9) AS pass_upper, round((sum(queried) - sum(criterion_errors_found)) / sum(n_criteria), 9) AS accuracy_lower,
    round((sum(n_criteria) - sum(criterion_errors_found)) / sum(n_criteria), 9) AS accuracy_upper, CAST(sum(residual_errors) AS BIGINT) AS residual_errors, CAST(sum(criterion_errors_found) AS BIGINT) AS criterion_errors_found FROM st""")
def query_metrics(frame: DataFrame) -> DataFrame:
    st = accounting.unit_states(frame, _first_share(frame, "random_criterion"))
    m, q, e, n = F.sum("n_criteria"), F.sum("queried"), F.sum("criterion_errors_found"), F.count("*")
    return st.agg(q.cast("long").alias("actual_queries"), big("certified_tasks").alias("certified_tasks"), F.round(F.sum("certified_pass") / n, 9).alias("pass_lower"), F.round(1 - F.sum("certified_fail") / n, 9).alias("pass_upper"), F.round((q - e) / m, 9).alias("accuracy_lower"), F.round((m - e) / m, 9).alias("accuracy_upper"), big("residual_errors").alias("residual_errors"), e.cast("long").alias("criterion_errors_found"))


_MIX = f"{ranking.transcript_sql('sc_judge', name='trj')}, {accounting.half_and_random_sql()}"


@on_frame("hybrid_sc50_srs", f"WITH {ORDERS_SQL}, {_MIX} SELECT task_id, slot, phase FROM mix")
def hybrid_sc50_srs(frame: DataFrame) -> DataFrame:
    return accounting.half_and_random(frame)


def marked(frame: DataFrame, cap_share: int = 20, seed: int = 1) -> DataFrame:
    """Criteria with m and s: whether they are in the half-and-random and in the simple random query set of one budget.

    Each set ends at a key, which is found without ranking the rest, so criteria are dealt by task once and nothing is joined to them.
    """
    cap = accounting.share_caps(frame, (cap_share,)).first()["cap"]
    item, fresh = (ranking.priority(purpose, seed, "task_id", "slot") for purpose in ("criterion", "fresh"))
    plain = ranking.cuts(frame.select(item.alias("key")), "key", [(0, 0, cap)])[0][0]
    rows = grid.judged(frame, seed)
    starts = rows.groupBy("task_id").agg(F.max("asked").alias("asked")).withColumn("task_key", ranking.priority("task", seed, "task_id"))
    half, part = ranking.cuts(starts, "task_key", [(0, 0, cap // 2)], F.col("asked"))[0]
    n_first = starts.agg(F.sum("asked")).first()[0] or 0 if half == "g" else cap // 2
    rows = rows.withColumn("first", grid.before_cut(seed, F.lit(half), F.lit(part)))
    rest = ranking.cuts(rows.where("NOT first").select(fresh.alias("key")), "key", [(0, 0, cap - n_first)])[0][0]
    return rows.select("task_id", "slot", "base_id", "gold", "prediction", (F.col("first") | (fresh <= rest)).alias("m"), (item <= plain).alias("s"))


def pairs(frame: DataFrame) -> DataFrame:
    """States of each task under the half-and-random and the simple random query set of one budget, side by side, from one aggregation."""
    return accounting.states(marked(frame), {"m": F.col("m"), "s": F.col("s")})


_PAIRS = f"{_SRS}, {_MIX}, {accounting.unit_states_sql('srs', 'sp')}, {accounting.unit_states_sql('mix', 'sm')}"


@on_frame("allocation_pairs", f"""WITH {ORDERS_SQL}, {_PAIRS} SELECT m.task_id, m.kind, CAST(m.queried - s.queried AS BIGINT) AS d_queried, m.certified_tasks - s.certified_tasks AS d_certified, m.residual_errors - s.residual_errors AS d_residual,
    m.gated_residual_errors - s.gated_residual_errors AS d_gated FROM sm m JOIN sp s ON m.task_id = s.task_id WHERE m.queried <> s.queried OR m.certified_tasks <> s.certified_tasks OR m.residual_errors <> s.residual_errors""")
def allocation_pairs(frame: DataFrame) -> DataFrame:
    d = lambda f: F.col(f"m_{f}") - F.col(f"s_{f}")
    return pairs(frame).select("task_id", "kind", d("queried").cast("long").alias("d_queried"), d("certified_tasks").alias("d_certified"), d("residual_errors").alias("d_residual"), d("gated_residual_errors").alias("d_gated")).where(
        "d_queried <> 0 OR d_certified <> 0 OR d_residual <> 0"
    )


@on_frame("allocation_summary", f"""WITH {ORDERS_SQL}, {_PAIRS} SELECT m.kind, count(*) AS tasks, CAST(sum(m.certified_tasks) AS BIGINT) AS mixed_certified, CAST(sum(s.certified_tasks) AS BIGINT) AS plain_certified,
    count(*) FILTER (m.certified_tasks > s.certified_tasks) AS only_mixed, count(*) FILTER (m.certified_tasks < s.certified_tasks) AS only_plain, CAST(sum(m.residual_errors - s.residual_errors) AS BIGINT) AS d_residual FROM sm m JOIN sp s ON m.task_id = s.task_id GROUP BY 1""")
def allocation_summary(frame: DataFrame) -> DataFrame:
    return pairs(frame).groupBy("kind").agg(
        F.count("*").alias("tasks"), big("m_certified_tasks").alias("mixed_certified"), big("s_certified_tasks").alias("plain_certified"), F.count_if(F.expr("m_certified_tasks > s_certified_tasks")).alias("only_mixed"),
        F.count_if(F.expr("m_certified_tasks < s_certified_tasks")).alias("only_plain"), big(F.col("m_residual_errors") - F.col("s_residual_errors")).alias("d_residual"),
    )


@on_frame("leave_one_base_out", f"""WITH {ORDERS_SQL}, {_PAIRS}, b AS (SELECT m.base_id, count(*) AS tasks, sum(m.residual_errors - s.residual_errors) AS part FROM sm m JOIN sp s ON m.task_id = s.task_id GROUP BY 1)
    SELECT base_id, tasks, CAST(part AS BIGINT) AS part, CAST((SELECT sum(part) FROM b) - part AS BIGINT) AS without FROM b""")
def leave_one_base_out(frame: DataFrame) -> DataFrame:
    """Each family's part in the difference of residual errors, and the difference without it."""
    part = pairs(frame).groupBy("base_id").agg(F.count("*").alias("tasks"), big(F.col("m_residual_errors") - F.col("s_residual_errors")).alias("part"))
    total = part.agg(F.sum("part").alias("total"))
    return part.crossJoin(F.broadcast(total)).select("base_id", "tasks", "part", (F.col("total") - F.col("part")).alias("without"))  # one row


@on_frame("budget_curve_without_base", f"""WITH {ORDERS_SQL.replace('crit AS', 'crit0 AS', 1)}, crit AS (SELECT * FROM crit0 WHERE base_id <> (SELECT min(base_id) FROM crit0)), {ranking.transcript_sql('random_criterion')}, {accounting.curve_sql(shares=grid.SHARES)} SELECT share, {FIELDS} FROM cv""")
def budget_curve_without_base(frame: DataFrame, base: int | None = None) -> DataFrame:
    """A family (by default the first) taken out after ranking: priorities are hashes, so those of the others stay, and ranks and budgets close up."""
    taken = frame.agg(F.min("base_id").alias("taken")) if base is None else frame.sparkSession.range(1).select(F.lit(base).alias("taken"))
    rest = frame.join(F.broadcast(taken), F.col("base_id") == F.col("taken"), "left_anti")  # one row
    return grid.curves(rest, ("random_criterion",), ("random",), (1,)).select("share", *accounting.FIELDS)


# ---------------------------------------------------------------- contrasts of policies

POINTS = tuple(range(0, 101, 10))


def curves(frame: DataFrame) -> DataFrame:
    """Curves of all policies: policy, policy_ord, share, actual_queries, certified and error counts. A small table from here on."""
    rows = grid.curves(frame, orders=("random",), shares=POINTS)
    number = F.array_position(F.array(*[F.lit(p) for p in ranking.POLICIES]), F.col("policy")).cast("int") - 1
    return rows.select("policy", number.alias("policy_ord"), "share", "actual_queries", F.col("C").alias("certified"), "eager_errors", "gate_errors")


_ORD = f"list_position([{', '.join(repr(p) for p in ranking.POLICIES)}], policy) - 1"
_CURVES = f"WITH {ORDERS_SQL}, {grid.curves_sql(orders=('random',), shares=POINTS)}, cu AS (SELECT policy, CAST({_ORD} AS INTEGER) AS policy_ord, share, actual_queries, C AS certified, eager_errors, gate_errors FROM gr)"
on_frame("policy_curves", f"{_CURVES} SELECT * FROM cu", swept=True)(curves)

_PAIRED = "pr AS (SELECT a.policy AS a, b.policy AS b, a.share, a.actual_queries = b.actual_queries AS active, a.certified - b.certified AS d_certified, a.eager_errors - b.eager_errors AS d_eager, a.gate_errors - b.gate_errors AS d_gate FROM cu a JOIN cu b ON a.share = b.share AND a.policy_ord < b.policy_ord)"


def policy_pairs(frame: DataFrame) -> DataFrame:
    """All pairs of policies at each share; active where both asked equally many queries."""
    rows = curves(frame)
    a, b = rows.alias("a"), rows.alias("b")
    d = lambda f: F.col(f"a.{f}") - F.col(f"b.{f}")
    return a.join(b, (F.col("a.share") == F.col("b.share")) & (F.col("a.policy_ord") < F.col("b.policy_ord"))).select(
        F.col("a.policy").alias("a"), F.col("b.policy").alias("b"), F.col("a.share").alias("share"), (F.col("a.actual_queries") == F.col("b.actual_queries")).alias("active"), d("certified").alias("d_certified"), d("eager_errors").alias("d_eager"), d("gate_errors").alias("d_gate")
    )


on_frame("policy_contrast", f"{_CURVES}, {_PAIRED} SELECT * FROM pr", swept=True)(policy_pairs)


@on_frame("pairwise_policies", f"{_CURVES}, {_PAIRED} SELECT a, b, count(*) AS points, count(*) FILTER (active) AS active, count(*) FILTER (d_eager < 0) AS a_fewer, count(*) FILTER (d_eager = 0) AS equal, count(*) FILTER (d_eager > 0) AS b_fewer FROM pr GROUP BY 1, 2", swept=True)
def pairwise_policies(frame: DataFrame) -> DataFrame:
    return policy_pairs(frame).groupBy("a", "b").agg(F.count("*").alias("points"), F.count_if(F.expr("active")).alias("active"), F.count_if(F.expr("d_eager < 0")).alias("a_fewer"), F.count_if(F.expr("d_eager = 0")).alias("equal"), F.count_if(F.expr("d_eager > 0")).alias("b_fewer"))


@on_frame("dominance_summary", f"{_CURVES}, {_PAIRED} SELECT a, b, count(*) FILTER (d_certified >= 0 AND d_eager <= 0 AND d_gate <= 0 AND (d_certified > 0 OR d_eager < 0 OR d_gate < 0)) AS a_dominates, count(*) FILTER (d_certified <= 0 AND d_eager >= 0 AND d_gate >= 0 AND (d_certified < 0 OR d_eager > 0 OR d_gate > 0)) AS b_dominates FROM pr GROUP BY 1, 2", swept=True)
def dominance_summary(frame: DataFrame) -> DataFrame:
    over = F.expr("d_certified >= 0 AND d_eager <= 0 AND d_gate <= 0 AND (d_certified > 0 OR d_eager < 0 OR d_gate < 0)")
    under = F.expr("d_certified <= 0 AND d_eager >= 0 AND d_gate >= 0 AND (d_certified < 0 OR d_eager > 0 OR d_gate > 0)")
    return policy_pairs(frame).groupBy("a", "b").agg(F.count_if(over).alias("a_dominates"), F.count_if(under).alias("b_dominates"))


@on_frame("objective_optimum_sets", f"""{_CURVES}, o AS (SELECT *, certified = max(certified) OVER w AS oc, eager_errors = min(eager_errors) OVER w AS oe, gate_errors = min(gate_errors) OVER w AS og FROM cu WINDOW w AS (PARTITION BY share))
    SELECT share, string_agg(policy, ',' ORDER BY policy_ord) FILTER (oc) AS best_certified, string_agg(policy, ',' ORDER BY policy_ord) FILTER (oe) AS best_eager, string_agg(policy, ',' ORDER BY policy_ord) FILTER (og) AS best_gated, bool_or(oc AND oe AND og) AS common FROM o GROUP BY 1""", swept=True)
def objective_optimum_sets(frame: DataFrame) -> DataFrame:
    w = W.partitionBy("share")
    rows = curves(frame).withColumns({"oc": F.col("certified") == F.max("certified").over(w), "oe": F.col("eager_errors") == F.min("eager_errors").over(w), "og": F.col("gate_errors") == F.min("gate_errors").over(w)})
    names = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("policy_ord", "policy")))), lambda x: x["policy"]), ",")
    return rows.groupBy("share").agg(names("oc").alias("best_certified"), names("oe").alias("best_eager"), names("og").alias("best_gated"), F.bool_or(F.col("oc") & F.col("oe") & F.col("og")).alias("common"))


@on_frame("first_all_certified", f"WITH {ORDERS_SQL}, {ranking.transcript_sql('sc_natural')}, {accounting.curve_sql()} SELECT max(L) AS total_queries, CASE WHEN max(cert) <= max(L) THEN max(cert) END AS first_all_certified FROM cv_t")
def first_all_certified(frame: DataFrame) -> DataFrame:
    t = accounting.times(frame, ranking.transcript(frame, "sc_natural"))
    return t.agg(F.max("L").alias("total_queries"), F.when(F.max("cert") <= F.max("L"), F.max("cert")).alias("first_all_certified"))


_WITNESS = f"""WITH {ORDERS_SQL}, {ranking.transcript_sql('random_criterion')},
    n AS (SELECT *, sum(CASE WHEN prediction > gold THEN 1 ELSE 0 END + CASE WHEN prediction < gold THEN -1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY qnum) AS change FROM tr),
    s AS (SELECT n.*, pf + change AS fails, lag(pf + change, 1, pf) OVER (PARTITION BY n.task_id ORDER BY qnum) AS before, gf FROM n JOIN (SELECT task_id, sum(1 - gold) AS gf, sum(1 - prediction) AS pf FROM crit GROUP BY 1) t ON n.task_id = t.task_id)
    SELECT qnum, task_id, base_id, slot, category FROM s WHERE gf > 0 AND fails = 0 AND before > 0 ORDER BY qnum LIMIT 5"""


@on_frame("new_fp_witnesses", _WITNESS)
def new_fp_witnesses(frame: DataFrame) -> DataFrame:
    """The first five queries after which a failing task passes though it didn't before: a report of five."""
    by_task = W.partitionBy("task_id").orderBy("qnum")
    asked = ranking.transcript(frame, "random_criterion").join(accounting.tasks(frame).where("gf > 0").select("task_id", "pf"), "task_id")
    fails = F.col("pf") + F.sum(F.col("prediction") - F.col("gold")).over(by_task)
    rows = asked.withColumn("fails", fails)
    rows = rows.withColumn("before", F.coalesce(F.lag("fails").over(by_task), F.col("pf")))
    return rows.where("fails = 0 AND before > 0").orderBy("qnum").limit(5).select("qnum", "task_id", "base_id", "slot", "category")


@on_frame("crossed_reference_scores", f"WITH {ORDERS_SQL}, {ranking.transcript_sql('random_criterion')}, {accounting.curve_sql(gold='second')} SELECT share, {FIELDS} FROM cv")
def crossed_reference_scores(frame: DataFrame) -> DataFrame:
    """Queries chosen without looking at a reference, scored by another one."""
    other = frame.withColumn("second", F.col("secondary")[0])
    return accounting.curve(other, ranking.transcript(frame, "random_criterion"), gold="second").select("share", *accounting.FIELDS)


@on_frame("reference_change_signs", f"""WITH {ORDERS_SQL}, {ranking.transcript_sql('random_criterion')}, {accounting.curve_sql(name='l')}, {accounting.curve_sql(gold='second', name='r')}, {ranking.transcript_sql('sc_random', name='ts')},
    {accounting.curve_sql('ts', name='ls')}, {accounting.curve_sql('ts', gold='second', name='rs')}, d AS (SELECT ls.eager_errors - l.eager_errors AS x, rs.eager_errors - r.eager_errors AS y FROM l JOIN r USING (share) JOIN ls USING (share) JOIN rs USING (share))
    SELECT count(*) AS points, count(*) FILTER (x * y < 0) AS reversed, count(*) FILTER (x * y > 0) AS same, count(*) FILTER (x = 0 AND y = 0) AS both_zero, count(*) FILTER ((x = 0) <> (y = 0)) AS one_zero FROM d""")
def reference_change_signs(frame: DataFrame) -> DataFrame:
    """Does the sign of a policy contrast hold under another reference?"""
    other = frame.withColumn("second", F.col("secondary")[0])
    parts = None
    for n, policy in enumerate(("random_criterion", "sc_random")):
        for gold in ("gold", "second"):
            rows = accounting.curve(other, ranking.transcript(frame, policy), gold=gold).select("share", F.col("eager_errors").alias(f"{gold}{n}"))
            parts = rows if parts is None else parts.join(rows, "share")
    d = parts.select((F.col("gold1") - F.col("gold0")).alias("x"), (F.col("second1") - F.col("second0")).alias("y"))
    return d.agg(F.count("*").alias("points"), F.count_if(F.expr("x * y < 0")).alias("reversed"), F.count_if(F.expr("x * y > 0")).alias("same"), F.count_if(F.expr("x = 0 AND y = 0")).alias("both_zero"), F.count_if(F.expr("(x = 0) <> (y = 0)")).alias("one_zero"))
