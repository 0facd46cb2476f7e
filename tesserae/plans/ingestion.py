"""Queries on masked ingestion, key sets, components, splits, text verdicts, merges, costs and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import graph, ranking, shards
from tesserae.operators.storage import stored
from tesserae.sources import files, frames
from tesserae.sources.frames import ORDERS_SQL

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(name: str):
    return lambda spark, sf_dir: frames.table(spark, sf_dir, name)


documents, events, orders, conversations = (_table(n) for n in ("documents", "events", "orders", "conversations"))


# ---------------------------------------------------------------- key sets


@query("set_equality_join", """WITH s AS (SELECT o_custkey AS owner, string_agg(DISTINCT CAST(month(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(month(o_orderdate) AS VARCHAR)) AS keys, o_custkey % 2 AS side FROM orders GROUP BY 1, 3),
    u AS (SELECT side, keys, min(owner) AS owner FROM s GROUP BY 1, 2 HAVING count(*) = 1) SELECT l.owner AS left_owner, r.owner AS right_owner, l.keys FROM u l JOIN u r USING (keys) WHERE l.side = 0 AND r.side = 1""")
def set_equality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of two sides with equal key sets, where the set has one owner on each side."""
    keys = F.array_join(F.array_sort(F.collect_set(F.month("o_orderdate").cast("string"))), ",")
    sets = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("owner")).agg(keys.alias("keys")).withColumn("side", F.col("owner") % 2)
    single = sets.groupBy("side", "keys").agg(F.min("owner").alias("owner"), F.count("*").alias("n")).where("n = 1")
    left = single.where("side = 0").select("keys", F.col("owner").alias("left_owner"))
    return left.join(single.where("side = 1").select("keys", F.col("owner").alias("right_owner")), "keys").select("left_owner", "right_owner", "keys")


@query("common_frame", "SELECT o_custkey AS base_id, count(*) AS orders FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def common_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that every producer covers: one aggregation, not an intersection for each producer."""
    rows = orders(spark, sf_dir)
    every = rows.agg(F.count_distinct("o_orderpriority").alias("producers"))
    some = rows.groupBy(F.col("o_custkey").alias("base_id")).agg(F.count("*").alias("orders"), F.count_distinct("o_orderpriority").alias("covered"))
    return some.crossJoin(F.broadcast(every)).where("covered = producers").select("base_id", "orders")  # one row


@query("role_intersection", "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1 HAVING count(DISTINCT role) FILTER (role IN ('user', 'assistant', 'system')) = 3")
def role_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.count_distinct(F.when(F.col("role").isin("user", "assistant", "system"), F.col("role")))
    return conversations(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("turns"), roles.alias("roles")).where("roles = 3").select("conv_id", "turns")


@query("role_pairs", "SELECT a.conv_id, a.turn, b.turn AS answer_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def role_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir)
    asked = rows.where("role = 'user'").select("conv_id", "turn", (F.col("turn") + 1).alias("answer_turn"))
    return asked.join(rows.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answer_turn")), ["conv_id", "answer_turn"]).select("conv_id", "turn", "answer_turn")


@query("key_diagnostics", "SELECT count(*) FILTER (c IS NOT NULL AND o IS NOT NULL) AS shared, count(*) FILTER (o IS NULL) AS only_left, count(*) FILTER (c IS NULL) AS only_right FROM (SELECT c_custkey AS c FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON c = o")
def key_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = frames.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"))
    both = left.join(orders(spark, sf_dir).select(F.col("o_custkey").alias("o")).distinct(), F.col("c") == F.col("o"), "full_outer")
    n = lambda s: F.count_if(F.expr(s))
    return both.agg(n("c IS NOT NULL AND o IS NOT NULL").alias("shared"), n("o IS NULL").alias("only_left"), n("c IS NULL").alias("only_right"))


@query("connected_components", """WITH RECURSIVE t AS (SELECT doc_id AS node, md5(text) AS token FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'n' || md5(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))) FROM documents WHERE text IS NOT NULL),
    hub AS (SELECT token, min(node) AS hub FROM t GROUP BY 1), e AS (SELECT DISTINCT node AS a, hub AS b FROM t JOIN hub USING (token) WHERE node <> hub), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.a, r.seen FROM r JOIN b ON r.node = b.b) SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one text, as it is or but for case and white space, directly or over others; named after the smallest id."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("node"), "text")
    plain = F.lower(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")))
    return graph.by_tokens(docs.select("node", F.md5("text").alias("token")).unionByName(docs.select("node", F.concat(F.lit("n"), F.md5(plain)).alias("token"))))


@query("canary_top32", f"WITH {ORDERS_SQL} SELECT producer, task_id, slot FROM (SELECT *, row_number() OVER (PARTITION BY producer ORDER BY sha256('canary|1|' || task_id || '|' || slot)) AS n FROM crit) WHERE n <= 32")
def canary_top32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the 32 smallest salted hashes of each producer. Spark keeps the first 32 of each task before it shuffles."""
    rows = frames.orders_frame(spark, sf_dir).withColumn("key", ranking.priority("canary", 1, "task_id", "slot"))
    return rows.withColumn("n", F.row_number().over(W.partitionBy("producer").orderBy("key"))).where("n <= 32").select("producer", "task_id", "slot")


@query("reference_panel_pick", f"""WITH {ORDERS_SQL}, r AS (SELECT base_id, producer, min(sha256('panel|1|' || base_id || '|' || producer || '|' || task_id)) AS h FROM crit GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY h) AS n FROM r)
    SELECT base_id, max(producer) FILTER (n = 1) AS rater_a, max(producer) FILTER (n = 2) AS rater_b, count(*) AS raters FROM k GROUP BY 1 HAVING count(*) >= 2""")
def reference_panel_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct raters for each output by identity hash: the first of each rater, then the first two raters."""
    rows = frames.orders_frame(spark, sf_dir).select("base_id", "producer", ranking.priority("panel", 1, "base_id", "producer", "task_id").alias("h"))
    first = rows.groupBy("base_id", "producer").agg(F.min("h").alias("h"))
    raters = F.array_sort(F.collect_list(F.struct("h", "producer")))
    return first.groupBy("base_id").agg(raters.alias("r")).where("size(r) >= 2").select("base_id", F.col("r")[0]["producer"].alias("rater_a"), F.col("r")[1]["producer"].alias("rater_b"), F.size("r").cast("long").alias("raters"))


@query("peer_diagnostics", f"""WITH {ORDERS_SQL}, t AS (SELECT base_id, producer, task_id, min(gold) AS g, min(prediction) AS p FROM crit GROUP BY 1, 2, 3),
    o AS (SELECT a.task_id, a.g, a.p, count(*) AS peers, bool_or(b.g = a.p) AS has_one, bool_and(b.g = a.p) AS has_all FROM t a JOIN t b ON a.base_id = b.base_id AND a.producer <> b.producer GROUP BY 1, 2, 3)
    SELECT g AS reference_pass, p AS predicted_pass, count(*) AS tasks, CAST(sum(peers) AS BIGINT) AS pairs, count(*) FILTER (has_one) AS some_peer, count(*) FILTER (has_all) AS every_peer FROM o GROUP BY 1, 2""")
def peer_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does another rater of the same output side with the prediction? Counted from each family's totals, without pairing its tasks."""
    frame = frames.orders_frame(spark, sf_dir)
    t = frame.groupBy("base_id", "producer", "task_id").agg(F.min("gold").alias("g"), F.min("prediction").alias("p"))
    own = t.groupBy("base_id", "producer").agg(F.count("*").alias("n_own"), F.sum("g").alias("g_own"))
    every = t.groupBy("base_id").agg(F.count("*").alias("n_all"), F.sum("g").alias("g_all"))
    rows = t.join(own, ["base_id", "producer"]).join(every, "base_id").withColumn("peers", F.col("n_all") - F.col("n_own")).where("peers > 0")
    passes = F.col("g_all") - F.col("g_own")
    same = F.when(F.col("p") == 1, passes).otherwise(F.col("peers") - passes)
    return rows.withColumn("same", same).groupBy(F.col("g").alias("reference_pass"), F.col("p").alias("predicted_pass")).agg(F.count("*").alias("tasks"), F.sum("peers").alias("pairs"), F.count_if(F.expr("same > 0")).alias("some_peer"), F.count_if(F.expr("same = peers")).alias("every_peer"))


# ---------------------------------------------------------------- masks and gates

_REASON = "CASE WHEN quality IS NULL AND toxic IS NULL THEN 'missing' WHEN quality IS NULL THEN 'quality_missing' WHEN toxic IS NULL THEN 'toxic_missing' WHEN n_chars < 100 THEN 'short' ELSE 'present' END"


@query("missing_reason_histogram", f"SELECT lang, {_REASON} AS reason, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def missing_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = documents(spark, sf_dir).select("doc_id", "lang", "n_chars").join(frames.table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.groupBy("lang", F.expr(_REASON).alias("reason")).agg(F.count("*").alias("n"))


@query("masked_status", """WITH v AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '"ERR"' WHEN 2 THEN 'true' WHEN 3 THEN '"0.8"' WHEN 4 THEN '-1' WHEN 5 THEN '1.0' ELSE CAST(round(value / 100, 2) AS VARCHAR) END AS raw FROM events)
    SELECT CASE WHEN raw IS NULL OR raw = 'null' THEN 'missing' WHEN raw = '"ERR"' THEN 'error' WHEN regexp_matches(raw, '^-?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?$') AND TRY_CAST(raw AS DOUBLE) BETWEEN 0 AND 1 THEN 'present' ELSE 'unparseable' END AS status, count(*) AS n FROM v GROUP BY 1""")
def masked_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be said of raw score literals before any value is looked at."""
    k = F.col("event_id") % 7
    score = F.round(F.col("value") / 100 * 100, 0) / 100  # as the SQL's doubles round: 1.005 * 100 is below 100.5
    raw = F.when(k == 0, F.lit(None)).when(k == 1, '"ERR"').when(k == 2, "true").when(k == 3, '"0.8"').when(k == 4, "-1").when(k == 5, "1.0").otherwise(score.cast("string"))
    return events(spark, sf_dir).groupBy(files.score_status(raw).alias("status")).agg(F.count("*").alias("n"))


@query("gate_counts", "SELECT count(DISTINCT source) AS clusters, count(*) AS units, count(quality) AS labelled, round(count(quality) / count(*), 9) AS retention, count(DISTINCT source) >= 10 AS enough_clusters, count(quality) / count(*) >= 0.7 AS enough_retention FROM documents LEFT JOIN labels USING (doc_id)")
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = documents(spark, sf_dir).select("doc_id", "source").join(frames.table(spark, sf_dir, "labels"), "doc_id", "left")
    kept = F.count("quality") / F.count("*")
    return both.agg(F.count_distinct("source").alias("clusters"), F.count("*").alias("units"), F.count("quality").alias("labelled"), F.round(kept, 9).alias("retention"), (F.count_distinct("source") >= 10).alias("enough_clusters"), (kept >= 0.7).alias("enough_retention"))


@query("whole_task_exclusion", "SELECT source || '/' || lang AS task_id, count(*) AS n, CAST(sum(quality) AS BIGINT) AS passes FROM documents LEFT JOIN labels USING (doc_id) WHERE source || '/' || lang NOT IN (SELECT source || '/' || lang FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL) GROUP BY 1")
def whole_task_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task with any missing label goes as a whole; missing is never counted as failed."""
    both = documents(spark, sf_dir).select("doc_id", F.concat_ws("/", "source", "lang").alias("task_id")).join(frames.table(spark, sf_dir, "labels"), "doc_id", "left")
    agg = both.groupBy("task_id").agg(F.count("*").alias("n"), F.count("quality").alias("known"), F.sum("quality").cast("long").alias("passes"))
    return agg.where("n = known").select("task_id", "n", "passes")


@query("criterion_jobs", f"WITH {ORDERS_SQL} SELECT task_id, slot, sha256('job|1|' || task_id || '|' || slot || '|' || producer) AS job_id FROM crit")
def criterion_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grading request for each criterion, named by a hash chain of what it is about."""
    return frames.orders_frame(spark, sf_dir).select("task_id", "slot", ranking.priority("job", 1, "task_id", "slot", "producer").alias("job_id"))


# ---------------------------------------------------------------- text


@query("yes_no_parser", "SELECT CASE WHEN w = 'yes' THEN 1 WHEN w = 'no' THEN 0 ELSE -1 END AS label, count(*) AS n FROM (SELECT list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]+')[1:5], lambda x: lower(x)), lambda x: x IN ('yes', 'no'))[1] AS w FROM documents) GROUP BY 1")
def yes_no_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy(F.coalesce(text.yes_or_no(F.col("text")), F.lit(-1)).alias("label")).agg(F.count("*").alias("n"))


@query("text_digests", "SELECT conv_id, turn, sha256(text) AS digest, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS collapsed FROM conversations")
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("conv_id", "turn", F.sha2("text", 256).alias("digest"), F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")).alias("collapsed"))


@query("normal_texts", "SELECT conv_id, turn, sha256(trim(regexp_replace(nfc_normalize(text), '[ \\t\\n\\r]+', ' ', 'g'))) AS digest FROM conversations")
def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in Unicode's composed form (NFC), white space as one space: what is one text to a reader has one digest."""
    rows = text.composed(conversations(spark, sf_dir).select("conv_id", "turn", "text"), "text")
    return rows.select("conv_id", "turn", F.sha2(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")), 256).alias("digest"))


@query("cut_middle", "SELECT doc_id, CASE WHEN length(text) <= 450 THEN text ELSE left(text, 200) || chr(10) || '[...]' || chr(10) || right(text, 200) END AS short FROM documents")
def cut_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.cut_middle(F.col("text"), 450).alias("short"))


def _verdict_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    words = lambda ws: ", ".join(quoted(w) for w in ws)
    return f"""WITH a AS (SELECT lang, text, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]+')[1:5], lambda x: lower(x)), lambda x: x IN ('yes', 'no'))[1] AS plain,
        list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '')[1] AS line FROM documents),
    w AS (SELECT *, trim(regexp_replace(lower(regexp_replace(regexp_replace(line, {quoted(text.QUOTED)}, ' ', 'g'), {quoted(text.EMPHASIS)}, '', 'g')), '\\s+', ' ', 'g')) AS w FROM a),
    t AS (SELECT *, regexp_extract(w, '^[^\\pL\\pN_]*(\\pL+)[,.!:;，、。،]', 1) AS first, regexp_replace(w, {quoted(text.CONDITION)}, ' ', 'g') AS told FROM w),
    v AS (SELECT *, regexp_matches(told, {quoted(text.NEGATIVE)}) AS no, regexp_matches(regexp_replace(told, {quoted(text.NEGATIVE)}, ' ', 'g'), {quoted(text.POSITIVE)}) AS yes FROM t),
    r AS (SELECT lang, CASE WHEN plain IS NOT NULL THEN 'v1-yes-no' WHEN coalesce(regexp_replace(text, '\\s+', '', 'g'), '') = '' THEN 'missing-empty' WHEN first IN ({words(text.YES_WORDS)}) THEN 'first-word-lexicon+'
        WHEN first IN ({words(text.NO_WORDS)}) THEN 'first-word-lexicon-' WHEN regexp_matches(w, {quoted(text.ABSTAIN)}) THEN 'missing-abstain' WHEN regexp_matches(w, {quoted(text.PARTIAL)}) THEN 'missing-partial'
        WHEN no AND yes THEN 'missing-conflict' WHEN yes THEN 'verdict-phrase+' WHEN no THEN 'verdict-phrase-' ELSE 'missing-no-verdict' END AS k, plain FROM v)
    SELECT lang, rtrim(k, '+-') AS rule, CASE WHEN k = 'v1-yes-no' THEN CAST(plain = 'yes' AS INTEGER) WHEN k LIKE '%+' THEN 1 WHEN k IN ('first-word-lexicon-', 'verdict-phrase-') THEN 0 ELSE -1 END AS label, count(*) AS n FROM r GROUP BY 1, 2, 3"""


@query("verdict_rules", _verdict_sql())
def verdict_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that decide free-text answers, counted by language; small cases are held against expected labels in tests."""
    v = documents(spark, sf_dir).select("lang", text.verdict(F.col("text")).alias("v"))
    return v.groupBy("lang", "v.rule", F.coalesce("v.label", F.lit(-1)).alias("label")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- runs, repairs, costs, ledgers

_RUNS = "runs AS (SELECT task_id, producer, CASE WHEN slot % 5 <> 4 THEN prediction END AS a, CASE WHEN slot % 7 <> 6 THEN second END AS b FROM crit)"
_KIND = "CASE WHEN a IS NULL AND b IS NULL THEN 'both_missing' WHEN a IS NULL THEN 'first_missing' WHEN b IS NULL THEN 'second_missing' WHEN a = b THEN 'agree' WHEN a = 1 THEN 'pass_fail' ELSE 'fail_pass' END"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.orders_frame(spark, sf_dir).select("task_id", "slot", "producer", F.when(F.col("slot") % 5 != 4, F.col("prediction")).alias("a"), F.when(F.col("slot") % 7 != 6, F.col("secondary")[0]).alias("b"))


@query("two_run_agreement", f"WITH {ORDERS_SQL}, {_RUNS} SELECT coalesce(producer, 'all') AS producer, kind, count(*) AS n FROM (SELECT producer, {_KIND} AS kind FROM runs) GROUP BY GROUPING SETS ((producer, kind), (kind))")
def two_run_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).select("producer", F.expr(_KIND).alias("kind"))
    return rows.groupingSets([["producer", "kind"], ["kind"]], "producer", "kind").agg(F.count("*").alias("n")).select(F.coalesce("producer", F.lit("all")).alias("producer"), "kind", "n")


@query("unit_verdict_agreement", f"WITH {ORDERS_SQL}, {_RUNS} SELECT min(a) = 1 AS first_pass, min(b) = 1 AS second_pass, count(*) AS tasks FROM runs GROUP BY task_id HAVING count(a) = count(*) AND count(b) = count(*)".replace("SELECT min(a)", "SELECT first_pass, second_pass, count(*) AS tasks FROM (SELECT min(a)").replace("count(*) AS tasks FROM runs", "task_id FROM runs") + ") GROUP BY 1, 2")
def unit_verdict_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _runs(spark, sf_dir).groupBy("task_id").agg(F.min("a").alias("x"), F.min("b").alias("y"), F.count("*").alias("n"), F.count("a").alias("na"), F.count("b").alias("nb")).where("n = na AND n = nb")
    return t.groupBy((F.col("x") == 1).alias("first_pass"), (F.col("y") == 1).alias("second_pass")).agg(F.count("*").alias("tasks"))


@query("repair_merge", f"WITH {ORDERS_SQL}, {_RUNS} SELECT producer, count(*) AS n, count(a) AS labelled_before, count(coalesce(a, b)) AS labelled_after, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS repaired FROM runs GROUP BY 1")
def repair_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing labels, and no others, are taken from the repair run."""
    return _runs(spark, sf_dir).groupBy("producer").agg(F.count("*").alias("n"), F.count("a").alias("labelled_before"), F.count(F.coalesce("a", "b")).alias("labelled_after"), F.count_if(F.expr("a IS NULL AND b IS NOT NULL")).alias("repaired"))


RATES = (100, 25, 400)
_COST = f"CAST((length(text) * {RATES[0]} + (turn % 3) * 64 * {RATES[1]} + 32 * {RATES[2]}) * CASE WHEN length(text) > 1500 THEN 2 ELSE 1 END AS BIGINT)"


def _cost():
    return text.token_cost(F.length("text"), (F.col("turn") % 3) * 64, F.lit(32), RATES, F.length("text") > 1500)


@query("token_cost", f"SELECT role, count(*) AS calls, CAST(sum({_COST}) AS BIGINT) AS nano, CAST(max({_COST}) AS BIGINT) AS dearest FROM conversations GROUP BY 1")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).withColumn("nano", _cost()).groupBy("role").agg(F.count("*").alias("calls"), F.sum("nano").alias("nano"), F.max("nano").alias("dearest"))


@query("cost_projection", f"SELECT role, count(*) AS jobs, count(*) FILTER (conv_id % 10 = 0) AS canary, round(avg(CASE WHEN conv_id % 10 = 0 THEN {_COST} END) * count(*) * 1.25 / 1e9, 6) AS projected_usd, coalesce(avg(CASE WHEN conv_id % 10 = 0 THEN {_COST} END) * count(*) * 1.25 / 1e9 <= 100, false) AS within FROM conversations GROUP BY 1")
def cost_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cost of the canary calls, times all calls and a margin, against a cap."""
    rows = conversations(spark, sf_dir).withColumn("canary", F.col("conv_id") % 10 == 0)
    usd = F.avg(F.when(F.col("canary"), _cost())) * F.count("*") * 1.25 / 1e9
    return rows.groupBy("role").agg(F.count("*").alias("jobs"), F.count_if("canary").alias("canary"), F.round(usd, 6).alias("projected_usd"), F.coalesce(usd <= 100, F.lit(False)).alias("within"))


CAP_NANO = 50_000_000_000
_NANO = "CAST(ceil(CAST(value AS DECIMAL(28, 12)) * 10000000) AS BIGINT)"


@query("budget_ledger", f"""WITH l AS (SELECT event_id, {_NANO} AS cost, coalesce(CAST(sum({_NANO}) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS committed FROM events)
    SELECT event_id, cost, committed, committed + cost <= {CAP_NANO} AS admitted FROM l""")
def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations in order of time against a cap: what was committed before each, and whether it still fits.

    Sums run within seconds, seconds' totals within hours, and the hours' totals over all; no task orders the whole log.
    """
    cost = F.ceil(F.col("value").cast("decimal(28,12)") * F.lit(10_000_000).cast("decimal(10,0)")).cast("long")
    rows = events(spark, sf_dir).select("event_id", "ts", cost.alias("cost"))
    out = ranking.global_offset(rows, ranking.by_time("ts"), ["ts", "event_id"], F.col("cost"), "committed")
    return out.select("event_id", "cost", "committed", (F.col("committed") + F.col("cost") <= CAP_NANO).alias("admitted"))


@query("exactly_once_matching", "SELECT count(*) FILTER (r IS NOT NULL AND a IS NOT NULL) AS matched, count(*) FILTER (a IS NULL) AS unanswered, count(*) FILTER (r IS NULL) AS unasked, CAST(max(coalesce(n, 0)) AS BIGINT) AS most_answers FROM (SELECT o_orderkey AS r FROM orders) FULL JOIN (SELECT l_orderkey AS a, count(*) AS n FROM lineitem GROUP BY 1) ON r = a")
def exactly_once_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_once(orders(spark, sf_dir).select(F.col("o_orderkey").alias("r")), frames.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a")))


def match_once(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests (r) and answers (a): how many met, how many of each side met nothing, and the most answers to one request."""
    answers = answers.groupBy("a").agg(F.count("*").alias("n"))
    n = lambda s: F.count_if(F.expr(s))
    return asked.join(answers, F.col("r") == F.col("a"), "full_outer").agg(n("r IS NOT NULL AND a IS NOT NULL").alias("matched"), n("a IS NULL").alias("unanswered"), n("r IS NULL").alias("unasked"), F.max(F.coalesce("n", F.lit(0))).cast("long").alias("most_answers"))


@query("dataset_profile", "SELECT lang, count(*) AS n, count(*) FILTER (text IS NULL) AS nulls, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(min(length(text)) AS INTEGER) AS shortest, CAST(max(length(text)) AS INTEGER) AS longest, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.length("text")
    return documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("nulls"), F.sum(d).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.min(d).alias("shortest"), F.max(d).alias("longest"), F.count_distinct("source").alias("sources"))


@query("channel_combinations", "WITH c AS (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders) SELECT a.p AS one, b.p AS two, count(*) AS shared FROM c a JOIN c b ON a.o_custkey = b.o_custkey AND a.p < b.p GROUP BY 1, 2")
def channel_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage shared by each pair of channels: a family's set of channels, of which there are few, gives its pairs."""
    sets = orders(spark, sf_dir).groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("one"), y.alias("two")))))
    return sets.select(F.inline(pairs)).groupBy("one", "two").agg(F.count("*").alias("shared"))


@query("shard_packing", """WITH RECURSIVE f AS (SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS copy FROM conversations WHERE text IS NOT NULL),
    o AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS place FROM f WHERE copy = 1), q AS (SELECT bytes, place, row_number() OVER (ORDER BY place) AS i FROM o WHERE bytes <= 20000),
    s AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS held, CAST([] AS BIGINT[]) AS n, CAST([] AS BIGINT[]) AS firsts, CAST(NULL AS BIGINT) AS place, CAST(NULL AS BIGINT) AS shard
        UNION ALL SELECT i, CASE WHEN spot IS NULL THEN list_append(held, bytes) ELSE list_transform(held, lambda h, j: CASE WHEN j = spot THEN h + bytes ELSE h END) END,
            CASE WHEN spot IS NULL THEN list_append(n, 1) ELSE list_transform(n, lambda c, j: CASE WHEN j = spot THEN c + 1 ELSE c END) END, CASE WHEN spot IS NULL THEN list_append(firsts, place) ELSE firsts END,
            place, CASE WHEN spot IS NULL THEN place ELSE firsts[spot] END
        FROM (SELECT q.i, held, n, firsts, q.place, q.bytes, list_position(list_transform(held, lambda h, j: h + q.bytes <= 20000 AND n[j] < 100), true) AS spot FROM s JOIN q ON q.i = s.i + 1))
    SELECT conv_id, turn, bytes, shard FROM o LEFT JOIN (SELECT place, shard FROM s WHERE i > 0) USING (place)""")
def shard_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 100 requests and 20,000 bytes, by first fit in order over the whole table.

    A prompt that occurs again is asked once, where it first stands. A shard is named by the place of its first request; a request
    over the cap has none.
    """
    rows = conversations(spark, sf_dir).where("text IS NOT NULL")
    first = rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("conv_id", "turn", F.octet_length("text").cast("long").alias("bytes"))).alias("x")).select("x.*")
    by = [*ranking.by_number("conv_id"), [F.col("conv_id")], [F.floor(F.col("turn") / 4096)]]  # a long conversation is numbered in parts
    placed = stored(ranking.global_offset(first, by, ["turn"], name="place"), "requests")
    return shards.first_fit(placed, 20_000, 100).select("conv_id", "turn", "bytes", "shard")


# ---------------------------------------------------------------- requests, responses, prices


@query("uri_split", "SELECT page_id, regexp_extract(url, '^([a-z][a-z0-9+.-]*)://([^/]*)/?(.*)$', 1) AS scheme, regexp_extract(url, '^([a-z][a-z0-9+.-]*)://([^/]*)/?(.*)$', 2) AS host, regexp_extract(url, '^([a-z][a-z0-9+.-]*)://([^/]*)/?(.*)$', 3) AS path FROM pages")
def uri_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.regexp_extract("url", r"^([a-z][a-z0-9+.-]*)://([^/]*)/?(.*)$", k)
    return frames.table(spark, sf_dir, "pages").select("page_id", part(1).alias("scheme"), part(2).alias("host"), part(3).alias("path"))


_CODE = "CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 400 WHEN 2 THEN 401 WHEN 3 THEN 429 WHEN 4 THEN 500 ELSE 503 END"
_CLASS = "CASE WHEN code < 400 THEN 'none' WHEN code IN (401, 403) THEN 'fatal' WHEN code = 429 OR code >= 500 THEN 'retryable' ELSE 'definite' END"


@query("error_classes", f"SELECT {_CLASS} AS class, count(*) AS n FROM (SELECT {_CODE} AS code FROM events) GROUP BY 1")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response codes as definite, retryable or fatal errors."""
    return events(spark, sf_dir).select(F.expr(_CODE).alias("code")).groupBy(F.expr(_CLASS).alias("class")).agg(F.count("*").alias("n"))


@query("yes_no_mass", """WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: exp(-20 * abs(CAST(x AS DOUBLE)))) AS e FROM embeddings),
    s AS (SELECT vec_id, list_sum(list_filter(e, lambda x, i: i % 2 = 1)) AS yes, list_sum(list_filter(e, lambda x, i: i % 2 = 0)) AS no FROM m)
    SELECT vec_id, round(yes / (yes + no), 6) AS score, yes / (yes + no) >= 0.5 AS label FROM s WHERE yes + no > 0.0001""")
def yes_no_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability mass of two classes of tokens from their log probabilities, within arrays; positions stand for tokens here."""
    e = F.transform("embedding", lambda x: F.exp(-20 * F.abs(x.cast("double"))))
    part = lambda odd: F.aggregate(F.filter("e", lambda x, i: i % 2 == odd), F.lit(0.0), lambda a, x: a + x)
    rows = frames.table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e")).select("vec_id", part(0).alias("yes"), part(1).alias("no")).where("yes + no > 0.0001")
    share = F.col("yes") / (F.col("yes") + F.col("no"))
    return rows.select("vec_id", F.round(share, 6).alias("score"), (share >= 0.5).alias("label"))


PRICES = (("batch", 50), ("online", 100), ("cached", 25))
_PRICES = ", ".join(f"('{n}', {p})" for n, p in PRICES)


@query("token_stats", f"""WITH t AS (SELECT lang, length(text) AS n FROM documents WHERE text IS NOT NULL), p(scenario, rate) AS (VALUES {_PRICES}), s AS (SELECT lang, count(*) AS calls, CAST(sum(n) AS BIGINT) AS total, CAST(min(n) AS BIGINT) AS least, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, CAST(max(n) AS BIGINT) AS most FROM t GROUP BY 1)
    SELECT s.*, scenario, CAST(total * rate AS BIGINT) AS nano FROM s CROSS JOIN p""")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length statistics of requests, priced under a few scenarios."""
    n = F.length("text").cast("long")
    s = documents(spark, sf_dir).where("text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("calls"), F.sum(n).alias("total"), F.min(n).alias("least"), F.round(F.percentile(n, 0.5), 6).alias("median"), F.round(F.percentile(n, 0.95), 6).alias("p95"), F.max(n).alias("most"))
    prices = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(p).alias("rate")) for k, p in PRICES])).alias("price")
    return s.select("*", prices).select("lang", "calls", "total", "least", "median", "p95", "most", F.col("price.scenario").alias("scenario"), (F.col("total") * F.col("price.rate")).alias("nano"))


@query("page_channels", "SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1")
def page_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory by a grammar of names: channels and what each holds."""
    return frames.table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


@query("rubric_award_check", """SELECT l_returnflag AS category, count(*) AS items, count(*) FILTER (award <> weight * value) AS wrong_awards, CAST(sum(value) AS BIGINT) AS passes FROM (SELECT l_returnflag, CAST(l_tax AS DECIMAL(18, 6)) AS weight,
    CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_quantity < 3 THEN 1 ELSE 0 END ELSE CASE WHEN l_quantity > 6 THEN 1 ELSE 0 END END AS value,
    CASE WHEN l_quantity = 9 THEN CAST(0 AS DECIMAL(18, 6)) ELSE CAST(l_tax AS DECIMAL(18, 6)) * CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_quantity < 3 THEN 1 ELSE 0 END ELSE CASE WHEN l_quantity > 6 THEN 1 ELSE 0 END END END AS award FROM lineitem) GROUP BY 1""")
def rubric_award_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full credit as a bit, by the item's scoring mode, and awards held against weight times bit in exact decimals."""
    weight = F.col("l_tax").cast("decimal(18,6)")
    value = F.when(F.col("l_returnflag") == "N", (F.col("l_quantity") < 3).cast("int")).otherwise((F.col("l_quantity") > 6).cast("int"))
    rows = frames.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), "l_quantity", weight.alias("weight"), value.alias("value"))
    award = F.when(F.col("l_quantity") == 9, F.lit(0).cast("decimal(18,6)")).otherwise(F.col("weight") * F.col("value"))
    return rows.withColumn("award", award).groupBy("category").agg(F.count("*").alias("items"), F.count_if(F.col("award") != F.col("weight") * F.col("value")).alias("wrong_awards"), F.sum("value").alias("passes"))
