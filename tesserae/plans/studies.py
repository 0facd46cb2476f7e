"""Reconciled intake, paired frames, stratified inference, disclosure and staged release. Each query has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators import accounting, ranking
from tesserae.plans import estimation
from tesserae.sources import frames
from tesserae.sources.frames import ORDERS_SQL, TASKS_SQL

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None, frame: bool = False):
    """Register f(spark, sf_dir), or f(frame) over the orders frame, whose SQL may use crit and tasks."""

    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(frames.orders_frame(spark, sf_dir))) if frame else f
        if sql:
            ORACLES[name] = f"WITH {ORDERS_SQL}, {TASKS_SQL}{sql}" if frame else sql
        return f

    return add


def n_if(c, name: str):
    return F.count_if(F.expr(c) if isinstance(c, str) else c).alias(name)


def _r(c):
    return F.round(c, 9)


# ---------------------------------------------------------------- star schema and paired sources


@query("star_reconcile", """SELECT count(*) AS scores, count(*) FILTER (o.o_orderkey IS NULL) AS unknown_annotations, count(*) FILTER (p.p_partkey IS NULL) AS unknown_items, count(*) FILTER (c.c_custkey IS NULL) AS unknown_outputs,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM lineitem LEFT JOIN orders o ON l_orderkey = o.o_orderkey LEFT JOIN part p ON l_partkey = p.p_partkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def star_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores meet their annotations, items and outputs; keys that meet nothing are counted, totals are summed as decimals.

    Dimensions are left to the optimizer: it broadcasts those that statistics show to be small.
    """
    t = lambda name: frames.table(spark, sf_dir, name)
    rows = t("lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    rows = rows.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t("part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left")
    rows = rows.join(t("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.agg(F.count("*").alias("scores"), n_if("o_orderkey IS NULL", "unknown_annotations"), n_if("p_partkey IS NULL", "unknown_items"), n_if("c_custkey IS NULL", "unknown_outputs"), F.sum("price").cast("double").alias("total"))


_SIDES = """h AS (SELECT l_orderkey AS id, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority FROM orders)"""


@query("paired_annotations", f"""WITH {_SIDES} SELECT count(*) AS pairs, count(*) FILTER (a.id IS NULL) AS only_scores, count(*) FILTER (h.id IS NULL) AS only_annotations, CAST(max(coalesce(n, 0)) AS BIGINT) AS most FROM h FULL OUTER JOIN a ON h.id = a.id""")
def paired_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairing of two sources of annotations: what is on one side alone is counted."""
    h = frames.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("h")).agg(F.count("*").alias("n"))
    a = frames.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"))
    return h.join(a, F.col("h") == F.col("a"), "full_outer").agg(F.count("*").alias("pairs"), n_if("a IS NULL", "only_scores"), n_if("h IS NULL", "only_annotations"), F.max(F.coalesce("n", F.lit(0))).alias("most"))


_META = {"status": "CASE WHEN min(l_linestatus) <> max(l_linestatus) THEN 'P' ELSE min(l_linestatus) END", "cents": "CAST(round(100 * sum(l_extendedprice)) AS BIGINT)", "lines": "count(*)", "first_line": "min(l_linenumber)"}


@query("paired_metadata", f"""WITH h AS (SELECT l_orderkey AS id, {', '.join(f'{e} AS {n}' for n, e in _META.items())} FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey AS id, o_orderstatus AS status, CAST(round(100 * o_totalprice) AS BIGINT) AS cents, NULL AS lines, 1 AS first_line FROM orders)
    SELECT count(*) FILTER (h.id IS NOT NULL AND a.id IS NOT NULL) AS pairs, count(*) FILTER (h.id IS NULL) AS only_annotations, count(*) FILTER (a.id IS NULL) AS only_scores, count(*) FILTER (h.id IS NOT NULL AND a.id IS NOT NULL AND h.status IS DISTINCT FROM a.status) AS status_differs,
    count(*) FILTER (h.id IS NOT NULL AND a.id IS NOT NULL AND h.cents IS DISTINCT FROM a.cents) AS cents_differ, count(*) FILTER (h.id IS NOT NULL AND a.id IS NOT NULL AND h.first_line IS DISTINCT FROM a.first_line) AS first_line_differs FROM h FULL OUTER JOIN a ON h.id = a.id""")
def paired_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources of annotations one to one, and on how many pairs each field of their metadata differs; nulls are equal to nulls."""
    h = frames.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("h")).agg(*[F.expr(_META[n]).alias(f"h_{n}") for n in ("status", "cents", "first_line")])
    a = frames.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_orderstatus").alias("a_status"), F.expr("CAST(round(100 * o_totalprice) AS BIGINT)").alias("a_cents"), F.lit(1).alias("a_first_line"))
    both = "h IS NOT NULL AND a IS NOT NULL"
    rows = h.join(a, F.col("h") == F.col("a"), "full_outer")
    return rows.agg(n_if(both, "pairs"), n_if("h IS NULL", "only_annotations"), n_if("a IS NULL", "only_scores"), *[n_if(f"{both} AND NOT (h_{n} <=> a_{n})", name) for n, name in (("status", "status_differs"), ("cents", "cents_differ"), ("first_line", "first_line_differs"))])


@query("output_metadata", "SELECT n_name AS nation, r_name AS region, count(*) AS outputs, count(DISTINCT c_mktsegment) AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def output_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: frames.table(spark, sf_dir, name)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("outputs"), F.count_distinct("c_mktsegment").alias("segments"))


_SHIPPED = """SELECT l_orderkey AS task_id, l_partkey AS part, l_suppkey AS supplier, l_linenumber AS line, CAST(l_quantity >= 7 AS INTEGER) AS g2, CAST(l_discount < 0.05 AS INTEGER) AS second FROM lineitem WHERE l_linestatus = 'F'"""


@query("aligned_runs", f"""WITH p AS (SELECT l_orderkey AS task_id, l_partkey AS part, l_suppkey AS supplier, l_linenumber AS line, CAST(l_quantity > 6 AS INTEGER) AS g1, CAST(l_tax < 0.04 AS INTEGER) AS prediction FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')), s AS ({_SHIPPED})
    SELECT count(*) AS rows, count(*) FILTER (g1 IS NOT NULL AND g2 IS NOT NULL AND g1 <> g2) AS drifted, count(*) FILTER (g2 IS NULL) AS only_primary, count(*) FILTER (g1 IS NULL) AS only_secondary, count(*) FILTER (prediction <> second) AS differ FROM p FULL OUTER JOIN s USING (task_id, part, supplier, line)""")
def aligned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over different criteria joined on what names a criterion: references that drift, criteria of one run only, verdicts that differ.

    The primary run has the lines of orders with one status, the secondary one the lines that are done; each has its own reference.
    """
    keys = {"task_id": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey", "line": "l_linenumber"}
    lines, whole = frames.table(spark, sf_dir, "lineitem"), frames.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    named = [F.col(c).alias(n) for n, c in keys.items()]
    bit = lambda c, name: F.expr(c).cast("int").alias(name)
    p = lines.join(whole, "l_orderkey", "left_semi").select(*named, bit("l_quantity > 6", "g1"), bit("l_tax < 0.04", "prediction"))
    s = lines.where("l_linestatus = 'F'").select(*named, bit("l_quantity >= 7", "g2"), bit("l_discount < 0.05", "second"))
    rows = p.join(s, list(keys), "full_outer")
    return rows.agg(F.count("*").alias("rows"), n_if("g1 IS NOT NULL AND g2 IS NOT NULL AND g1 <> g2", "drifted"), n_if("g2 IS NULL", "only_primary"), n_if("g1 IS NULL", "only_secondary"), n_if("prediction <> second", "differ"))


@query("reference_drift", """WITH g AS (SELECT l_partkey AS id, count(*) AS runs, count(DISTINCT (l_returnflag, l_linestatus)) AS versions FROM lineitem GROUP BY 1) SELECT versions, count(*) AS criteria, CAST(sum(runs) AS BIGINT) AS runs FROM g GROUP BY 1""")
def reference_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria that several runs report, by the number of different references they report for it; one is sound."""
    rows = frames.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("runs"), F.count_distinct(F.struct("l_returnflag", "l_linestatus")).alias("versions"))
    return rows.groupBy("versions").agg(F.count("*").alias("criteria"), F.sum("runs").alias("runs"))


@query("nine_cells", """, u AS (SELECT d.dataset, CASE WHEN d.dataset < 3 THEN 'all' WHEN d.dataset < 6 THEN 'small' ELSE 'binary' END AS universe, c.* FROM crit c JOIN tasks t ON c.task_id = t.task_id, (SELECT unnest(range(9)) AS dataset) d
    WHERE dataset < 3 OR (dataset < 6 AND k BETWEEN 2 AND 8) OR (dataset >= 6 AND category <> 'N'))
    SELECT CAST(dataset AS INTEGER) AS dataset, universe, count(*) AS criteria, count(DISTINCT task_id) AS tasks, CAST(sum(CASE dataset % 3 WHEN 0 THEN prediction WHEN 1 THEN second ELSE CASE WHEN prediction + second > 0 THEN 1 ELSE 0 END END) AS BIGINT) AS positive FROM u GROUP BY 1, 2""", frame=True)
def nine_cells(frame: DataFrame) -> DataFrame:
    """Three universes by three primaries as one table with the cell as a column.

    Tasks are whole in one row before cells are told apart, so they are counted as rows, not as distinct ids.
    """
    second, small = F.col("secondary")[0], F.col("k").between(2, 8)
    primaries = [F.col("prediction"), second, F.greatest("prediction", second)]
    binary = F.col("category") != "N"
    sums = [F.sum(c).alias(f"p{i}") for i, c in enumerate(primaries)] + [F.sum(F.when(binary, c)).alias(f"b{i}") for i, c in enumerate(primaries)]
    tasks = frame.groupBy("task_id").agg(F.count("*").alias("k"), n_if(binary, "kb"), *sums)
    cell = lambda d, universe, there, n, c: F.struct(F.lit(d).alias("dataset"), F.lit(universe).alias("universe"), there.alias("there"), F.col(n).alias("criteria"), F.col(c).alias("positive"))
    universes = [("all", F.lit(True), "k", "p"), ("small", small, "k", "p"), ("binary", F.col("kb") > 0, "kb", "b")]
    cells = [cell(3 * u + i, name, there, n, f"{c}{i}") for u, (name, there, n, c) in enumerate(universes) for i in range(3)]
    rows = tasks.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").where("there")
    return rows.groupBy("dataset", "universe").agg(F.sum("criteria").alias("criteria"), F.count("*").alias("tasks"), F.sum("positive").cast("long").alias("positive"))


@query("binary_only_frame", " SELECT task_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY slot) - 1 AS INTEGER) AS slot, slot AS old_slot, gold, prediction FROM crit WHERE category <> 'N'", frame=True)
def binary_only_frame(frame: DataFrame) -> DataFrame:
    """Another universe of criteria: one category goes, and slots are numbered anew."""
    slot = F.row_number().over(W.partitionBy("task_id").orderBy("slot")) - 1
    return frame.where("category <> 'N'").withColumn("new", slot).select("task_id", F.col("new").alias("slot"), F.col("slot").alias("old_slot"), "gold", "prediction")


@query("eligible_tasks", " SELECT k, count(*) AS tasks, count(*) FILTER (k BETWEEN 2 AND 8 AND k = kinds) AS eligible FROM (SELECT t.task_id, t.k, count(DISTINCT (category, gold, prediction, slot)) AS kinds FROM tasks t JOIN crit c ON t.task_id = c.task_id GROUP BY 1, 2) GROUP BY 1", frame=True)
def eligible_tasks(frame: DataFrame) -> DataFrame:
    """Tasks of two to eight criteria that are all distinct, by size."""
    rows = frame.groupBy("task_id").agg(F.count("*").alias("k"), F.size(F.array_distinct(F.collect_list(F.struct("category", "gold", "prediction", "slot")))).alias("kinds"))
    return rows.groupBy("k").agg(F.count("*").alias("tasks"), n_if("k BETWEEN 2 AND 8 AND k = kinds", "eligible"))


@query("paired_quality_blocks", """WITH b AS (SELECT lang, source, avg(n_chars) FILTER (quality = 1) AS good, avg(n_chars) FILTER (quality = 0) AS poor, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 0) AS n_poor FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
    SELECT lang, source, n_good, n_poor, round(good, 6) AS good, round(poor, 6) AS poor, round(good - poor, 6) AS gap FROM b""")
def paired_quality_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their quality tiers side by side, and the gap between the tiers."""
    rows = frames.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(frames.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    wide = rows.groupBy("lang", "source").pivot("quality", [0, 1]).agg(F.count("doc_id").alias("n"), F.avg("n_chars").alias("mean"))
    r = lambda c: F.round(c, 6)
    return wide.select("lang", "source", F.coalesce("1_n", F.lit(0)).alias("n_good"), F.coalesce("0_n", F.lit(0)).alias("n_poor"), r("1_mean").alias("good"), r("0_mean").alias("poor"), r(F.col("1_mean") - F.col("0_mean")).alias("gap"))


@query("jobs_with_attempts", "SELECT o_orderstatus AS state, count(DISTINCT o_orderkey) AS jobs, count(*) AS attempts, CAST(max(l_linenumber) AS BIGINT) AS most FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def jobs_with_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, attempts = frames.table(spark, sf_dir, "orders"), frames.table(spark, sf_dir, "lineitem")
    per = attempts.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("most"))
    return jobs.join(per, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderstatus").alias("state")).agg(F.count_distinct("o_orderkey").alias("jobs"), F.sum("n").alias("attempts"), F.max("most").cast("long").alias("most"))


@query("known_jobs", "SELECT count(*) AS lines, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS jobs FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def known_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of ids as a semi-join, which needs no list on the driver."""
    wanted = frames.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return frames.table(spark, sf_dir, "lineitem").join(wanted, "l_orderkey", "left_semi").agg(F.count("*").alias("lines"), F.count_distinct("l_orderkey").alias("jobs"))


@query("first_seen_order", " SELECT base_id, min(task_id) AS first_task, count(DISTINCT task_id) AS tasks FROM crit GROUP BY 1", frame=True)
def first_seen_order(frame: DataFrame) -> DataFrame:
    """Distinct families with where each was first seen, which is what puts them in order."""
    return frame.groupBy("base_id").agg(F.min("task_id").alias("first_task"), F.count_distinct("task_id").alias("tasks"))


# ---------------------------------------------------------------- records and rendering

_RECORD = "{'id': conv_id, 'turn': turn, 'role': role, 'text': text}"


@query("field_dropping_scan", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, role FROM conversations")
def field_dropping_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records parsed by a schema that leaves a field out: what it held is never there to be read."""
    lines = frames.table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("line"))
    return lines.select(F.from_json("line", "conv_id long, turn long, role string").alias("r")).select("r.*")


@query("wrapped_outputs", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN turn % 2 = 0 THEN 'plain' ELSE 'nested' END AS form, length(text) AS chars FROM conversations WHERE text IS NOT NULL")
def wrapped_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output stands under its name, or in an object under that name: whichever is there is taken."""
    rows = frames.table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    plain = F.to_json(F.struct("conv_id", "turn", F.col("text").alias("prediction")))
    nested = F.to_json(F.struct("conv_id", "turn", F.struct(F.col("text").alias("value")).alias("prediction")))
    lines = rows.select(F.when(F.col("turn") % 2 == 0, plain).otherwise(nested).alias("line"))
    got = lambda p: F.get_json_object("line", p)
    inner = got("$.prediction.value")
    return lines.select(got("$.conv_id").cast("long").alias("conv_id"), got("$.turn").cast("long").alias("turn"), F.when(inner.isNotNull(), "nested").otherwise("plain").alias("form"), F.length(F.coalesce(inner, got("$.prediction"))).alias("chars"))


@query("score_records", """SELECT CAST(doc_id AS VARCHAR) AS prompt, key, CASE WHEN score IS NULL THEN 'missing' WHEN score NOT IN (0, 1) THEN 'invalid' ELSE 'ok' END AS status, coalesce(score, -1) AS score FROM (SELECT doc_id, unnest(['quality', 'toxic']) AS key, unnest([quality, toxic]) AS score FROM labels)""")
def score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of a prompt, a map, as rows with a status each."""
    rows = frames.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("prompt"), F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("key", "score"))
    return rows.select("prompt", "key", F.when(F.col("score").isNull(), "missing").when(~F.col("score").isin(0, 1), "invalid").otherwise("ok").alias("status"), F.coalesce("score", F.lit(-1)).alias("score"))


@query("response_records", "SELECT conv_id AS id, CAST(length(coalesce(text, '')) AS BIGINT) AS tokens, CASE WHEN role = 'user' THEN 'STOP' ELSE 'MAX_TOKENS' END AS finish FROM conversations")
def response_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses whose fields are spelled in one of two ways, as one record."""
    rows = frames.table(spark, sf_dir, "conversations").withColumns({"n": F.length(F.coalesce("text", F.lit(""))), "why": F.when(F.col("role") == "user", "STOP").otherwise("MAX_TOKENS")})
    line = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("conv_id", F.col("n").alias("tokenCount"), F.col("why").alias("finishReason")))).otherwise(F.to_json(F.struct("conv_id", F.col("n").alias("token_count"), F.col("why").alias("finish_reason"))))
    r = F.from_json(line, "conv_id long, tokenCount long, token_count long, finishReason string, finish_reason string")
    return rows.select(r.alias("r")).select(F.col("r.conv_id").alias("id"), F.coalesce("r.tokenCount", "r.token_count").alias("tokens"), F.coalesce("r.finishReason", "r.finish_reason").alias("finish"))


@query("strict_judgements", """WITH j AS (SELECT doc_id, CASE WHEN quality = 1 THEN '{"verdict": true}' WHEN toxic = 1 THEN 'NO: toxic' WHEN quality = 0 THEN ' {"verdict": false} ' ELSE 'maybe' END AS said FROM labels)
    SELECT doc_id, CASE WHEN regexp_matches(said, '^\\s*\\{"verdict": true\\}\\s*$') OR regexp_matches(said, '^YES\\b') THEN 1 WHEN regexp_matches(said, '^\\s*\\{"verdict": false\\}\\s*$') OR regexp_matches(said, '^NO\\b') THEN 0 ELSE -1 END AS verdict FROM j""")
def strict_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judgement is a JSON object or a leading word; all else is none."""
    said = F.when(F.col("quality") == 1, '{"verdict": true}').when(F.col("toxic") == 1, "NO: toxic").when(F.col("quality") == 0, ' {"verdict": false} ').otherwise("maybe")
    rows = frames.table(spark, sf_dir, "labels").select("doc_id", said.alias("said"))
    parsed = F.from_json(F.trim("said"), "verdict boolean")["verdict"].cast("int")
    word = F.when(F.col("said").rlike(r"^YES\b"), 1).when(F.col("said").rlike(r"^NO\b"), 0)
    return rows.select("doc_id", F.coalesce(parsed, word, F.lit(-1)).alias("verdict"))


@query("rendered_prompts", "SELECT item_id, sha256('Rate the text.\nItem: ' || item_id || '\n' || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars FROM benchmark")
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.format_string("Rate the text.\nItem: %s\n%s", F.col("item_id").cast("string"), F.coalesce("text", F.lit("")))
    return frames.table(spark, sf_dir, "benchmark").select("item_id", F.sha2(prompt, 256).alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))


@query("canonical_json", """SELECT n_nationkey AS id, '{"id":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}' AS line FROM nation""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in order and no spaces, so that equal records are equal bytes."""
    rows = frames.table(spark, sf_dir, "nation")
    return rows.select(F.col("n_nationkey").alias("id"), F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("line"))


# ---------------------------------------------------------------- recomputation

@query("label_recomputation", """SELECT lang, count(*) AS labels, count(*) FILTER (n_chars = length(text)) AS confirmed, count(*) FILTER (n_chars IS DISTINCT FROM length(text)) AS changed FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def label_recomputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated labels are worked out again from the text that they came with, and held against what was stored."""
    rows = frames.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.length("text").alias("again")).join(frames.table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("labels"), n_if("n_chars = again", "confirmed"), n_if("NOT (n_chars <=> again)", "changed"))


@query("cost_cohorts", f""", b AS (SELECT base_id, row_number() OVER (ORDER BY sha256('cohort|1|' || base_id), base_id) AS r FROM (SELECT DISTINCT base_id FROM crit)), n AS (SELECT count(*) AS bases FROM b)
    SELECT CASE WHEN r <= floor(0.1 * bases) THEN 'first' WHEN r <= floor(0.3 * bases) THEN 'second' ELSE 'rest' END AS cohort, count(DISTINCT b.base_id) AS clusters, count(*) AS criteria FROM crit c JOIN b ON c.base_id = b.base_id, n GROUP BY 1""", frame=True)
def cost_cohorts(frame: DataFrame) -> DataFrame:
    """Nested cohorts of whole families by salted hash, and what they would cost."""
    bases = frame.groupBy("base_id").agg(F.count("*").alias("n")).withColumn("key", ranking.priority("cohort", 1, "base_id"))
    total = bases.agg(F.count("*").alias("bases"))
    ranked = ranking.global_offset(bases, ranking.by_hash(bases, "key"), ["key", "base_id"]).crossJoin(F.broadcast(total))  # one row
    cohort = F.when(F.col("offset") < F.floor(0.1 * F.col("bases")), "first").when(F.col("offset") < F.floor(0.3 * F.col("bases")), "second").otherwise("rest")
    return ranked.groupBy(cohort.alias("cohort")).agg(F.count("*").alias("clusters"), F.sum("n").alias("criteria"))


# ---------------------------------------------------------------- groups along an order

_RUNS = """, o AS (SELECT t.task_id, row_number() OVER (ORDER BY t.task_id) AS r, flags FROM tasks t JOIN (SELECT task_id, count(*) FILTER (second <> prediction) AS flags FROM crit GROUP BY 1) f ON t.task_id = f.task_id),
    g AS (SELECT *, sum(CASE WHEN flags > 0 THEN 1 ELSE 0 END) OVER (ORDER BY r) - 1 AS group_id, coalesce(sum(flags) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM o)"""


def _groups(frame: DataFrame) -> DataFrame:
    """(task_id, flags, group_id, start): tasks with a flag numbered in release order, with the flags before each."""
    tasks = frame.groupBy("task_id").agg(F.count_if(ranking.flagged()).alias("flags"))
    rows = ranking.global_offset(tasks, ranking.by_number("task_id"), ["task_id"], (F.col("flags") > 0).cast("long"), "before")
    return ranking.global_offset(rows, ranking.by_number("task_id"), ["task_id"], F.col("flags"), "start")


@query("flagged_group_ids", f"{_RUNS} SELECT task_id, CAST(group_id AS BIGINT) AS group_id FROM g WHERE flags > 0", frame=True)
def flagged_group_ids(frame: DataFrame) -> DataFrame:
    return _groups(frame).where("flags > 0").select("task_id", F.col("before").alias("group_id"))


@query("active_group_at_cap", f"{_RUNS}, n AS (SELECT sum(flags) AS total FROM g), c AS (SELECT s AS share, floor(s * total / 100) AS cap FROM n, (SELECT unnest([0, 10, 25, 50, 75, 99]) AS s)) SELECT share, CAST(cap AS BIGINT) AS cap, task_id FROM c JOIN g ON start <= cap AND cap < start + flags", frame=True)
def active_group_at_cap(frame: DataFrame) -> DataFrame:
    """Which task's flagged criteria are being asked at a budget: the one whose range of queries holds it. Budgets are a few rows."""
    rows = _groups(frame).where("flags > 0")
    total = rows.agg(F.sum("flags").alias("total")).select(F.explode(F.array(*[F.lit(s) for s in (0, 10, 25, 50, 75, 99)])).alias("share"), "total")
    caps = total.select("share", F.floor(F.col("share") * F.col("total") / 100).alias("cap"))
    return rows.join(F.broadcast(caps), (F.col("start") <= F.col("cap")) & (F.col("cap") < F.col("start") + F.col("flags"))).select("share", "cap", "task_id")


# ---------------------------------------------------------------- stratified inference

_Z = 1.959963984540054
_STRAT = """, k AS (SELECT prediction, category, gold, sha256('infer|1|' || task_id || '|' || slot) < '2' AS drawn FROM crit), h AS (SELECT prediction, category, count(*) AS size, count(*) FILTER (drawn) AS n, count(*) FILTER (drawn AND gold = prediction) AS a FROM k GROUP BY 1, 2)"""


def _strata(frame: DataFrame) -> DataFrame:
    drawn = ranking.priority("infer", 1, "task_id", "slot") < "2"
    rows = frame.withColumn("drawn", drawn)
    return rows.groupBy("prediction", "category").agg(F.count("*").alias("size"), n_if("drawn", "n"), n_if("drawn AND gold = prediction", "a"))


@query("stratified_estimate", f"""{_STRAT}, e AS (SELECT sum(size * a / n) / sum(size) AS est, CASE WHEN min(n) >= 2 THEN sqrt(sum(size * size * (1 - n / size) * (a / n) * (1 - a / n) / (n - 1))) / sum(size) END AS se FROM h)
    SELECT round(est, 9) AS estimate, round(est - {_Z} * se, 9) AS low, round(est + {_Z} * se, 9) AS high FROM e""", frame=True)
def stratified_estimate(frame: DataFrame) -> DataFrame:
    """Agreement over strata of prediction and category from a hashed sample, with a normal interval; null where a stratum has under two."""
    big, n, p = F.col("size"), F.col("n"), F.col("a") / F.col("n")
    h = _strata(frame).agg(
        (F.sum(big * p) / F.sum(big)).alias("est"), F.when(F.min(n) >= 2, F.sqrt(F.sum(big * big * (1 - n / big) * p * (1 - p) / (n - 1))) / F.sum(big)).alias("se")
    )
    return h.select(_r("est").alias("estimate"), _r(F.col("est") - _Z * F.col("se")).alias("low"), _r(F.col("est") + _Z * F.col("se")).alias("high"))


@query("stratified_intervals", None, frame=True)
def stratified_intervals(frame: DataFrame) -> DataFrame:
    """Exact bounds of each stratum's agreement at a level of 0.05 shared out over the strata; they hold together."""
    h = _strata(frame).select("prediction", "category", F.col("size").alias("population"), F.col("n").alias("drawn"), F.col("a").alias("seen"))
    return estimation.with_intervals(h, "0.0083333333333")


@query("replicate_variance", """, b AS (SELECT base_id, count(*) AS n, count(*) FILTER (gold = prediction) AS a FROM crit GROUP BY 1), r AS (SELECT unnest(range(1, 33)) AS rep),
    x AS (SELECT rep, sum(a) / sum(n) AS v FROM b, r WHERE sha256('rep|' || rep || '|' || base_id) < '4' GROUP BY 1) SELECT count(*) AS replicates, round(avg(v), 9) AS mean, round(stddev_samp(v) / sqrt(count(*)), 9) AS mcse, round(stddev_samp(v) / avg(v), 9) AS cv FROM x""", frame=True)
def replicate_variance(frame: DataFrame) -> DataFrame:
    """Agreement in 32 hashed quarters of the families: mean, Monte Carlo error, coefficient of variation."""
    b = frame.groupBy("base_id").agg(F.count("*").alias("n"), n_if("gold = prediction", "a")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(32))))
    x = b.where(F.sha2(F.concat_ws("|", F.lit("rep"), "rep", "base_id"), 256) < "4").groupBy("rep").agg((F.sum("a") / F.sum("n")).alias("v"))
    return x.agg(F.count("*").alias("replicates"), _r(F.avg("v")).alias("mean"), _r(F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("mcse"), _r(F.stddev_samp("v") / F.avg("v")).alias("cv"))


@query("stratified_coverage", f"""{_STRAT}, t AS (SELECT prediction, category, CASE WHEN n < 2 THEN NULL WHEN abs(a / n - (SELECT avg(CASE WHEN gold = k.prediction THEN 1.0 ELSE 0.0 END) FROM k WHERE k.prediction = h.prediction AND k.category = h.category)) <= {_Z} * sqrt((1 - n / size) * (a / n) * (1 - a / n) / (n - 1)) THEN 1.0 ELSE 0.0 END AS covered FROM h)
    SELECT prediction, count(*) AS strata, count(covered) AS judged, round(avg(covered), 9) AS coverage FROM t GROUP BY 1""", frame=True)
def stratified_coverage(frame: DataFrame) -> DataFrame:
    """How many strata's normal intervals hold the truth; a stratum with under two draws is not judged and doesn't count in the mean."""
    truth = frame.groupBy("prediction", "category").agg(F.avg((F.col("gold") == F.col("prediction")).cast("double")).alias("truth"))
    n, p = F.col("n"), F.col("a") / F.col("n")
    half = _Z * F.sqrt((1 - n / F.col("size")) * p * (1 - p) / (n - 1))
    rows = _strata(frame).join(F.broadcast(truth), ["prediction", "category"]).withColumn("covered", F.when(n >= 2, (F.abs(p - F.col("truth")) <= half).cast("double")))  # a row for each stratum
    return rows.groupBy("prediction").agg(F.count("*").alias("strata"), F.count("covered").alias("judged"), _r(F.avg("covered")).alias("coverage"))


# ---------------------------------------------------------------- forecasts and decisions


@query("decision_states", f"""{estimation._SPLIT}{estimation._UNITS}{estimation._POOLS}{estimation._LADDER}{estimation._FRAME_CAPS}{estimation._MARGIN}{estimation._OBSERVED}, d AS (SELECT f.producer, forecast, observed, CASE WHEN forecast > 1 + 1e-12 THEN 'eager' WHEN forecast < -1 - 1e-12 THEN 'gate' ELSE 'either' END AS said,
    CASE WHEN observed > 1 + 1e-12 THEN 'eager' WHEN observed < -1 - 1e-12 THEN 'gate' ELSE 'either' END AS was FROM forecast f JOIN observed o ON f.producer = o.producer) SELECT said, was, count(*) AS producers, count(*) FILTER (sign(forecast) * sign(observed) < 0 AND abs(forecast) > 1e-12) AS wrong_sign FROM d GROUP BY 1, 2""", frame=True)
def decision_states(frame: DataFrame) -> DataFrame:
    """What a forecast would decide, with a margin of one in a hundred, against what the outcome would; and where signs are opposite."""
    state = lambda c: F.when(F.col(c) > 1 + 1e-12, "eager").when(F.col(c) < -1 - 1e-12, "gate").otherwise("either")
    both = estimation.margin_forecast(frame).join(estimation.exact_outcomes(frame), "producer")
    return both.groupBy(state("forecast").alias("said"), state("observed").alias("was")).agg(F.count("*").alias("producers"), n_if("sign(forecast) * sign(observed) < 0 AND abs(forecast) > 1e-12", "wrong_sign"))


_POOLED = """, pl AS (SELECT producer, count(*) AS n, avg(CASE WHEN gf = 0 THEN 1.0 ELSE 0.0 END) AS rate FROM units WHERE pilot GROUP BY 1), al AS (SELECT avg(CASE WHEN gf = 0 THEN 1.0 ELSE 0.0 END) AS rate, avg(CASE WHEN pf = 0 THEN 1.0 ELSE 0.0 END) AS judged FROM units WHERE pilot),
    tg AS (SELECT producer, avg(CASE WHEN gf = 0 THEN 1.0 ELSE 0.0 END) AS truth, avg(CASE WHEN pf = 0 THEN 1.0 ELSE 0.0 END) AS raw FROM units WHERE NOT pilot GROUP BY 1),
    pr AS (SELECT t.producer, truth, unnest(['raw', 'own', 'pooled', 'shifted']) AS predictor, unnest([raw, p.rate, a.rate, raw + a.rate - a.judged]) AS forecast FROM tg t LEFT JOIN pl p ON t.producer = p.producer, al a)"""


@query("pass_rate_predictors", f"""{estimation._SPLIT}{estimation._UNITS}{_POOLED} SELECT predictor, count(forecast) AS producers, round(avg(abs(forecast - truth)), 9) AS mae, round(avg(forecast - truth), 9) AS bias FROM pr GROUP BY 1""", frame=True)
def pass_rate_predictors(frame: DataFrame) -> DataFrame:
    """Four predictors of a producer's pass rate from the pilot: the raw judge's, the producer's own, all producers', and the judge's shifted."""
    g, p = (F.col("gf") == 0).cast("double"), (F.col("pf") == 0).cast("double")
    u = estimation.units(frame)
    own = u.where("pilot").groupBy("producer").agg(F.avg(g).alias("own"))
    every = u.where("pilot").agg(F.avg(g).alias("pooled"), F.avg(p).alias("judged"))
    rows = u.where("NOT pilot").groupBy("producer").agg(F.avg(g).alias("truth"), F.avg(p).alias("raw")).join(own, "producer", "left").crossJoin(F.broadcast(every))  # one row
    rows = rows.withColumn("shifted", F.col("raw") + F.col("pooled") - F.col("judged"))
    long = rows.select("truth", F.explode(F.create_map(*[x for c in ("raw", "own", "pooled", "shifted") for x in (F.lit(c), F.col(c))])).alias("predictor", "forecast"))
    off = F.col("forecast") - F.col("truth")
    return long.groupBy("predictor").agg(F.count("forecast").alias("producers"), _r(F.avg(F.abs(off))).alias("mae"), _r(F.avg(off)).alias("bias"))


# ---------------------------------------------------------------- disclosure

GROUPS = 6  # prediction by category A, N, R
_GROUP = "CAST(prediction * 3 + list_position(['A', 'N', 'R'], category) - 1 AS INTEGER)"
_SHOWN = "sha256('show|1|' || task_id) < '{}'"
#: Shares of the tasks that are shown, in sixteenths, as the hex digit their hashes stay below.
RELEASES = (("0", 0), ("4", 25), ("8", 50), ("c", 75))


def _open(frame: DataFrame) -> DataFrame:
    """Each release's share, and for every task the mask of the groups it has slots in, whether it is shown, and its outcome."""
    group = (F.col("prediction") * 3 + F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("category")).cast("int") - 1).alias("g")
    rows = frame.select("task_id", "gold", group)
    key = ranking.priority("show", 1, "task_id")
    tasks = rows.groupBy("task_id").agg(F.count("*").alias("k"), F.min("gold").alias("passes"), F.bit_or(F.expr("shiftleft(1, g)")).alias("mask"), *[n_if(f"g = {g} AND gold = 0", f"z{g}") for g in range(GROUPS)])
    tasks = tasks.withColumn("key", key)
    share = F.explode(F.array(*[F.struct(F.lit(h).alias("digit"), F.lit(s).alias("share")) for h, s in RELEASES])).alias("r")
    return tasks.select("*", share).select("*", F.col("r.share").alias("share"), (F.col("key") < F.col("r.digit")).alias("shown"))


def _least(parts: str, pieces: str) -> str:
    return f"""{pieces} u AS (SELECT task_id, k, gold, {_GROUP} AS g FROM z), w AS (SELECT task_id, k, min(gold) AS passes, CAST(bit_or(1 << g) AS INTEGER) AS mask, {', '.join(f'count(*) FILTER (g = {g} AND gold = 0) AS z{g}' for g in range(GROUPS))} FROM u GROUP BY 1, 2),
    s AS (SELECT w.*, share, sha256('show|1|' || task_id) < digit AS shown FROM w, (SELECT unnest(['0', '4', '8', 'c']) AS digit, unnest([0, 25, 50, 75]) AS share)),
    a AS (SELECT CAST(x AS INTEGER) AS sub, {parts} FROM (SELECT unnest(range(64)) AS x)),
    q AS (SELECT s.share, k, count(*) FILTER (NOT shown) AS n, count(*) FILTER (shown AND passes = 1) AS fixed, {', '.join(f'sum(CASE WHEN shown THEN 0 ELSE z{g} END) AS z{g}' for g in range(GROUPS))} FROM s GROUP BY 1, 2),
    m AS (SELECT share, k, mask, count(*) AS c FROM s WHERE NOT shown GROUP BY 1, 2, 3), hit AS (SELECT share, k, sub, sum(c) AS c FROM m JOIN a ON mask & sub <> 0 GROUP BY 1, 2, 3)"""


_D1 = _least("1 AS one", ", z AS (SELECT c.*, k FROM crit c JOIN tasks t ON c.task_id = t.task_id),")
_OUTSIDE = " + ".join(f"CASE WHEN (a.sub & {1 << g}) = 0 THEN z{g} ELSE 0 END" for g in range(GROUPS))


@query("disclosure_ladder", f"""{_D1}, b AS (SELECT q.share, q.k, n, fixed, min({_OUTSIDE} + coalesce(hit.c, 0)) AS placed FROM q CROSS JOIN a LEFT JOIN hit ON hit.share = q.share AND hit.k = q.k AND hit.sub = a.sub GROUP BY ALL)
    SELECT share, CAST(sum(n) AS BIGINT) AS open, CAST(sum(fixed) AS BIGINT) AS shown_passes, CAST(sum(fixed + n - least(placed, n)) AS BIGINT) AS least_passes FROM b GROUP BY 1""", frame=True)
def disclosure_ladder(frame: DataFrame) -> DataFrame:
    """Fewest tasks that can pass, given totals by size, predicted bit and category, as more and more whole tasks are shown.

    The failures of the groups spread over as many hidden tasks as they can, which by the deficiency form of Hall's theorem is the least,
    over all 64 subsets of the six groups, of the failures outside plus the hidden tasks with a slot inside. Tasks come in at most 64
    masks a size, so subsets meet a small table.
    """
    return bounds_d1(frame).groupBy("share").agg(F.sum("n").alias("open"), F.sum("fixed").alias("shown_passes"), F.sum(F.col("fixed") + F.col("n") - F.least("placed", "n")).alias("least_passes"))


def bounds_d1(frame: DataFrame) -> DataFrame:
    """(share, k, n hidden tasks, fixed passes, placed: the most hidden tasks that failures can reach)."""
    s = _open(frame)
    hidden = F.col("shown") == F.lit(False)
    by_mask = s.groupBy("share", "k", "mask").agg(F.count_if(hidden).alias("c"), F.count_if(F.col("shown") & (F.col("passes") == 1)).alias("fixed"), *[F.sum(F.when(hidden, F.col(f"z{g}")).otherwise(0)).alias(f"z{g}") for g in range(GROUPS)])
    subsets = by_mask.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("sub"))
    both = subsets.groupBy("share", "k", "sub").agg(F.sum("c").alias("n"), F.sum("fixed").alias("fixed"), F.sum(F.when(F.col("mask").bitwiseAND(F.col("sub")) != 0, F.col("c")).otherwise(0)).alias("hit"), *[F.sum(f"z{g}").alias(f"z{g}") for g in range(GROUPS)])
    outside = sum((F.when(F.col("sub").bitwiseAND(1 << g) == 0, F.col(f"z{g}")).otherwise(0) for g in range(GROUPS)), F.lit(0))
    return both.groupBy("share", "k").agg(F.first("n").alias("n"), F.first("fixed").alias("fixed"), F.min(outside + F.col("hit")).alias("placed"))


@query("bounds_d1_min", f"""{_D1}, b AS (SELECT q.share, q.k, n, min({_OUTSIDE} + coalesce(hit.c, 0)) AS placed FROM q CROSS JOIN a LEFT JOIN hit ON hit.share = q.share AND hit.k = q.k AND hit.sub = a.sub WHERE q.share = 0 GROUP BY ALL) SELECT k, n AS tasks, CAST(n - least(placed, n) AS BIGINT) AS least_passes FROM b""", frame=True)
def bounds_d1_min(frame: DataFrame) -> DataFrame:
    return bounds_d1(frame).where("share = 0").select("k", F.col("n").alias("tasks"), (F.col("n") - F.least("placed", "n")).alias("least_passes"))


@query("bounds_d1_max", f""", z AS (SELECT c.task_id, k, gold, {_GROUP} AS g FROM crit c JOIN tasks t ON c.task_id = t.task_id), gs AS (SELECT k, g, CAST(sum(gold) AS BIGINT) AS s FROM z GROUP BY 1, 2),
    tc AS (SELECT t.task_id, t.k, gs.g, gs.s, count(z.g) AS c FROM tasks t JOIN gs ON t.k = gs.k LEFT JOIN z ON z.task_id = t.task_id AND z.g = gs.g GROUP BY ALL), hs AS (SELECT k, g, s, c, count(*) AS n FROM tc GROUP BY ALL),
    pr AS (SELECT *, coalesce(sum(c * n) OVER (PARTITION BY k, g ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hs)
    SELECT k, CAST(min(fit) AS BIGINT) AS most_passes FROM (SELECT k, g, sum(CASE WHEN c = 0 THEN n ELSE greatest(0, least(n, floor((s - before) / c))) END) AS fit FROM pr GROUP BY 1, 2) GROUP BY 1""", frame=True)
def bounds_d1_max(frame: DataFrame) -> DataFrame:
    """A bound from above on the tasks that can pass given totals by size, predicted bit and category.

    Each group alone has room for so many tasks, the ones with the fewest slots in it first; no set of passing tasks is larger than the
    least of these. It may not be reached: the exact number is a knapsack with a dimension for each group.
    """
    group = F.col("prediction") * 3 + F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("category")).cast("int") - 1
    per = frame.withColumn("g", group).groupBy("task_id").agg(F.count("*").alias("k"), *[n_if(f"g = {g}", f"c{g}") for g in range(GROUPS)], *[F.sum(F.when(F.col("g") == g, F.col("gold")).otherwise(0)).alias(f"s{g}") for g in range(GROUPS)])
    long = per.select("k", F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(f"c{g}").alias("c"), F.col(f"s{g}").alias("s")) for g in range(GROUPS)])).alias("x")).select("k", "x.*")
    hist = long.groupBy("k", "g", "c").agg(F.count("*").alias("n"), F.sum("s").alias("s"))
    by = W.partitionBy("k", "g")  # at most k + 1 rows each
    rows = hist.withColumns({"total": F.sum("s").over(by), "slots": F.sum(F.col("c") * F.col("n")).over(by), "before": F.coalesce(F.sum(F.col("c") * F.col("n")).over(by.orderBy("c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))}).where("slots > 0")
    fit = F.when(F.col("c") == 0, F.col("n")).otherwise(F.greatest(F.lit(0), F.least("n", F.floor((F.col("total") - F.col("before")) / F.col("c")))))
    return rows.groupBy("k", "g").agg(F.sum(fit).alias("fit")).groupBy("k").agg(F.min("fit").cast("long").alias("most_passes"))


@query("disclosure_orders", """, o AS (SELECT t.*, ord, row_number() OVER (PARTITION BY ord ORDER BY sha256('shown|' || ord || '|' || task_id), task_id) AS r, count(*) OVER (PARTITION BY ord) AS N FROM tasks t, (SELECT unnest(range(1, 11)) AS ord)),
    p AS (SELECT ord, share, max(N) AS N, count(*) FILTER (r <= floor(share * N / 100)) AS shown, count(*) FILTER (r <= floor(share * N / 100) AND (gf = 0) <> (pf = 0)) AS identified FROM o, (SELECT unnest([10, 25, 50, 75]) AS share) GROUP BY 1, 2)
    SELECT share, round(avg(1 - shown / N), 9) AS mean_width, round(avg(identified), 9) AS mean_identified, min(identified) AS least, max(identified) AS most FROM p GROUP BY 1""", frame=True)
def disclosure_orders(frame: DataFrame) -> DataFrame:
    """Nested beginnings of ten random orders of the tasks: how wide the range of pass rates stays, and how many wrong verdicts show."""
    t = accounting.tasks(frame).select("task_id", ((F.col("gf") == 0) != (F.col("pf") == 0)).cast("int").alias("wrong"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("ord"))
    t = t.withColumn("key", F.sha2(F.concat_ws("|", F.lit("shown"), "ord", "task_id"), 256))
    ranked = ranking.global_offset(t, ranking.by_hash(frame, "key"), ["key", "task_id"], within=("ord",))
    total = accounting.tasks(frame).agg(F.count("*").alias("N"))
    shares = total.select("N", F.explode(F.array(*[F.lit(s) for s in (10, 25, 50, 75)])).alias("share"))
    rows = ranked.crossJoin(F.broadcast(shares)).where(F.col("offset") < F.floor(F.col("share") * F.col("N") / 100))  # four rows
    per = rows.groupBy("ord", "share").agg(F.max("N").alias("N"), F.count("*").alias("shown"), F.sum("wrong").alias("identified"))
    return per.groupBy("share").agg(_r(F.avg(1 - F.col("shown") / F.col("N"))).alias("mean_width"), _r(F.avg("identified")).alias("mean_identified"), F.min("identified").alias("least"), F.max("identified").alias("most"))
