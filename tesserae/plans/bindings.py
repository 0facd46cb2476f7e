"""Queries on record files, masked scans, staged storage, content digests and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import binding, ranking
from tesserae.operators.storage import new_folder, stored
from tesserae.sources import frames, records
from tesserae.sources.frames import ORDERS_SQL, TASKS_SQL

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _as_lines(rows: DataFrame, name: str) -> str:
    """The rows as JSON Lines files; nulls are written as such."""
    path = new_folder(rows.sparkSession, name)
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return path


@query("indexed_records", "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, sha256(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def indexed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents, read one by one from record files of all documents by an index of byte ranges; each has its hash."""
    path = _as_lines(frames.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", "text"), "record-lines")
    known = records.unique(stored(records.index(spark, path, "id"), "record-index"))
    found = records.lookup(known, frames.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))
    text = F.get_json_object("line", "$.text")
    return found.select(F.col("id").cast("long").alias("doc_id"), F.length(text).alias("chars"), F.sha2(text, 256).alias("digest"))


_BINARY = "struct<valid_binary: boolean, source_type: string>"


@query("masked_labels", """SELECT doc_id, lang, coalesce(quality IN (0, 1), false) AS quality_valid, CASE WHEN quality IS NULL THEN 'null' ELSE 'integer' END AS quality_type,
    coalesce(toxic IN (0, 1), false) AS toxic_valid, CASE WHEN toxic IS NULL THEN 'null' ELSE 'integer' END AS toxic_type FROM documents JOIN labels USING (doc_id)""")
def masked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels within record files, of which a masked scan tells whether they are bits, and nothing else."""
    rows = frames.table(spark, sf_dir, "documents").select("doc_id", "lang", "text").join(frames.table(spark, sf_dir, "labels"), "doc_id")
    path = _as_lines(rows.select(F.col("doc_id").cast("string").alias("id"), F.struct("lang", F.struct("quality", "toxic").alias("review")).alias("about"), "text"), "label-lines")
    scan = records.masked_scan(spark, path, f"id string, about struct<lang: string, review: struct<quality: {_BINARY}, toxic: {_BINARY}>>", ("quality", "toxic"))
    part = lambda c: [F.col(f"about.review.{c}.valid_binary").alias(f"{c}_valid"), F.col(f"about.review.{c}.source_type").alias(f"{c}_type")]
    return scan.select(F.col("id").cast("long").alias("doc_id"), "about.lang", *part("quality"), *part("toxic"))


@query("masked_event_values", """SELECT event_type, count(*) AS events, count(*) FILTER (value BETWEEN 0 AND 1) AS present, count(*) FILTER (value < 0 OR value > 1) AS invalid, count(*) FILTER (value IS NULL) AS missing FROM events GROUP BY 1""")
def masked_event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of record files become whether they lie in [0, 1] before anything parses them."""
    path = _as_lines(frames.table(spark, sf_dir, "events").select("event_type", "event_id", F.struct("value").alias("measured")), "event-lines")
    scan = records.masked_scan(spark, path, "event_type string, measured struct<value: string>", numbers=True)
    status = F.col("measured.value")
    return scan.groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(status == "present").alias("present"), F.count_if(status == "invalid").alias("invalid"), F.count_if(status.isNull()).alias("missing"))


_STAGE = "CASE WHEN sha256('stage|1|' || base_id) < '4' THEN 'pilot' ELSE 'confirmation' END"


@query("staged_reveal", f"WITH {ORDERS_SQL}, {TASKS_SQL} SELECT {_STAGE} AS stage, count(*) AS criteria, CAST(sum(CASE WHEN {_STAGE} = 'pilot' THEN gold ELSE 0 END) AS BIGINT) AS revealed, count(*) FILTER ({_STAGE} <> 'pilot') AS withheld FROM crit GROUP BY 1")
def staged_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References lie in a folder for each stage; only the pilot's is scanned, which the plan must show by its partition filter."""
    frame = frames.orders_frame(spark, sf_dir)
    stage = F.when(ranking.priority("stage", 1, "base_id") < "4", "pilot").otherwise("confirmation")
    staged = stored(frame.withColumn("stage", stage).select("task_id", "slot", "gold", "stage"), "references")
    path = new_folder(spark, "staged")
    records.write_staged(staged, path)
    known = records.read_staged(spark, path, "task_id long, slot int, gold int", ["pilot"]).drop("stage")
    rows = staged.drop("gold").join(known, ["task_id", "slot"], "left")
    return rows.groupBy("stage").agg(F.count("*").alias("criteria"), F.coalesce(F.sum("gold"), F.lit(0)).cast("long").alias("revealed"), F.count_if(F.col("stage") != "pilot").alias("withheld"))


_BOUND = {"documents": (["doc_id", "lang", "n_chars", "source", "text"], ["doc_id"]), "labels": (["doc_id", "quality", "toxic"], ["doc_id"]), "customer": (["c_custkey", "c_nationkey"], ["c_custkey"])}


def _canonical(columns: list[str]) -> str:
    return " || ".join(f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), 'N')" for c in sorted(columns))


def _root(table: str) -> str:
    columns, keys = _BOUND[table]
    return f"""(WITH r AS (SELECT sha256({_canonical(keys)})[1:4] AS node, sha256({_canonical(columns)}) AS d FROM {table}),
        c AS (SELECT node, d, count(*) AS n FROM r GROUP BY ALL),
        i AS (SELECT node, d[1:4] AS part, sha256(string_agg(d || '*' || n, ',' ORDER BY d || '*' || n)) AS g FROM c GROUP BY 1, 2),
        l AS (SELECT node, sha256(string_agg(part || ':' || g, ',' ORDER BY part)) AS g FROM i GROUP BY 1),
        u AS (SELECT node[1:2] AS node, sha256(string_agg(node || ':' || g, ',' ORDER BY node)) AS g FROM l GROUP BY 1)
        SELECT '{table}' AS "table", (SELECT count(*) FROM {table}) AS n, sha256(string_agg(node || ':' || g, ',' ORDER BY node)) AS digest FROM u)"""


@query("content_digest", " UNION ALL ".join(map(_root, _BOUND)))
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root digests of three tables: the same for any files and partitions that hold their rows."""
    out = None
    for name, (columns, keys) in _BOUND.items():
        tree = binding.tree(frames.table(spark, sf_dir, name).select(*columns), keys)
        part = tree.where("level = 0").select(F.lit(name).alias("table"), F.col("n").cast("long").alias("n"), "digest")
        out = part if out is None else out.unionByName(part)
    return out


_STATUS = "CASE WHEN min(l_linestatus) <> max(l_linestatus) THEN 'P' ELSE min(l_linestatus) END"


def _statuses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order statuses as stored, and as their lines have it."""
    stated = frames.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    lines = frames.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.expr(_STATUS).alias("status"))
    return stated, lines


_SIDES = f"a AS (SELECT o_orderkey AS key, o_orderstatus AS status FROM orders), b AS (SELECT l_orderkey AS key, {_STATUS} AS status FROM lineitem GROUP BY 1)"


@query("content_differences", f"WITH {_SIDES} SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'missing' WHEN a.key IS NULL THEN 'added' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.status IS DISTINCT FROM b.status")
def content_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose stored status differs from that of their lines, found by going down both digest trees."""
    return binding.differences(*_statuses(spark, sf_dir), ["key"])


@query("positional_differences", f"""WITH {_SIDES}, x AS (SELECT row_number() OVER (ORDER BY key) - 1 AS pos, key || '|' || status AS line FROM a), y AS (SELECT row_number() OVER (ORDER BY key) - 1 AS pos, key || '|' || status AS line FROM b),
    gx AS (SELECT pos, line IN (SELECT line FROM y) AS met, coalesce(sum(CAST(line IN (SELECT line FROM y) AS INTEGER)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM x),
    gy AS (SELECT pos, line IN (SELECT line FROM x) AS met, coalesce(sum(CAST(line IN (SELECT line FROM x) AS INTEGER)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM y),
    ux AS (SELECT gap, row_number() OVER (PARTITION BY gap ORDER BY pos) AS at, pos FROM gx WHERE NOT met), uy AS (SELECT gap, row_number() OVER (PARTITION BY gap ORDER BY pos) AS at, pos FROM gy WHERE NOT met)
    SELECT CASE WHEN uy.pos IS NULL THEN 'missing' WHEN ux.pos IS NULL THEN 'inserted' ELSE 'changed' END AS state, coalesce(ux.pos, -1) AS left_pos, coalesce(uy.pos, -1) AS right_pos FROM ux FULL JOIN uy ON ux.gap = uy.gap AND ux.at = uy.at""")
def positional_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two lists as text files without keys: lines that are missing, inserted or changed, by their places in the files (-1 for none)."""
    sides = []
    for rows in _statuses(spark, sf_dir):
        path = new_folder(spark, "status-lines")
        rows.orderBy("key").select(F.concat_ws("|", "key", "status").alias("value")).write.text(path)
        read = stored(records.lines(spark, path).select("file", "start", "number", "sha256"), "status-lines-read")
        sides.append(binding.split_positions(read).select("pos", "sha256"))
    return binding.by_position(*sides).na.fill(-1, ["left_pos", "right_pos"])
