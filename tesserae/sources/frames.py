"""Criterion frames: the long table that every evaluation operator works on.

A frame has a row for each criterion: task_id, slot (0.. within the task), base_id (the family that tasks share), producer, category,
gold and prediction (bits), and secondary (an array of further prediction bits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators import ranking

COLUMNS = ["task_id", "slot", "base_id", "producer", "category", "gold", "prediction", "secondary"]
#: By what the lines of an order are numbered.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bits() -> tuple:
    """gold, prediction and the secondary bit of an order's line."""
    gold = (F.col("l_quantity") > 6).cast("int")
    flip = lambda hit: F.when(hit, 1 - gold).otherwise(gold)
    return gold, flip((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 9 == 0), flip((F.col("l_partkey") + F.col("l_suppkey") * 3) % 11 == 0)


def orders_codes(spark: SparkSession, sf_dir: str, categories: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """What sweeps.gathered() takes of the orders frame: task_id, place and code of each line; the orders' ids.

    A place is the line number and, below it, the part, since orders repeat line numbers; values beyond 22 or 37 bits share a place. With
    categories the code is 2 * group + gold, a group being the predicted bit and the category, or 15 where one of these is unknown.
    """
    gold, prediction, second = _bits()
    code = F.when(second != prediction, 4).otherwise(0) + 2 * prediction + gold
    if categories:
        category = F.array_position(F.array(*map(F.lit, categories)), F.col("l_returnflag")) - 1
        code = F.coalesce(F.when(category >= 0, 2 * (prediction * len(categories) + category) + gold), F.lit(15)).cast("int")
    n, part = (F.coalesce(F.col(c).cast("long"), F.lit(1 << 40)) for c in ("l_linenumber", "l_partkey"))
    last, most = (1 << 22) - 1, (1 << 37) - 1
    place = F.when(n < 0, F.lit(-1)).when(n >= last, F.lit(last << 37)).otherwise(n * (1 << 37) + F.greatest(F.lit(0), F.least(part, F.lit(most))))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), place.alias("place"), code.alias("code"), *LINE_ORDER)
    return rows, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"))


def orders_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks, their lines as criteria. Both sides meet on the order key, on which slots are numbered too."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    by_task = W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    gold, prediction, second = _bits()
    rows = lines.select(
        F.col("l_orderkey").alias("task_id"),
        (F.row_number().over(by_task) - 1).alias("slot"),
        F.col("l_returnflag").alias("category"),
        gold.alias("gold"),
        prediction.alias("prediction"),
        F.array(second).alias("secondary"),
    )
    bases = orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("base_id"), F.col("o_orderpriority").alias("producer"))
    return rows.join(bases, "task_id").select(*COLUMNS)


def document_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as criteria of the task source x language: gold is their quality, prediction a rule on their length.

    Tasks are few and large, so slots are ranks within the task by levels of ids, not by a window over the task.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    task = F.concat_ws("/", "source", "lang")
    long = (F.col("n_chars") > 1200).cast("int")
    rows = docs.join(labels, "doc_id").where("quality IS NOT NULL").select("doc_id", task.alias("task_id"), "source", F.col("lang").alias("category"), F.col("quality").alias("gold"), long.alias("prediction"))
    rows = ranking.global_offset(rows, ranking.by_number("doc_id"), ["doc_id"], name="slot", within=("task_id",))
    return rows.select("task_id", F.col("slot").cast("int").alias("slot"), F.col("source").alias("base_id"), F.col("category").alias("producer"), "category", "gold", "prediction", F.array("prediction").alias("secondary"))


ORDERS_SQL = """crit AS (SELECT task_id, slot, base_id, producer, category, gold, CASE WHEN fp THEN 1 - gold ELSE gold END AS prediction,
    CASE WHEN fs THEN 1 - gold ELSE gold END AS second FROM (SELECT l_orderkey AS task_id, CAST(row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS slot, o_custkey AS base_id, o_orderpriority AS producer,
    l_returnflag AS category, CAST(l_quantity > 6 AS INTEGER) AS gold, (l_partkey * 7 + l_suppkey) % 9 = 0 AS fp, (l_partkey + 3 * l_suppkey) % 11 = 0 AS fs
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""
DOCUMENTS_SQL = """dcrit AS (SELECT source || '/' || lang AS task_id, CAST(row_number() OVER (PARTITION BY source || '/' || lang ORDER BY doc_id) - 1 AS INTEGER) AS slot,
    source AS base_id, lang AS producer, lang AS category, quality AS gold, CAST(n_chars > 1200 AS INTEGER) AS prediction
    FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"""
TASKS_SQL = """tasks AS (SELECT task_id, min(base_id) AS base_id, min(producer) AS producer, count(*) AS k, sum(1 - gold) AS gf, sum(1 - prediction) AS pf,
    sum((1 - gold) * (1 - prediction)) AS cf FROM crit GROUP BY task_id)"""
