"""Priorities from hashes, and ranks over a whole table without a single-task window.

A global rank is taken by levels: rows are numbered within ordered buckets of bounded size, buckets within coarser ones, and only the
totals of the coarsest, which are few at any size of the table, are summed up in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POLICIES = ("random_criterion", "sc_natural", "sc_random", "sc_judge", "disagreement_only", "disagreement_then_random", "sc_disagreement")
TASK_ORDERS = ("release", "predicted_fail_count", "random")


def priority(purpose: str, seed: int, *ids: str) -> Column:
    """A uniform priority that any engine can recompute: SHA-256 of purpose, seed and ids."""
    return F.sha2(F.concat_ws("|", F.lit(purpose), F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]), 256)


def global_offset(df: DataFrame, levels: list[list[Column]], order: list, weight: Column | None = None, name: str = "offset", within: tuple[str, ...] = ()) -> DataFrame:
    """df with the summed weight (default 1) of all rows before each, by the levels' buckets and then by order.

    levels go from coarse to fine; each is a list of columns that refines the ones before it and is ordered as they are. within: runs
    that are ranked apart.
    """
    weight = F.lit(1).cast("long") if weight is None else weight.cast("long")
    names, columns = [], {}
    for i, level in enumerate(levels):
        names.append([f"_b{i}_{j}" for j in range(len(level))])
        columns |= dict(zip(names[-1], level, strict=True))
    rows = df.withColumns({**columns, "_w": weight})
    so_far = [[*within, *(n for level in names[: i + 1] for n in level)] for i in range(len(levels))]
    sums, base = rows, None
    before = lambda part, by, c: F.coalesce(F.sum(c).over(W.partitionBy(*part).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tables = []
    for keys in reversed(so_far):  # totals of each level, from those of the next finer one
        sums = sums.groupBy(*keys).agg(F.sum("_w").alias("_w"))
        tables.append(sums)
    for i, (keys, table) in enumerate(zip(so_far, reversed(tables), strict=True)):
        above = so_far[i - 1] if i else list(within)
        table = table.withColumn(f"_o{i}", before(above, names[i], "_w")).drop("_w")
        base = table if base is None else table.join(base, above)
    base = base.withColumn("_base", sum((F.col(f"_o{i}") for i in range(1, len(levels))), F.col("_o0"))).drop(*[f"_o{i}" for i in range(len(levels))])
    inside = rows.withColumn("_in", before(so_far[-1], order, "_w"))
    return inside.join(base, so_far[-1]).withColumn(name, F.col("_base") + F.col("_in")).drop(*[n for level in names for n in level], "_w", "_base", "_in")


def cuts(rows: DataFrame, key: str, needs: list[tuple], weight: Column | None = None, within: str | None = None) -> dict:
    """For each need (run, name, number) of a run of rows: name -> the hex key at which weights (default 1), by key, reach the number, and
    how much of that row's weight is within it. ("", 0) for numbers below 1, ("g", 0), past every key, for those above the total.

    Counts of bounded buckets find the bucket; only its rows are ordered. within: the column of runs; rows is read twice, keys differ.
    """
    spark, n = rows.sparkSession, max(4, digits(rows.sparkSession))
    weight = F.lit(1) if weight is None else weight
    rows = rows.select(F.lit(0).alias("run") if within is None else F.col(within).alias("run"), F.col(key).alias("key"), F.substring(key, 1, n).alias("bucket"), weight.cast("long").alias("w"))
    out = {name: ("", 0) if number < 1 else ("g", 0) for _, name, number in needs}
    sums = rows.groupBy("run", "bucket").agg(F.sum("w").alias("w")).withColumn("upto", F.sum("w").over(W.partitionBy("run").orderBy("bucket")))
    inside = (F.col("need") <= F.col("upto")) & (F.col("need") > F.col("upto") - F.col("w"))
    left = (F.col("need") - F.col("upto") + F.col("w")).alias("need")
    asked = spark.createDataFrame([tuple(map(int, x)) for x in needs], "run int, name int, need long")
    hits = sums.join(F.broadcast(asked), "run").where(inside).select("run", "bucket", "name", left).collect()  # a row for each need
    if hits:
        few = F.broadcast(spark.createDataFrame(hits, "run int, bucket string, name int, need long"))
        near = rows.join(F.broadcast(spark.createDataFrame(sorted({(r["run"], r["bucket"]) for r in hits}), "run int, bucket string")), ["run", "bucket"])
        near = near.withColumn("upto", F.sum("w").over(W.partitionBy("run", "bucket").orderBy("key").rowsBetween(W.unboundedPreceding, 0)))
        out |= {r["name"]: (r["key"], r["need"]) for r in near.join(few, ["run", "bucket"]).where(inside).select("name", "key", left).collect()}
    return out


def digits(spark: SparkSession) -> int:
    """Hex digits of a hash that make its buckets: some 16 to 256 for each shuffle partition, an even number."""
    partitions, n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), 2
    while 16**n < 16 * partitions:
        n += 2
    return n


def by_hash(df: DataFrame, column: str, *first: Column) -> list[list[Column]]:
    """Levels for a column of hex digests, below the columns `first` that are ordered before it: half of the digits, then all."""
    n = digits(df.sparkSession)
    return [[*first, F.substring(column, 1, n // 2)], [F.substring(column, n // 2 + 1, n - n // 2)]]


def by_number(column: str, *first: Column) -> list[list[Column]]:
    """Levels for a whole number: 4096 * 4096 values, then 4096. Of 10**12 distinct ones the coarse level has 60,000."""
    return [[*first, F.floor(F.col(column) / (1 << 24))], [F.floor(F.col(column) / (1 << 12))]]


def by_time(column: str) -> list[list[Column]]:
    """Levels for a timestamp: hours, then seconds."""
    return [[F.date_trunc("hour", column)], [F.date_trunc("second", column)]]


def flagged() -> Column:
    """Some secondary bit differs from the prediction; false without secondaries."""
    return F.exists("secondary", lambda x: x != F.col("prediction"))


def task_priority(frame: DataFrame, task_order: str, seed: int) -> tuple[DataFrame, list[list[Column]], list]:
    """A row for each task with what it is ordered by; the levels of buckets and the order."""
    if task_order not in TASK_ORDERS:
        raise ValueError(f"unknown task order {task_order}")
    tasks = frame.groupBy("task_id").agg(F.sum(1 - F.col("prediction")).alias("fail_count")).withColumn("task_key", priority("task", seed, "task_id"))
    if task_order == "release":
        return tasks, by_number("task_id"), ["task_id"]
    if task_order == "random" or seed:
        first = [] if task_order == "random" else ["fail_count"]
        return tasks, by_hash(tasks, "task_key", *map(F.col, first)), [*first, "task_key", "task_id"]
    return tasks, by_number("task_id", F.col("fail_count")), ["fail_count", "task_id"]


def task_order(frame: DataFrame, order: str = "random", seed: int = 1) -> DataFrame:
    """(task_id, task_rank from 0)."""
    tasks, levels, keys = task_priority(frame, order, seed)
    return global_offset(tasks, levels, keys, name="task_rank").select("task_id", "task_rank")


def transcript(frame: DataFrame, policy: str, task_order: str = "random", seed: int = 1) -> DataFrame:
    """The queries of a policy: qnum (from 1), task_id, slot, gold, prediction, category, base_id.

    Policies never read gold but where sc_ policies leave a task at its first revealed failure. Seed 0 breaks ties by slot.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    rows = frame.withColumn("item_key", priority("criterion", seed, "task_id", "slot")).withColumn("flag", flagged())
    out = ["qnum", "task_id", "slot", "gold", "prediction", "category", "base_id"]
    if policy == "random_criterion":
        return global_offset(rows, by_hash(rows, "item_key"), ["item_key"]).withColumn("qnum", F.col("offset") + 1).select(*out)
    tie = "slot" if seed == 0 else "item_key"
    tier = F.when(F.col("flag"), 0).when(F.col("prediction") == 0, 1).otherwise(2)
    within = {"sc_natural": ["slot"], "sc_random": ["item_key", "slot"], "sc_judge": ["prediction", tie, "slot"], "sc_disagreement": [tier, tie, "slot"]}.get(policy, [tie, "slot"])
    asked = rows.where("flag") if policy.startswith("disagreement") else rows
    asked = asked.withColumn("pos", F.row_number().over(W.partitionBy("task_id").orderBy(*within)))
    if policy.startswith("sc_"):
        stop = F.min(F.when(F.col("gold") == 0, F.col("pos"))).over(W.partitionBy("task_id"))
        asked = asked.withColumn("stop", stop).where("stop IS NULL OR pos <= stop")
    tasks, levels, keys = task_priority(frame, task_order, seed)
    sizes = asked.groupBy("task_id").agg(F.count("*").alias("asked"))
    starts = global_offset(tasks.join(sizes, "task_id"), levels, keys, F.col("asked"), "start").select("task_id", "start")
    first = asked.join(starts, "task_id").withColumn("qnum", F.col("start") + F.col("pos")).select(*out)
    if policy != "disagreement_then_random":
        return first
    total = rows.where("flag").agg(F.count("*").alias("n_flagged"))
    rest = global_offset(rows.where(~F.col("flag")), by_hash(rows, "item_key"), ["item_key"]).crossJoin(F.broadcast(total))  # one row
    return first.unionByName(rest.withColumn("qnum", F.col("n_flagged") + F.col("offset") + 1).select(*out))


def transcript_sql(policy: str, task_order: str = "random", seed: int = 1, name: str = "tr") -> str:
    """The same transcript as SQL, over crit; CTEs named after `name`."""
    tie = "slot" if seed == 0 else "item_key"
    keyed = f"""{name}_k AS (SELECT *, sha256('criterion|{seed}|' || task_id || '|' || slot) AS item_key, sha256('task|{seed}|' || task_id) AS task_key,
        second <> prediction AS flag, sum(1 - prediction) OVER (PARTITION BY task_id) AS fail_count FROM crit)"""
    tasks = {"release": "task_id", "random": "task_key, task_id", "predicted_fail_count": "fail_count, " + ("task_key, task_id" if seed else "task_id")}[task_order]
    within = {"sc_natural": "slot", "sc_random": "item_key, slot", "sc_judge": f"prediction, {tie}, slot", "sc_disagreement": f"CASE WHEN flag THEN 0 WHEN prediction = 0 THEN 1 ELSE 2 END, {tie}, slot"}.get(policy, f"{tie}, slot")
    cols = "task_id, slot, gold, prediction, category, base_id"
    if policy == "random_criterion":
        return f"{keyed}, {name} AS (SELECT row_number() OVER (ORDER BY item_key) AS qnum, {cols} FROM {name}_k)"
    if policy.startswith("sc_"):
        return f"""{keyed}, {name}_f AS (SELECT *, coalesce(sum(1 - gold) OVER (PARTITION BY task_id ORDER BY {within} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fails FROM {name}_k),
        {name} AS (SELECT row_number() OVER (ORDER BY {tasks}, {within}) AS qnum, {cols} FROM {name}_f WHERE fails = 0)"""
    only = f"SELECT row_number() OVER (ORDER BY {tasks}, {within}) AS qnum, {cols} FROM {name}_k WHERE flag"
    if policy == "disagreement_only":
        return f"{keyed}, {name} AS ({only})"
    return f"""{keyed}, {name} AS ({only} UNION ALL SELECT (SELECT count(*) FROM {name}_k WHERE flag) + row_number() OVER (ORDER BY item_key) AS qnum, {cols} FROM {name}_k WHERE NOT flag)"""
