"""Whole families drawn anew: exact multinomial counts by splitting draws down a tree of hash buckets.

The root has as many draws as there are families. A node hands its draws to its sixteen children by a multinomial draw over their
numbers of families, and a bucket to its families alike, so counts are those of one multinomial draw over all families, and no task
sees more than a bucket. A node's generator is seeded by the seed and its place in the tree, so counts don't depend on the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.storage import stored

#: Families of a bucket, about, and weights that are held at once.
BUCKET, CELLS = 16_384, 1 << 21


def _generator(seed: int, node: str, kind: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence([seed, kind, len(node), int(node or "0", 16)]))


def _bucketed(rows: DataFrame, key: str, families: int) -> tuple[DataFrame, int]:
    depth = 0
    while families > BUCKET * 16**depth:
        depth += 1
    return rows.withColumn("node", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, depth) if depth else F.lit("")), depth


def drawn(families: DataFrame, key: str, replicates: int, seed: int) -> tuple[DataFrame, int]:
    """(node, draws) of the buckets, with an array of one count for each replicate, and the depth of the tree."""
    total = families.count()
    rows, depth = _bucketed(families, key, total)
    leaves = stored(rows.groupBy("node").agg(F.count("*").alias("n")), "nodes")
    spark = families.sparkSession
    draws = spark.range(1 if total else 0).select(F.lit("").alias("node"), F.array_repeat(F.lit(total).cast("long"), replicates).alias("draws"))
    for d in range(1, depth + 1):
        children = leaves.groupBy(F.substring("node", 1, d).alias("node"), F.substring("node", 1, d - 1).alias("parent") if d > 1 else F.lit("").alias("parent")).agg(F.sum("n").alias("n"))

        def split(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("node")
            n = part["n"].to_numpy(np.int64)
            counts = _generator(seed, part["parent"].iloc[0], 0).multinomial(np.array(part["draws"].iloc[0], np.int64), n / n.sum())
            return pd.DataFrame({"node": part["node"], "draws": list(counts.T)})

        below = children.join(draws.withColumnRenamed("node", "parent"), "parent")
        draws = stored(below.groupBy("parent").applyInPandas(split, "node string, draws array<long>"), "draws")
    return draws, depth


def totals(rows: DataFrame, key: str, by: list[str], value: str, replicates: int, seed: int) -> DataFrame:
    """(by, rep, n): the sum of value over the rows of the families that each replicate draws, as often as it draws them.

    Families are the values of key. rep runs from 1; groups that a replicate draws nothing of are left out. Rows of one family and
    group are summed before they travel. A null key is a family; an empty table gives no rows.
    """
    rows = stored(rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("\0")).alias("_key"), *by).agg(F.sum(value).cast("long").alias("_value")), "family-values")
    families = rows.select("_key").distinct()
    draws, _ = drawn(families, "_key", replicates, seed)
    bucketed, _ = _bucketed(rows, "_key", families.count())

    def weigh(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        node, counts = right["node"].iloc[0], np.array(right["draws"].iloc[0], np.int64)
        names, family = np.unique(left["_key"].to_numpy(str), return_inverse=True)
        group = left.groupby(by, dropna=False, sort=True).ngroup().to_numpy() if by else np.zeros(len(left), np.int64)
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
        value = left["_value"].to_numpy(np.int64)[order]
        generator, parts = _generator(seed, node, 1), []
        step = max(1, CELLS // max(len(names), len(left)))
        for a in range(0, replicates, step):
            weight = generator.multinomial(counts[a : a + step], np.full(len(names), 1 / len(names)))
            parts.append(np.add.reduceat(weight[:, family[order]] * value, starts, axis=1))
        out = left.iloc[order[starts]][by].copy()
        out["totals"] = list(np.concatenate(parts).T)
        return out

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "totals array<long>"])
    summed = bucketed.groupBy("node").cogroup(draws.groupBy("node")).applyInPandas(weigh, schema)
    each = summed.select(*by, F.posexplode("totals").alias("rep", "n")).where("n <> 0")
    return each.groupBy(*by, (F.col("rep") + 1).alias("rep")).agg(F.sum("n").alias("n"))
