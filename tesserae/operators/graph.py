"""Connected components of items that share tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import storage


def by_tokens(pairs: DataFrame) -> DataFrame:
    """(node, component) from rows (node, token): the smallest node that is reached over shared tokens.

    Each token links its nodes to the smallest of them, so a token of n nodes makes n - 1 edges. Labels begin with the smallest node
    that shares a token, travel along the edges and jump over the labels' own labels, until a round moves none; each round's labels are
    stored. Nodes without an edge, mostly by far the most, take no part in it. Null nodes or tokens link nothing.
    """
    rows = pairs.where("node IS NOT NULL AND token IS NOT NULL").distinct()
    least = rows.groupBy("token").agg(F.min("node").alias("hub"))
    spokes = rows.join(least, "token").where("node <> hub").select("node", "hub").distinct()
    edges = storage.stored(spokes.unionByName(spokes.select(F.col("hub").alias("node"), F.col("node").alias("hub"))), "edges")
    nodes = pairs.where("node IS NOT NULL").select("node").distinct()
    labels = storage.stored(edges.groupBy("node").agg(F.least(F.col("node"), F.min("hub")).alias("component")), "labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "hub"), "hub").groupBy("node").agg(F.min("component").alias("heard"))
        low = labels.join(heard, "node", "left").select("node", "component", F.least("component", F.coalesce("heard", "component")).alias("low"))
        above = labels.select(F.col("node").alias("low"), F.col("component").alias("above"))
        moved = low.join(above, "low", "left").select("node", "component", F.least("low", F.coalesce("above", "low")).alias("now"))
        moved = storage.stored(moved, "labels")
        labels = moved.select("node", F.col("now").alias("component"))
        if moved.where("now <> component").isEmpty():
            return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
