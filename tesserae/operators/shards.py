"""Shards of requests under a cap on bytes and one on requests.

Requests are packed by first fit within ranges of their order, a range a call. What a range leaves half empty is merged: such shards
are packed as wholes, by first fit, with those of the ranges beside it, then with those of further ones, until all are one range.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.firstfit import Rooms
from tesserae.operators.storage import stored

#: Requests of a range, and ranges whose open shards are merged together.
RANGE, MERGED = 50_000, 32
#: A shard with over this share of both rooms left is open to others.
OPEN = 0.02


def _packed(part: pd.DataFrame, most_bytes: int, most_items: int) -> pd.DataFrame:
    """Rows (place, bytes, items) in order of place, with shard: the place of the first row that it holds, and what is left of it."""
    part = part.sort_values("place", kind="stable")
    rooms, first, of = Rooms(most_bytes, most_items), [], []
    for place, size, items in zip(part["place"].tolist(), part["bytes"].tolist(), part["items"].tolist(), strict=True):
        s = rooms.put(int(size), int(items))
        if s == len(first):
            first.append(place)
        of.append(s)
    left = [rooms.left(s) for s in range(len(first))]
    out = part[["place"]].copy()
    out["shard"] = [first[s] for s in of]
    out["bytes_left"] = [left[s][0] for s in of]
    out["items_left"] = [left[s][1] for s in of]
    return out


_PACKED = "place long, shard long, bytes_left long, items_left long"


def first_fit(requests: DataFrame, most_bytes: int, most_items: int, range_size: int | None = None, merged: int | None = None) -> DataFrame:
    """requests (place, bytes) with shard: the place of the first request of its shard; null for a request that is over the cap alone.

    place is a whole number from 0 that gives the order, without repeats; the order of rows doesn't matter. No shard passes a cap. Up to
    range_size requests this is one first fit over all. Beyond that it differs from one global pass in two ways: a request only sees the
    shards of its own range, and open shards of different ranges are joined as wholes, so that a shard may hold requests of places
    far apart. An empty table gives no rows.
    """
    range_size, merged = range_size or RANGE, merged or MERGED
    fits = F.col("bytes") <= most_bytes
    rows = requests.where(fits).select("place", F.col("bytes").cast("long").alias("bytes"), F.lit(1).cast("long").alias("items"), F.floor(F.col("place") / range_size).alias("part"))
    pack = lambda part: _packed(part, most_bytes, most_items)
    found = stored(rows.groupBy("part").applyInPandas(pack, _PACKED).withColumn("part", F.floor(F.col("place") / range_size)), "packed")
    found_shards = found.groupBy("shard", "part").agg(F.first("bytes_left").alias("bytes_left"), F.first("items_left").alias("items_left"))
    is_open = (F.col("bytes_left") > OPEN * most_bytes) & (F.col("items_left") > OPEN * most_items)
    waiting = stored(found_shards.where(is_open), "open")
    moves = None  # shard to the one that it is joined with
    parts = waiting.agg(F.max("part")).first()[0] or 0
    while parts > 0:
        whole = waiting.select(F.col("shard").alias("place"), (most_bytes - F.col("bytes_left")).alias("bytes"), (most_items - F.col("items_left")).alias("items"), F.floor(F.col("part") / merged).alias("part"))
        joined = stored(whole.groupBy("part").applyInPandas(pack, _PACKED), "joined")
        step = joined.select(F.col("place").alias("shard"), F.col("shard").alias("to"))
        moves = step if moves is None else stored(moves.withColumnRenamed("to", "mid").join(step.withColumnRenamed("shard", "mid"), "mid", "left").select("shard", F.coalesce("to", "mid").alias("to")), "moves")
        kept = joined.where("place = shard").select("shard", "bytes_left", "items_left")
        above = waiting.select("shard", F.floor(F.col("part") / merged).alias("part"))
        waiting = stored(kept.join(above, "shard").where(is_open).select("shard", "part", "bytes_left", "items_left"), "open")
        parts //= merged
    if moves is not None:
        found = found.join(moves, "shard", "left").withColumn("shard", F.coalesce("to", "shard"))
    return requests.join(found.select("place", "shard"), "place", "left")
