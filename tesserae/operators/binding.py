"""Digests that bind a table's content, and differences found by way of them or by position.

A table's digest is the root of a tree. A row's digest is that of its values, in the order of column names; rows lie in leaves by a hash
of their key, leaves in nodes by shorter and shorter beginnings of it. A node's digest is that of its children's digests in order, so
none depends on files, partitions or the order of rows. Within a leaf rows go by the beginning of their own digest first, so that many
rows of one key are not gathered in one place; repeated rows are counted before they travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators import ranking
from tesserae.operators.storage import stored

#: Hex digits of a level of the tree, and of the row digest within a leaf.
DIGITS, INNER = 2, 4


def canonical(columns: list[str]) -> Column:
    """Values as one text from which each can be told: its length and itself, N for null; columns by name."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    return F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("N")) for c in sorted(columns)])


def row_digests(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, node (the hash of the key) and digest (of all columns) of each row."""
    return df.select(*[F.col(f"`{k}`") for k in keys], F.sha2(canonical(keys), 256).alias("node"), F.sha2(canonical(df.columns), 256).alias("digest"))


def tree(df: DataFrame, keys: list[str], depth: int = 2) -> DataFrame:
    """The nodes of the table's tree: level (0 is the root), node (its beginning of key hashes), digest, and n (its rows).

    depth is part of what is bound: leaves have 2 * depth hex digits. Columns are read as text; an empty table has a root of its own.
    A node has at most 256 children, a leaf's inner groups are 65,536.
    """
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    rows = row_digests(df, keys).groupBy(F.substring("node", 1, DIGITS * depth).alias("node"), "digest").agg(F.count("*").alias("n"))
    inner = rows.groupBy("node", F.substring("digest", 1, INNER).alias("part")).agg(joined(F.concat_ws("*", "digest", "n")).alias("digest"), F.sum("n").alias("n"))
    level = inner.groupBy("node").agg(joined(F.concat_ws(":", "part", "digest")).alias("digest"), F.sum("n").alias("n"))
    level = stored(level.select(F.lit(depth).alias("level"), "node", "digest", "n"), "tree")
    out = level
    for d in reversed(range(depth)):
        up = level.groupBy(F.substring("node", 1, DIGITS * d).alias("node")) if d else level.groupBy(F.lit("").alias("node"))
        level = up.agg(joined(F.concat_ws(":", "node", "digest")).alias("digest"), F.sum("n").alias("n"))
        if not d:  # the root of an empty table is the digest of nothing
            nothing = df.sparkSession.range(1).select(F.lit("").alias("node"), F.sha2(F.lit(""), 256).alias("none"))
            level = nothing.join(level, "node", "left").select("node", F.coalesce("digest", "none").alias("digest"), F.coalesce("n", F.lit(0)).alias("n"))
        level = level.select(F.lit(d).alias("level"), "node", "digest", "n")
        out = out.unionByName(level)
    return out


def root(df: DataFrame, keys: list[str], depth: int = 2) -> str:
    """The digest of the whole table."""
    return tree(df, keys, depth).where("level = 0").first()["digest"]


def differences(left: DataFrame, right: DataFrame, keys: list[str], depth: int = 2) -> DataFrame:
    """The keys at which two tables differ, and state: missing (only left), added (only right) or changed.

    Both trees are gone down together, from nodes that differ to their children; rows are only looked at in leaves that differ. Keys
    that repeat differ if their rows do, however often each; null keys are keys.
    """
    a, b = stored(tree(left, keys, depth), "tree-left"), stored(tree(right, keys, depth), "tree-right")
    unlike = None
    for d in range(depth + 1):
        pick = lambda t, c, d=d: t.where(F.col("level") == d).select("node", F.col("digest").alias(c))
        x, y = pick(a, "x"), pick(b, "y")
        if unlike is not None:
            above = unlike.select(F.col("node").alias("above"))
            x, y = (t.withColumn("above", F.substring("node", 1, DIGITS * (d - 1)) if d > 1 else F.lit("")).join(above, "above", "left_semi").drop("above") for t in (x, y))
        unlike = stored(x.join(y, "node", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("node"), "unlike")
    leaf = F.substring("node", 1, DIGITS * depth)
    inside = lambda t, side: row_digests(t, keys).withColumn("leaf", leaf).join(unlike.withColumnRenamed("node", "leaf"), "leaf", "left_semi").groupBy(*keys, "node", "digest").agg(F.count("*").alias(side))
    x, y = inside(left, "x"), inside(right, "y").withColumnsRenamed({k: f"_{k}" for k in keys})
    same = (F.col("l.node") == F.col("r.node")) & (F.col("l.digest") == F.col("r.digest"))
    both = x.alias("l").join(y.alias("r"), same, "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    found = both.select(F.coalesce("l.node", "r.node").alias("node"), *[F.when(F.col("l.node").isNotNull(), F.col(f"l.{k}")).otherwise(F.col(f"r._{k}")).alias(k) for k in keys], F.col("x"), F.col("y"))
    found = found.groupBy("node", *keys).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("x"), F.coalesce(F.sum("y"), F.lit(0)).alias("y"))
    # a key may have further rows that are equal on both sides: then it is changed, not missing or added
    held = lambda t, c: row_digests(t, keys).join(found.select("node"), "node", "left_semi").groupBy("node").agg(F.count("*").alias(c))
    found = found.join(held(left, "lefts"), "node", "left").join(held(right, "rights"), "node", "left")
    state = F.when(F.col("rights").isNull(), "missing").when(F.col("lefts").isNull(), "added").otherwise("changed")
    return found.select(*keys, state.alias("state"))


#: Positions that are numbered together.
_SPAN = 12


def by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """What turns one sequence of rows into another: state (missing, inserted, changed), left_pos and right_pos.

    Both have pos (from 0, without gaps) and sha256 of a row. Equal rows are matched, the k-th of one side with the k-th of the other.
    Rows without a match that stand between the same matched ones are changed as far as both sides have them, in order; what is left over
    on the left is missing, on the right inserted. Rows that only moved count as matched.

    Contents that occur once a side meet in one aggregation; only those that repeat are numbered. Ranks go by levels of positions, so
    neither a row that repeats everywhere nor sequences without a common row are gathered in one place.
    """
    digest = F.unhex("sha256").alias("sha256")
    side = lambda rows, n: rows.select(F.lit(n).cast("tinyint").alias("side"), "pos", digest)
    rows = side(left, 0).unionByName(side(right, 1))
    on = lambda n, c: F.when(F.col("side") == n, c)
    ends = rows.groupBy("sha256").agg(F.count(on(0, F.lit(1))).alias("lefts"), F.count(on(1, F.lit(1))).alias("rights"), F.min(on(0, F.col("pos"))).alias("left_pos"), F.min(on(1, F.col("pos"))).alias("right_pos"))
    repeats = (F.col("lefts") > 1) | (F.col("rights") > 1)
    ends = stored(ends.select(F.when(repeats, F.col("sha256")).alias("sha256"), "left_pos", "right_pos"), "contents")
    once = ends.where("sha256 IS NULL").select(F.explode(F.array(F.struct(F.lit(0).cast("tinyint").alias("side"), F.col("left_pos").alias("pos"), F.col("right_pos").isNotNull().alias("met")), F.struct(F.lit(1).cast("tinyint").alias("side"), F.col("right_pos").alias("pos"), F.col("left_pos").isNotNull().alias("met")))).alias("x")).select("x.*").where("pos IS NOT NULL")
    known = ends.where("sha256 IS NOT NULL").select("sha256")
    if not known.isEmpty():
        often = stored(ranking.global_offset(rows.join(known, "sha256", "left_semi"), ranking.by_number("pos"), ["pos"], name="nth", within=("sha256", "side")), "numbered")
        pairs = often.groupBy("sha256", "nth").agg(F.min(on(0, F.col("pos"))).alias("l"), F.min(on(1, F.col("pos"))).alias("r"))
        both = F.col("l").isNotNull() & F.col("r").isNotNull()
        met = pairs.select(F.explode(F.array(F.struct(F.lit(0).cast("tinyint").alias("side"), F.col("l").alias("pos"), both.alias("met")), F.struct(F.lit(1).cast("tinyint").alias("side"), F.col("r").alias("pos"), both.alias("met")))).alias("x")).select("x.*").where("pos IS NOT NULL")
        once = once.unionByName(met)
    alone = _alone(once)
    pick = lambda n, name: alone.where(F.col("side") == n).select("gap", "at", F.col("pos").alias(name))
    both = pick(0, "left_pos").join(pick(1, "right_pos"), ["gap", "at"], "full_outer")
    state = F.when(F.col("right_pos").isNull(), "missing").when(F.col("left_pos").isNull(), "inserted").otherwise("changed")
    return both.select(state.alias("state"), "left_pos", "right_pos")


def _alone(rows: DataFrame) -> DataFrame:
    """Of rows (side, pos, met), stored, those not met: gap, the met ones before them, and at, their place after the last of these.

    What comes before a span of positions is found from the counts and last met rows of spans, in two levels; all spans have rows.
    """
    near, far = F.shiftright("pos", _SPAN), F.shiftright("span", _SPAN)
    rows = rows.withColumn("span", near).withColumn("end", F.when(F.col("met"), F.col("pos") + 1))
    n, last = F.count("end"), F.max("end")
    spans = rows.groupBy("side", "span").agg(n.alias("n"), last.alias("last")).withColumn("part", far)
    parts = spans.groupBy("side", "part").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    before = lambda by, *keys: W.partitionBy("side", *keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    over = lambda t, w, i: t.withColumns({f"n{i}": F.coalesce(F.sum("n").over(w), F.lit(0)), f"l{i}": F.coalesce(F.max("last").over(w), F.lit(0))}).drop("n", "last")
    base = over(spans, before("span", "part"), 1).join(over(parts, before("part"), 0), ["side", "part"])
    base = base.select("side", "span", (F.col("n0") + F.col("n1")).alias("n_before"), F.greatest("l0", "l1").alias("l_before"))
    w = before("pos", "span")
    inside = rows.withColumns({"n_in": n.over(w), "l_in": last.over(w)}).where("NOT met")
    found = inside.join(base, ["side", "span"])
    return stored(found.select("side", (F.col("n_before") + F.col("n_in")).alias("gap"), (F.col("pos") - F.greatest("l_before", F.coalesce("l_in", F.lit(0)))).alias("at"), "pos"), "left-over")


def split_positions(lines: DataFrame) -> DataFrame:
    """pos of each row of lines (file, start, number, ...): files by name, ranges by start, rows by number.

    Only the counts of ranges are summed up over the table: within files, then over files. They are as few as the ranges.
    """
    counts = lines.groupBy("file", "start").agg((F.max("number") + 1).alias("n"))
    base = ranking.global_offset(counts, [[F.col("file")]], ["start"], F.col("n"), "base").select("file", "start", "base")
    return lines.join(F.broadcast(base), ["file", "start"]).withColumn("pos", F.col("base") + F.col("number")).drop("base")
