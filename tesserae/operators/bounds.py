"""Sharp ranges of what can pass under disclosed totals, and assignments that attain them.

A release tells how many slots of each group (predicted bit and category, within tasks of one size) have reference bit 1, and the
reference bits of some slots, shown by themselves or with their whole task. Tasks are gathered into types: their numbers of hidden
slots in each group, and whether a shown 0 has failed them. Both extremes are whole-number problems over the types of a (release,
size), which are few; the assignments that solve them are dealt out by ranks of tasks within types, so every slot gets its bit of
both extremes without a task or a group being gathered anywhere.

Tasks that fit into arrays are kept once, in chunks that hold a byte for a slot and one for the releases that show it; types, ranks and
bits of every release are made from these when they are needed and never stored or shuffled by slot. Other tasks go row by row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions import integer
from tesserae.operators import ranking

TYPE = ["release", "k", "dead", "c"]


def releases(frame: DataFrame, shown: dict[str, Column], group: Column) -> DataFrame:
    """The slots of a criterion frame once for each release: release, task_id, slot, k (size of the task), g (its group), gold, shown.

    shown: for each release the condition on the frame's columns under which a slot's reference bit is told. group: a number from 0.
    """
    sizes = frame.groupBy("task_id").agg(F.count("*").cast("int").alias("k"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("release"), F.coalesce(cond, F.lit(False)).alias("shown")) for name, cond in shown.items()])).alias("r")
    rows = frame.join(sizes, "task_id").select("task_id", "slot", "k", group.cast("int").alias("g"), F.col("gold").cast("int").alias("gold"), each)
    return rows.select("r.release", "task_id", "slot", "k", "g", "gold", "r.shown")


def typed(slots: DataFrame, groups: int) -> DataFrame:
    """A row for each (release, task): k, dead, c (hidden slots of each group), s (those of reference bit 1), and whether it passes."""
    hidden = ~F.col("shown")
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("int")
    of = [hidden & (F.col("g") == g) for g in range(groups)]
    return slots.groupBy("release", "task_id", "k").agg(
        (F.max(F.when(F.col("shown") & (F.col("gold") == 0), 1).otherwise(0)) == 1).alias("dead"),
        F.array(*[count(c) for c in of]).alias("c"),
        F.array(*[count(c & (F.col("gold") == 1)) for c in of]).alias("s"),
        F.min("gold").alias("passes"),
    )


PLAN = "release string, k int, dead boolean, c array<int>, n long, passes long, chosen long, cuts array<long>, ones array<long>, zeros array<long>, least long, most long, bound long"


def plan(tasks: DataFrame, groups: int) -> DataFrame:
    """tasks: typed() rows. For each type of a release and size what both extremes do with its tasks, ordered by any rank within the type.

    chosen: the first so many pass in the maximum. cuts: in the minimum tasks of rank cuts[g] to cuts[g + 1] fail by a slot of group g.
    ones, zeros: how many further hidden slots of each group get a 1 in the maximum, a 0 in the minimum. least and most are the
    extremes for the release and size; bound is a proven bound on most, larger only where the search was ended.
    """
    return planned_kinds(tasks.withColumn("n", F.lit(1)), groups)


def planned_kinds(tasks: DataFrame, groups: int) -> DataFrame:
    """plan() from rows that stand for n tasks each, with sums of passes and s."""
    kinds = tasks.groupBy(*TYPE).agg(F.sum("n").cast("long").alias("n"), F.sum("passes").cast("long").alias("passes"), F.array(*[F.sum(F.col("s")[g]) for g in range(groups)]).alias("s"))
    width = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # asked for, as few small rows would be merged into few tasks
    return kinds.repartition(width, "release", "k").groupBy("release", "k").applyInPandas(solved, PLAN)


def solved(part: pd.DataFrame) -> pd.DataFrame:
    """plan() for the types of one release and size."""
    part = part.assign(_c=[tuple(map(int, c)) for c in part["c"]]).sort_values(["dead", "_c"], kind="stable")
    vectors, counts = [list(c) for c in part["_c"]], [int(n) for n in part["n"]]
    dead = [bool(d) for d in part["dead"]]
    groups = len(vectors[0])
    ones = [sum(int(s[g]) for s in part["s"]) for g in range(groups)]
    zeros = [sum(n * v[g] for v, n in zip(vectors, counts, strict=True)) - ones[g] for g in range(groups)]
    alive = [i for i, d in enumerate(dead) if not d]
    taken, bound = integer.most(ones, [vectors[i] for i in alive], [counts[i] for i in alive])
    flow = integer.spread(zeros, [vectors[i] for i in alive], [counts[i] for i in alive])
    chosen, hit = [0] * len(counts), [[0] * groups for _ in counts]
    for i, t, f in zip(alive, taken, flow, strict=True):
        chosen[i], hit[i] = t, f
    left_ones = [ones[g] - sum(t * v[g] for t, v in zip(chosen, vectors, strict=True)) for g in range(groups)]
    left_zeros = [zeros[g] - sum(h[g] for h in hit) for g in range(groups)]
    rows = []
    for i, (v, n) in enumerate(zip(vectors, counts, strict=True)):
        fill_one, fill_zero, cuts = [], [], [0]
        for g in range(groups):
            cuts.append(cuts[-1] + hit[i][g])
            fill_one.append(min(left_ones[g], (n - chosen[i]) * v[g]))
            fill_zero.append(min(left_zeros[g], n * v[g] - hit[i][g]))
            left_ones[g] -= fill_one[g]
            left_zeros[g] -= fill_zero[g]
        rows.append((chosen[i], cuts, fill_one, fill_zero))
    out = part[["release", "k", "dead", "c", "n", "passes"]].copy()
    out["chosen"], out["cuts"], out["ones"], out["zeros"] = (list(x) for x in zip(*rows, strict=True))
    out["least"] = sum(counts[i] for i in alive) - sum(map(sum, hit))
    out["most"] = sum(chosen)
    out["bound"] = bound
    return out


def witnesses(slots: DataFrame, tasks: DataFrame, planned: DataFrame) -> DataFrame:
    """slots with low and high: reference bits that attain the minimum and the maximum, equal to gold where it is shown.

    A task's rank in its type says what it does; a hidden slot's place among those of its group, in its type or its task, says whether
    it takes one of the bits that are left over. Ranks go by levels of hashes.
    """
    keyed = tasks.select("release", "task_id", "k", "dead", "c", ranking.priority("witness", 1, "task_id").alias("key"))
    ranked = ranking.global_offset(keyed, ranking.by_hash(keyed, "key"), ["key", "task_id"], name="u", within=tuple(TYPE)).drop("key")
    does = ranked.join(planned.select(*TYPE, "chosen", "cuts", "ones", "zeros"), TYPE).drop("k")
    by = W.partitionBy("release", "task_id", "g", "shown").orderBy("slot")
    rows = slots.withColumn("pos", F.row_number().over(by) - 1).join(does, ["release", "task_id"])
    at = lambda c, i: F.get(F.col(c), i)
    g, u, pos = F.col("g"), F.col("u"), F.col("pos")
    size, lo, hi = at("c", g).cast("long"), at("cuts", g), at("cuts", g + 1)
    high = F.when(u < F.col("chosen"), 1).when((u - F.col("chosen")) * size + pos < at("ones", g), 1).otherwise(0)
    hit = (u >= lo) & (u < hi)
    # slots of the group that are left in the tasks of lower rank, those that are hit by it have one less
    before = u * size - F.greatest(F.lit(0), F.least(u, hi) - lo)
    low = F.when(hit & (pos == 0), 0).when(before + F.when(hit, pos - 1).otherwise(pos) < at("zeros", g), 0).otherwise(1)
    bit = lambda c: F.when(F.col("shown"), F.col("gold")).otherwise(c).cast("int")
    return rows.select("release", "task_id", "slot", "k", "g", "gold", "shown", bit(low).alias("low"), bit(high).alias("high"))


def checked(bits: DataFrame, planned: DataFrame) -> DataFrame:
    """The assignments held against the release, from their bits alone: a row for each release and size.

    tasks, truth (passes by the reference), low_passes and high_passes (of the assignments); broken_totals: groups whose number of
    ones differs from the reference's; broken_links: shown slots whose bit does; least, most and bound as planned.
    """
    totals = bits.groupBy("release", "k", "g").agg(*[F.sum(c).alias(c) for c in ("gold", "low", "high")], F.sum(F.when(F.col("shown") & ((F.col("low") != F.col("gold")) | (F.col("high") != F.col("gold"))), 1).otherwise(0)).alias("links"))
    totals = totals.groupBy("release", "k").agg(F.sum(F.when((F.col("low") != F.col("gold")) | (F.col("high") != F.col("gold")), 1).otherwise(0)).alias("broken_totals"), F.sum("links").alias("broken_links"))
    tasks = bits.groupBy("release", "task_id", "k").agg(*[F.min(c).alias(c) for c in ("gold", "low", "high")])
    passes = tasks.groupBy("release", "k").agg(F.count("*").alias("tasks"), F.sum("gold").alias("truth"), F.sum("low").alias("low_passes"), F.sum("high").alias("high_passes"))
    ends = planned.groupBy("release", "k").agg(F.max("least").alias("least"), F.max("most").alias("most"), F.max("bound").alias("bound"))
    return passes.join(totals, ["release", "k"]).join(ends, ["release", "k"])


# ---------------------------------------------------------------- tasks that fit into arrays

#: Criteria after which a chunk ends with its batch.
CHUNK = 1 << 20
_CHUNK = "chunk long, ids binary, sizes binary, codes binary, shown binary"
_KINDS = "chunk long, release string, k int, dead boolean, c array<int>, n long, passes long, s array<long>"
_TOTALS = ("slots", "gold", "low", "high", "links", "shown", "shown_low", "shown_high")


def chunks(tasks: DataFrame, told) -> DataFrame:
    """Rows of some tasks each, from (task_id, codes: 2 * group + gold of each slot); told(ids, sizes): the bits of the releases that show each slot."""

    most = CHUNK

    def run(batches):
        held, n, made = [], 0, 0

        def row():
            ids, sizes, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            parts = [x.tobytes() for x in (ids, sizes, codes, told(ids, sizes))]
            number = (TaskContext.get().partitionId() << 32) + made
            return pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([x], pa.binary()) for x in parts]], names=["chunk", "ids", "sizes", "codes", "shown"])

        for batch in batches:
            lists = batch.column(1)
            sizes, codes = np.diff(lists.offsets.to_numpy()).astype(np.int32), lists.flatten().to_numpy().astype(np.int8)
            held.append((batch.column(0).to_numpy(), sizes, codes))
            n += len(codes)
            if n >= most:
                yield row()
                held, n, made = [], 0, made + 1
        if n:
            yield row()

    return tasks.select("task_id", "codes").mapInArrow(run, _CHUNK)


class _Chunk:
    """A chunk as arrays over its slots."""

    def __init__(self, sizes: bytes, codes: bytes, shown: bytes, groups: int):
        self.k, code, self.told = np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(codes, np.int8), np.frombuffer(shown, np.uint8)
        self.task, self.g, self.gold, self.groups = np.repeat(np.arange(len(self.k)), self.k), (code >> 1).astype(np.int64), (code & 1) == 1, groups
        self.passes = np.bincount(self.task[~self.gold], minlength=len(self.k)) == 0
        self.cell = self.task * groups + self.g

    def types(self, release: int) -> tuple:
        """Which slots a release shows; k, dead and hidden slots of each group as columns, of its types, which each task has, and s of each task."""
        shown = (self.told >> release) & 1 == 1
        count = lambda on: np.bincount(self.cell[on], minlength=len(self.k) * self.groups).reshape(-1, self.groups)
        dead = np.bincount(self.task[shown & ~self.gold], minlength=len(self.k)) > 0
        table = np.column_stack([self.k, dead, count(~shown)])
        key = np.zeros(len(table), np.int64)
        for column in table.T:
            if (int(key.max()) + 1) * (int(column.max()) + 1) >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
            key = key * (int(column.max()) + 1) + column
        _, at, of = np.unique(key, return_index=True, return_inverse=True)
        return shown, table[at], of, count(~shown & self.gold)


def kinds(made: DataFrame, names: tuple, groups: int) -> DataFrame:
    """Types of each chunk and release with their tasks n, those that pass and the ones among their hidden slots."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row["sizes"], row["codes"], row["shown"], groups)
                for r, name in enumerate(names):
                    _, table, of, s = chunk.types(r)
                    n = len(table)
                    sums = np.column_stack([np.bincount(of, s[:, g], n) for g in range(groups)]).astype(np.int64)
                    columns = [[row["chunk"]] * n, [name] * n, pa.array(table[:, 0].astype(np.int32)), pa.array(table[:, 1] == 1), pa.array(table[:, 2:].tolist(), pa.list_(pa.int32())), np.bincount(of, minlength=n), np.bincount(of, chunk.passes, n).astype(np.int64), pa.array(sums.tolist(), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in _KINDS.split(", ")])

    return made.select("chunk", "sizes", "codes", "shown").mapInArrow(run, _KINDS)


def totals(made: DataFrame, of_chunks: DataFrame, planned: DataFrame, names: tuple, groups: int) -> DataFrame:
    """The bits of both assignments, as witnesses() has them, added up: a row for each (release, k, g), and with g = -1 the tasks and their passes.

    A task's rank goes by chunks and its place in its chunk. links: shown slots whose bit differs from the reference.
    """
    before = F.coalesce(F.sum("n").over(W.partitionBy(*TYPE).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first")
    ranks = of_chunks.select("chunk", *TYPE, before).join(planned.select(*TYPE, "chosen", "cuts", "ones", "zeros"), TYPE)
    schema = "release string, k int, g int, " + ", ".join(f"{c} long" for c in _TOTALS)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, rows = left.to_pylist()[0], []
        chunk = _Chunk(row["sizes"], row["codes"], row["shown"], groups)
        sizes, size_of = np.unique(chunk.k, return_inverse=True)
        for r, name in enumerate(names):
            plans = right.filter(pa.array(np.array(right.column("release").to_pylist()) == name))
            column = lambda c, t=plans: np.array(t.column(c).to_pylist())
            shown, table, of, _ = chunk.types(r)
            there = np.column_stack([column("k"), column("dead"), column("c")])
            at = np.empty(len(table), np.int64)  # the plan of each type: both have the same ones
            at[np.lexsort(table.T)] = np.lexsort(there.T)
            if not np.array_equal(there[at], table):
                raise ValueError(f"types of chunk {row['chunk']} differ from those planned")
            first, chosen, cuts, ones, zeros = (column(c)[at] for c in ("first", "chosen", "cuts", "ones", "zeros"))
            u = first[of] + _place(of)
            pos = np.zeros(len(chunk.task), np.int64)
            pos[~shown] = _place(chunk.cell[~shown])
            t, g, kind, u = chunk.task, chunk.g, of[chunk.task], u[chunk.task]
            size, lo, hi, over = table[kind, 2 + g], cuts[kind, g], cuts[kind, g + 1], u - chosen[kind]
            hit = (u >= lo) & (u < hi)
            high = (over < 0) | (over * size + pos < ones[kind, g])
            # slots of the group that are left in the tasks of lower rank, those that are hit by it have one less
            less = u * size - np.maximum(0, np.minimum(u, hi) - lo)
            low = ~((hit & (pos == 0)) | (less + pos - hit < zeros[kind, g]))
            low, high = np.where(shown, chunk.gold, low), np.where(shown, chunk.gold, high)
            cell, n = size_of[t] * groups + g, len(sizes) * groups
            links = shown & ((low != chunk.gold) | (high != chunk.gold))
            sums = [np.bincount(cell[on], minlength=n) for on in (slice(None), chunk.gold, low, high, links, shown, shown & low, shown & high)]
            rows += [(name, int(sizes[i // groups]), i % groups, *(int(x[i]) for x in sums)) for i in np.flatnonzero(sums[0])]
            passes = [np.bincount(size_of[np.bincount(t[~on], minlength=len(of)) == 0], minlength=len(sizes)) for on in (chunk.gold, low, high)]
            rows += [(name, int(k), -1, int(n), *(int(x[i]) for x in passes), 0, 0, 0, 0) for i, (k, n) in enumerate(zip(sizes, np.bincount(size_of), strict=True))]
        kind = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        fields = [c.split() for c in schema.split(", ")]
        return pa.Table.from_arrays([pa.array(list(c), kind[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[c for c, _ in fields])

    parts = made.select("chunk", "sizes", "codes", "shown").groupBy("chunk").cogroup(ranks.groupBy("chunk")).applyInArrow(run, schema)
    return parts.groupBy("release", "k", "g").agg(*[F.sum(c).alias(c) for c in _TOTALS])


def _place(of: np.ndarray) -> np.ndarray:
    """The place of each among those of the same number."""
    order = np.argsort(of, kind="stable")
    ordered = of[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(of)])
    out = np.empty(len(of), np.int64)
    out[order] = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    return out


def checked_totals(sums: DataFrame, planned: DataFrame) -> DataFrame:
    """checked() from totals()."""
    task, broken = F.col("g") == -1, (F.col("low") != F.col("gold")) | (F.col("high") != F.col("gold"))
    of = lambda c, name: F.sum(F.when(task, F.col(c))).alias(name)
    rows = sums.groupBy("release", "k").agg(
        of("slots", "tasks"), of("gold", "truth"), of("low", "low_passes"), of("high", "high_passes"), F.sum(F.when(~task & broken, 1).otherwise(0)).alias("broken_totals"), F.sum("links").alias("broken_links")
    )
    return rows.join(planned.groupBy("release", "k").agg(*[F.max(c).alias(c) for c in ("least", "most", "bound")]), ["release", "k"])
