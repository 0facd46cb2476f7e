"""Queries on the sharp ranges under disclosed totals, and on the assignments that attain them."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators import bounds, ranking, sweeps
from tesserae.operators.storage import stored
from tesserae.plans import grid
from tesserae.sources import frames
from tesserae.sources.frames import ORDERS_SQL, TASKS_SQL

QUERIES: dict = {}
ORACLES: dict = {}

#: Predicted bit by category.
CATEGORIES = ("A", "N", "R")
GROUPS = 2 * len(CATEGORIES)
#: Releases: the hex digit that hashes of what is shown stay below, by whole task or by slot.
SHOWN = {"totals": None, "tasks 25": ("task", "4"), "tasks 50": ("task", "8"), "tasks 75": ("task", "c"), "slots 25": ("slot", "4"), "slots 50": ("slot", "8")}


def query(name: str, sql: str | None = None, chunked: bool = False):
    """Register f(frame); chunked: where tasks fit into arrays, f takes their chunks()."""

    def add(f):
        def run(spark, sf_dir):
            made = chunks(spark, sf_dir) if chunked else None
            return f(frames.orders_frame(spark, sf_dir) if made is None else made)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = f"WITH {ORDERS_SQL}, {TASKS_SQL}{sql}"
        return f

    return add


def slots_of(frame: DataFrame, by_category: bool = True) -> tuple[DataFrame, int]:
    """The slots of every release, and the number of groups: predicted bit and category, or predicted bit alone."""
    ids = {"task": ("task_id",), "slot": ("task_id", "slot")}
    shown = {name: F.lit(False) if how is None else ranking.priority("show", 1, *ids[how[0]]) < how[1] for name, how in SHOWN.items()}
    category = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")) - 1
    group = F.col("prediction") * len(CATEGORIES) + category if by_category else F.col("prediction")
    return bounds.releases(frame, shown, group), GROUPS if by_category else 2


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The slots of the orders frame in chunks for bounds.totals(), stored once; None where a task is too large or a slot has no group or bit."""
    rows, known = frames.orders_codes(spark, sf_dir, CATEGORIES)
    tasks = sweeps.gathered(rows, known, grid.LARGE_TASK, lambda ids: grid.numbered(rows, known, ids), 4)
    if tasks is None or not tasks.where(F.exists("codes", lambda c: c >= 2 * GROUPS)).isEmpty():
        return None
    return stored(bounds.chunks(tasks, told), "released")


def told(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each slot of tasks the bits of the releases that show it."""
    digit = lambda tails: np.array([hashlib.sha256(b"show|1|" + x).digest()[0] >> 4 for x in tails], np.uint8)
    slots = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    digits = {"task": np.repeat(digit(b"%d" % t for t in ids.tolist()), sizes), "slot": digit(b"%d|%d" % x for x in zip(np.repeat(ids, sizes).tolist(), slots.tolist(), strict=True))}
    out = np.zeros(len(slots), np.uint8)
    for i, how in enumerate(SHOWN.values()):
        if how is not None:
            out |= (digits[how[0]] < int(how[1], 16)).astype(np.uint8) << i
    return out


def summed(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals of both assignments from chunks(), and the plan of types."""
    kinds = stored(bounds.kinds(made, tuple(SHOWN), GROUPS), "released-types")
    planned = stored(bounds.planned_kinds(kinds, GROUPS), "released-plan")
    return bounds.totals(made, kinds, planned, tuple(SHOWN), GROUPS), planned


def ranges(frame: DataFrame, by_category: bool = True) -> DataFrame:
    """The checked extremes of each release and size, from a frame or chunks(); types and slots are stored once, as several steps read them."""
    if "chunk" in frame.columns:
        return bounds.checked_totals(*summed(frame))
    slots, groups = slots_of(frame, by_category)
    slots = stored(slots, "released")
    tasks = stored(bounds.typed(slots, groups), "released-tasks")
    planned = stored(bounds.plan(tasks, groups), "released-plan")
    return bounds.checked(bounds.witnesses(slots, tasks, planned), planned)


ORDERS = tuple(range(1, 11))
STEPS = (10, 25, 50, 75, 100)


def ladder(frame: DataFrame) -> DataFrame:
    """(stage, ord, share, tasks, truth, least, most, bound) of every release of the ladder.

    d0 gives totals by size and predicted bit, d1 by category too, d2 the reference of whole tasks as well: the first floor(share of all)
    in each of ten orders, by hashes up to the key at which they end. Extremes are summed over sizes. d2 shows whole tasks, so a task's
    hidden slots are counted once, for d1, and each release of d2 has these or none.
    """
    category = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")) - 1
    totals = lambda name, group, groups: bounds.typed(bounds.releases(frame, {name: F.lit(False)}, group), groups)
    d1 = stored(totals("d1 0 0", F.col("prediction") * len(CATEGORIES) + category, GROUPS), "ladder-tasks")
    n = d1.count()
    key = lambda o: F.sha2(F.concat_ws("|", F.lit("shown"), o.cast("string"), F.col("task_id").cast("string")), 256)
    keyed = d1.select("task_id", F.explode(F.array(*map(F.lit, ORDERS))).alias("ord")).withColumn("key", key(F.col("ord")))
    ends = ranking.cuts(keyed, "key", [(o, 1000 * o + s, s * n // 100) for o in ORDERS for s in STEPS], within="ord")
    told = F.array(*[F.struct(F.lit(f"d2 {o} {s}").alias("release"), (F.col(f"key{o}") <= ends[1000 * o + s][0]).alias("shown")) for o in ORDERS for s in STEPS])
    d2 = d1.withColumns({f"key{o}": key(F.lit(o)) for o in ORDERS}).withColumn("told", F.explode(told))
    none = F.array_repeat(F.lit(0), GROUPS)
    shown = F.col("told.shown")
    d2 = d2.select("told.release", "task_id", "k", (shown & (F.col("passes") == 0)).alias("dead"), *[F.when(shown, none).otherwise(F.col(c)).alias(c) for c in "cs"], "passes")
    out = None
    for typed, groups in ((totals("d0 0 0", F.col("prediction"), 2), 2), (d1.unionByName(d2), GROUPS)):
        planned = stored(bounds.plan(typed, groups), "ladder-plan")
        part = planned.groupBy("release").agg(F.sum("n").alias("tasks"), F.sum("passes").alias("truth"))
        ends = planned.groupBy("release", "k").agg(*[F.max(c).alias(c) for c in ("least", "most", "bound")]).groupBy("release").agg(*[F.sum(c).alias(c) for c in ("least", "most", "bound")])
        part = part.join(ends, "release")
        out = part if out is None else out.unionByName(part)
    name = F.split("release", " ")
    return out.select(name[0].alias("stage"), name[1].cast("int").alias("ord"), name[2].cast("int").alias("share"), "tasks", "truth", "least", "most", "bound")


_HASH = {"task": "sha256('show|1|' || task_id)", "slot": "sha256('show|1|' || task_id || '|' || slot)"}


def _released(group: str, groups: int) -> str:
    """Slots of every release, tasks, and by Hall's theorem how many open tasks the hidden failures can reach."""
    shown = " UNION ALL ".join(f"SELECT '{name}' AS release, *, {'false' if how is None else f'''{_HASH[how[0]]} < '{how[1]}' '''} AS shown FROM z" for name, how in SHOWN.items())
    outside = " + ".join(f"CASE WHEN (a.sub & {1 << g}) = 0 THEN z{g} ELSE 0 END" for g in range(groups))
    return f""", z AS (SELECT c.task_id, c.slot, k, gold, CAST({group} AS INTEGER) AS g FROM crit c JOIN tasks t ON c.task_id = t.task_id), r AS ({shown}),
    w AS (SELECT release, task_id, k, min(gold) AS passes, bool_or(shown AND gold = 0) AS dead, coalesce(bit_or(CASE WHEN shown THEN 0 ELSE 1 << g END), 0) AS mask,
        {', '.join(f'count(*) FILTER (NOT shown AND g = {g} AND gold = 0) AS z{g}' for g in range(groups))} FROM r GROUP BY ALL),
    q AS (SELECT release, k, count(*) AS tasks, sum(passes) AS truth, count(*) FILTER (NOT dead) AS open, {', '.join(f'sum(z{g}) AS z{g}' for g in range(groups))} FROM w GROUP BY ALL),
    m AS (SELECT release, k, mask, count(*) AS n FROM w WHERE NOT dead GROUP BY ALL), a AS (SELECT CAST(x AS INTEGER) AS sub FROM (SELECT unnest(range({1 << groups})) AS x)),
    hit AS (SELECT release, k, a.sub, sum(n) AS n FROM m JOIN a ON (mask & a.sub) <> 0 GROUP BY ALL),
    hall AS (SELECT q.release, q.k, tasks, truth, open - min({outside} + coalesce(hit.n, 0)) AS least
        FROM q CROSS JOIN a LEFT JOIN hit ON hit.release = q.release AND hit.k = q.k AND hit.sub = a.sub GROUP BY q.release, q.k, tasks, truth, open)"""


_D1 = _released("prediction * 3 + list_position(['A', 'N', 'R'], category) - 1", GROUPS)
_BIG = lambda *cs: ", ".join(f"CAST({c} AS BIGINT) AS {n}" for c, n in cs)


@query("sharp_ranges", chunked=True)
def sharp_ranges(frame: DataFrame) -> DataFrame:
    """Fewest and most tasks that can pass, of each release and size, given totals by size, predicted bit and category and what is shown.

    Both are attained: low and high are the passes of assignments that hold all totals and shown bits. proven: the search for the
    maximum was not ended, so nothing above it can be reached.
    """
    found = ranges(frame)
    return found.select("release", "k", "tasks", "truth", F.col("low_passes").alias("low"), F.col("high_passes").alias("high"), (F.col("high_passes") == F.col("bound")).alias("proven"))


@query("witness_check", f"{_D1} SELECT release, k, {_BIG(('tasks', 'tasks'), ('truth', 'truth'), ('least', 'low_passes'), ('0', 'broken_totals'), ('0', 'broken_links'), ('0', 'most_missed'))}, true AS holds_truth FROM hall", chunked=True)
def witness_check(frame: DataFrame) -> DataFrame:
    """Assignments of both extremes held against the release, from their bits: group totals, shown bits, conjunctions and the truth.

    low_passes is counted from the bits of the assignment; the SQL finds it by Hall's theorem. most_missed is what the other
    assignment lacks of the proven maximum.
    """
    found = ranges(frame)
    holds = (F.col("low_passes") <= F.col("truth")) & (F.col("truth") <= F.col("high_passes"))
    missed = F.col("bound") - F.col("high_passes")
    return found.select("release", "k", "tasks", "truth", "low_passes", "broken_totals", F.col("broken_links").cast("long").alias("broken_links"), missed.alias("most_missed"), holds.alias("holds_truth"))


@query("witness_totals", f"{_D1} SELECT release, k, g, {_BIG(('count(*)', 'slots'), ('sum(gold)', 'low'), ('sum(gold)', 'high'), ('count(*) FILTER (shown)', 'shown'), ('coalesce(sum(gold) FILTER (shown), 0)', 'shown_low'), ('coalesce(sum(gold) FILTER (shown), 0)', 'shown_high'))} FROM r GROUP BY release, k, g", chunked=True)
def witness_totals(frame: DataFrame) -> DataFrame:
    """Totals of the assignments' bits in each group and over what is shown; the SQL has the reference's, which they must keep."""
    if "chunk" in frame.columns:
        return summed(frame)[0].where("g >= 0").select("release", "k", "g", "slots", "low", "high", "shown", "shown_low", "shown_high")
    slots, groups = slots_of(frame)
    slots = stored(slots, "released")
    tasks = stored(bounds.typed(slots, groups), "released-tasks")
    bits = bounds.witnesses(slots, tasks, bounds.plan(tasks, groups))
    told = lambda c: F.sum(F.when(F.col("shown"), F.col(c)).otherwise(0)).cast("long")
    return bits.groupBy("release", "k", "g").agg(F.count("*").alias("slots"), F.sum("low").cast("long").alias("low"), F.sum("high").cast("long").alias("high"), F.count_if("shown").alias("shown"), told("low").alias("shown_low"), told("high").alias("shown_high"))


_RANKED = f"""o AS (SELECT task_id, ord, row_number() OVER (PARTITION BY ord ORDER BY sha256('shown|' || ord || '|' || task_id), task_id) - 1 AS r FROM tasks, (SELECT unnest(range(1, {len(ORDERS) + 1})) AS ord)),
    rd AS (SELECT 'd1 0 0' AS release, task_id, false AS shown FROM tasks UNION ALL SELECT 'd2 ' || ord || ' ' || s, task_id, r < s * (SELECT count(*) FROM tasks) // 100 FROM o, (SELECT unnest({list(STEPS)}) AS s))"""


def _hall(source: str, groups: int, name: str) -> str:
    """The fewest passes of releases, summed over sizes, from slots (release, task_id, k, gold, g, shown)."""
    outside = " + ".join(f"CASE WHEN (a.sub & {1 << g}) = 0 THEN z{g} ELSE 0 END" for g in range(groups))
    return f"""{name}_w AS (SELECT release, task_id, k, min(gold) AS passes, bool_or(shown AND gold = 0) AS dead, coalesce(bit_or(CASE WHEN shown THEN 0 ELSE 1 << g END), 0) AS mask,
        {', '.join(f'count(*) FILTER (NOT shown AND g = {g} AND gold = 0) AS z{g}' for g in range(groups))} FROM {source} GROUP BY ALL),
    {name}_q AS (SELECT release, k, count(*) AS tasks, sum(passes) AS truth, count(*) FILTER (NOT dead) AS open, {', '.join(f'sum(z{g}) AS z{g}' for g in range(groups))} FROM {name}_w GROUP BY ALL),
    {name}_m AS (SELECT release, k, mask, count(*) AS n FROM {name}_w WHERE NOT dead GROUP BY ALL), {name}_a AS (SELECT CAST(x AS INTEGER) AS sub FROM (SELECT unnest(range({1 << groups})) AS x)),
    {name}_h AS (SELECT release, k, a.sub, sum(n) AS n FROM {name}_m JOIN {name}_a a ON (mask & a.sub) <> 0 GROUP BY ALL),
    {name}_k AS (SELECT q.release, q.k, tasks, truth, open - min({outside} + coalesce(h.n, 0)) AS least FROM {name}_q q CROSS JOIN {name}_a a LEFT JOIN {name}_h h ON h.release = q.release AND h.k = q.k AND h.sub = a.sub GROUP BY q.release, q.k, tasks, truth, open),
    {name} AS (SELECT release, sum(tasks) AS tasks, sum(truth) AS truth, sum(least) AS least FROM {name}_k GROUP BY 1)"""


@query("disclosure_nesting", f""", {_RANKED}, z AS (SELECT c.task_id, c.slot, k, gold, prediction, category FROM crit c JOIN tasks t ON c.task_id = t.task_id), s0 AS (SELECT 'd0 0 0' AS release, task_id, k, gold, prediction AS g, false AS shown FROM z),
    s1 AS (SELECT rd.release, z.task_id, k, gold, CAST(prediction * 3 + list_position(['A', 'N', 'R'], category) - 1 AS INTEGER) AS g, shown FROM z JOIN rd ON z.task_id = rd.task_id), {_hall('s0', 2, 'h0')}, {_hall('s1', GROUPS, 'h1')}
    SELECT string_split(release, ' ')[1] AS stage, CAST(string_split(release, ' ')[2] AS INTEGER) AS ord, CAST(string_split(release, ' ')[3] AS INTEGER) AS share, {_BIG(('tasks', 'tasks'), ('truth', 'truth'), ('least', 'least'))}, true AS nested, true AS holds_truth, true AS proven FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1)""")
def disclosure_nesting(frame: DataFrame) -> DataFrame:
    """The ladder's releases with the fewest passes, and whether each range lies within that of the release that tells less.

    d1 lies within d0; in each order the smallest share lies within d1, every further one within the share before it.
    """
    rows = stored(ladder(frame), "ladder")
    base = rows.where("stage <> 'd2'").agg(*[F.max(F.when(F.col("stage") == s, F.col(c))).alias(f"{s}_{c}") for s in ("d0", "d1") for c in ("least", "most")])
    by = W.partitionBy("ord").orderBy("share")  # five releases an order
    rows = rows.crossJoin(F.broadcast(base))  # one row
    before = lambda c: F.when(F.col("stage") == "d2", F.coalesce(F.lag(c).over(by), F.col(f"d1_{c}"))).when(F.col("stage") == "d1", F.col(f"d0_{c}")).otherwise(F.col(c))
    rows = rows.withColumns({"low": before("least"), "high": before("most")})
    nested = (F.col("low") <= F.col("least")) & (F.col("most") <= F.col("high")) & (F.col("least") <= F.col("most"))
    holds = (F.col("least") <= F.col("truth")) & (F.col("truth") <= F.col("most"))
    return rows.select("stage", "ord", "share", "tasks", "truth", "least", nested.alias("nested"), holds.alias("holds_truth"), (F.col("bound") == F.col("most")).alias("proven"))
