"""Chat formatting by quotation linking. DataFrame functions only.

Quote levels of each line are parsed, quoted passages are normalised and hashed, hashes are joined to the messages that first said
them, and the links order each conversation by replies; what is left of a message has its quotes removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm import common
from tesserae.operators import ranking

#: Rounds of pointer doubling; 2**ROUNDS is more than any chain of replies is long.
ROUNDS = 48
#: Messages of a thread in one row of conversations().
PART = 256
_MARKS = r"^((?:[ \t]*>)*)"
_QUOTED = r"(?m)^[ \t]*>"


def _depth(line):
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def _said(line):
    """A line without its quote marks, lower-cased, all but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARKS, "")), r"[^\p{L}\p{N}]+", " "))


def _key(norm):
    return F.md5(norm.cast("binary"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Link quotes of messages (conv_id, turn, role, text) to their origins, and order conversations by replies.

    A line's quote level is the number of `>` marks before it. A passage is a run of lines of one level; it is looked up as a whole
    and line by line. The origin is the first turn of the same conversation, before this one, that has the same words as an own
    (unquoted) line or own text; without one, the first such message of all conversations, if it is before this one by (conv_id,
    turn). A message replies to the latest origin of its shallowest linked passages: in its own conversation if it has one there.

    Returns a row for each row of messages: conv_id, turn, role, n_passages, max_level, n_linked (passages with an origin),
    reply_conv, reply_turn (null if none), thread_conv, thread_turn (the message where its chain of replies starts), reply_depth,
    clean_text (the lines that aren't quotes), and position: its place, from 0, in the reply-ordered conversation of its thread, where
    every message comes after what it replies to (by reply_depth, conv_id, turn, role, clean_text). A thread is ordered by levels, so
    a long one isn't one task's. A very long text is one row's lines. An empty table gives no rows. Null text stays null and has no quotes; messages without a conv_id or turn keep null in thread_conv or
    thread_turn and position, and take no part in links; repeated rows get rows each, with the same links; further columns are ignored.
    """
    # numbered once and stored: a plan that is run again may number its rows otherwise
    rows = common.materialize(common.pick(messages, "conv_id", "turn", "role", "text").withColumn("row", F.monotonically_increasing_id()), "messages")
    quoting = rows.where(F.col("text").rlike(_QUOTED)).select("row", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    quoting = quoting.select("row", "conv_id", "turn", "line", _depth(F.col("raw")).alias("level"), _said(F.col("raw")).alias("norm"))
    by_line = W.partitionBy("row").orderBy("line")
    turned = F.when(F.coalesce(F.lag("level").over(by_line), F.lit(-1)) != F.col("level"), 1).otherwise(0)
    runs = quoting.withColumn("turned", turned).withColumn("passage", F.sum("turned").over(by_line)).where("level > 0")
    words = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("line", "norm"))), lambda x: x["norm"] != ""), lambda x: x["norm"]), " ")
    whole = runs.groupBy("row", "passage").agg(F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("level").alias("level"), words.alias("norm"))
    asked = runs.select("row", "passage", "conv_id", "turn", "level", "norm").unionByName(whole.select("row", "passage", "conv_id", "turn", "level", "norm"))
    passages = common.materialize(asked.where("norm <> ''").select("row", "passage", "conv_id", "turn", "level", _key(F.col("norm")).alias("key")).distinct(), "passages")
    counted = runs.groupBy("row").agg(F.countDistinct("passage").alias("n_passages"), F.max("level").alias("max_level"))

    own = F.filter(F.split("text", "\n"), lambda x: _depth(x) == 0)
    lines = F.filter(F.transform(own, lambda x: _said(x)), lambda x: x != "")
    known = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("text").isNotNull())
    keys = known.select("conv_id", "turn", lines.alias("lines")).select("conv_id", "turn", F.explode(F.array_distinct(F.array_append("lines", F.array_join("lines", " ")))).alias("norm"))
    # only what is quoted somewhere is indexed; the earliest message of each key is found before anything is joined back
    origins = keys.withColumn("key", _key(F.col("norm"))).join(passages.select("key").distinct(), "key", "left_semi")
    near = origins.groupBy("conv_id", "key").agg(F.min("turn").alias("near_turn"))
    far = near.groupBy("key").agg(F.min(F.struct("conv_id", "near_turn")).alias("far"))
    here = F.col("near_turn") < F.col("turn")
    there = F.struct("conv_id", F.col("turn").alias("near_turn")) > F.col("far")
    found = passages.join(near, ["conv_id", "key"], "left").withColumn("near_turn", F.when(here, F.col("near_turn")))
    found = found.join(far, "key", "left").withColumn("far", F.when(there & F.col("near_turn").isNull(), F.col("far")))
    origin = F.when(F.col("near_turn").isNotNull(), F.struct(F.lit(1).alias("near"), F.col("conv_id").alias("c"), F.col("near_turn").alias("t")))
    origin = origin.otherwise(F.when(F.col("far").isNotNull(), F.struct(F.lit(0).alias("near"), F.col("far.conv_id").alias("c"), F.col("far.near_turn").alias("t"))))
    links = found.withColumn("origin", origin).where("origin IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL")
    best = F.max(F.struct((-F.col("level")).alias("shallow"), "origin")).alias("best")
    replies = links.groupBy("row").agg(F.countDistinct("passage").alias("n_linked"), best)
    replies = replies.select("row", "n_linked", F.col("best.origin.c").alias("reply_conv"), F.col("best.origin.t").alias("reply_turn"))
    told = common.materialize(counted.join(replies, "row", "left"), "replies")

    clean = F.when(F.col("text").isNotNull(), F.trim(F.array_join(own, "\n")))
    out = rows.join(told, "row", "left").withColumn("clean_text", clean)
    step = out.where(F.col("reply_turn").isNotNull() & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    step = step.groupBy("conv_id", "turn").agg(F.max(F.struct("reply_conv", "reply_turn")).alias("up"), F.lit(1).cast("long").alias("depth"))
    chain = common.materialize(step, "chain-0")
    for n in range(1, ROUNDS):
        above = chain.select(F.col("conv_id").alias("up_c"), F.col("turn").alias("up_t"), F.col("up").alias("next"), F.col("depth").alias("more"))
        joined = chain.join(above, (F.col("up.reply_conv") == F.col("up_c")) & (F.col("up.reply_turn") == F.col("up_t")), "left")
        if joined.where("next IS NOT NULL").isEmpty():
            break
        if n == ROUNDS - 1:
            raise RuntimeError("replies go round in a circle")
        moved = joined.select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        chain = common.materialize(moved, f"chain-{n}")
    tops = chain.select("conv_id", "turn", F.col("up.reply_conv").alias("top_conv"), F.col("up.reply_turn").alias("top_turn"), "depth")
    out = out.join(tops, ["conv_id", "turn"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    told = out.select(
        "conv_id", "turn", "role",
        zero("n_passages").alias("n_passages"), zero("max_level").alias("max_level"), zero("n_linked").alias("n_linked"),
        "reply_conv", "reply_turn",
        F.coalesce("top_conv", "conv_id").alias("thread_conv"), F.coalesce("top_turn", "turn").alias("thread_turn"),
        zero("depth").alias("reply_depth"), "clean_text",
    )
    told = common.materialize(told, "told")
    placed = told.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    levels = [[F.col("reply_depth"), F.floor(F.col("conv_id") / (1 << 24))], [F.floor(F.col("conv_id") / (1 << 12))], [F.floor(F.col("turn") / (1 << 10))]]
    order = ["reply_depth", "conv_id", "turn", "role", "clean_text"]
    placed = ranking.global_offset(placed, levels, order, name="position", within=("thread_conv", "thread_turn"))
    return placed.unionByName(told.where("conv_id IS NULL OR turn IS NULL").withColumn("position", F.lit(None).cast("long")))


def conversations(linked: DataFrame) -> DataFrame:
    """From link_quotes(): thread_conv, thread_turn, part, and messages: role and text in reply order, without quotes.

    A part holds PART messages of a thread, so a thread of any length is rows of bounded size; parts follow each other. Messages
    without a conv_id or turn belong to no thread and are left out.
    """
    rows = linked.where("position IS NOT NULL").withColumn("part", F.floor(F.col("position") / PART))
    each = F.array_sort(F.collect_list(F.struct("position", "conv_id", "turn", "role", F.col("clean_text").alias("text"))))
    rows = rows.groupBy("thread_conv", "thread_turn", "part").agg(each.alias("messages"))
    return rows.withColumn("messages", F.transform("messages", lambda m: m.dropFields("position")))


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(common.table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, text, string_split(text, chr(10)) AS ls FROM conversations),
l0 AS (SELECT r, conv_id, turn, unnest(range(0, len(ls))) AS line, unnest(ls) AS raw FROM m WHERE text IS NOT NULL),
l AS (SELECT *, length(regexp_replace(regexp_extract(raw, '^((?:[ \t]*>)*)', 1), '[^>]', '', 'g')) AS level,
             trim(regexp_replace(lower(regexp_replace(raw, '^((?:[ \t]*>)*)', '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM l0),
q AS (SELECT *, sum(CASE WHEN level <> coalesce(before, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY line) AS passage
      FROM (SELECT *, lag(level) OVER (PARTITION BY r ORDER BY line) AS before FROM l)),
runs AS (SELECT * FROM q WHERE level > 0),
asked AS (SELECT r, passage, conv_id, turn, level, norm FROM runs WHERE norm <> ''
          UNION SELECT r, passage, any_value(conv_id), any_value(turn), any_value(level), string_agg(norm, ' ' ORDER BY line) FROM runs WHERE norm <> '' GROUP BY r, passage),
counted AS (SELECT r, count(DISTINCT passage) AS n_passages, max(level) AS max_level FROM runs GROUP BY r),
own AS (SELECT conv_id, turn, norm FROM l WHERE level = 0 AND norm <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL
        UNION SELECT any_value(conv_id), any_value(turn), string_agg(norm, ' ' ORDER BY line) FROM l
              WHERE level = 0 AND norm <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY r),
near AS (SELECT conv_id, norm, min(turn) AS near_turn FROM own GROUP BY 1, 2),
far AS (SELECT norm, min(ROW(conv_id, near_turn)) AS far FROM near GROUP BY 1),
found AS (SELECT a.*, CASE WHEN n.near_turn < a.turn THEN n.near_turn END AS nt, CASE WHEN f.far < ROW(a.conv_id, a.turn) THEN f.far END AS ft
          FROM asked a LEFT JOIN near n ON a.conv_id = n.conv_id AND a.norm = n.norm LEFT JOIN far f ON a.norm = f.norm),
links AS (SELECT r, passage, level, CASE WHEN nt IS NOT NULL THEN 1 ELSE 0 END AS near, CASE WHEN nt IS NOT NULL THEN conv_id ELSE ft[1] END AS c,
                 coalesce(nt, ft[2]) AS t FROM found WHERE (nt IS NOT NULL OR ft IS NOT NULL) AND conv_id IS NOT NULL AND turn IS NOT NULL),
replies AS (SELECT r, count(DISTINCT passage) AS n_linked, max(ROW(-level, near, c, t)) AS b FROM links GROUP BY r),
o AS (SELECT m.*, n_passages, max_level, n_linked, b[3] AS reply_conv, b[4] AS reply_turn FROM m LEFT JOIN counted USING (r) LEFT JOIN replies USING (r)),
step AS (SELECT conv_id, turn, max(ROW(reply_conv, reply_turn)) AS up FROM o WHERE reply_turn IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
chain(conv_id, turn, c, t, depth) AS (SELECT conv_id, turn, up[1], up[2], 1 FROM step
    UNION ALL SELECT chain.conv_id, chain.turn, s.up[1], s.up[2], depth + 1 FROM chain JOIN step s ON s.conv_id = chain.c AND s.turn = chain.t),
tops AS (SELECT conv_id, turn, max(ROW(depth, c, t)) AS b FROM chain GROUP BY 1, 2),
fin AS (SELECT o.conv_id, o.turn, o.role, CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages, CAST(coalesce(max_level, 0) AS BIGINT) AS max_level,
       CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, reply_conv, reply_turn, coalesce(b[2], o.conv_id) AS thread_conv, coalesce(b[3], o.turn) AS thread_turn,
       CAST(coalesce(b[1], 0) AS BIGINT) AS reply_depth,
       trim(array_to_string(list_filter(ls, lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10))) AS clean_text
FROM o LEFT JOIN tops ON o.conv_id = tops.conv_id AND o.turn = tops.turn)
SELECT *, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN row_number() OVER (PARTITION BY thread_conv, thread_turn ORDER BY reply_depth, conv_id, turn, role NULLS FIRST, clean_text NULLS FIRST) - 1 END AS position FROM fin
"""
