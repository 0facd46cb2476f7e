"""Ranked lexical search with trees of maxima over document ranges.

Documents are indexed in segments of bounded size, ordered by their length, so that neighbours have like scores. A term's tree holds
its largest contribution in each range of LEAF documents, in each FAN of these, and so on up to the whole segment. A query's bound
for a range is the weighted sum of its terms' maxima there. Ranges are opened by falling bound: an inner one puts the bounds of its
parts on the heap, a leaf is scored. The search of a segment ends when the highest bound is below the k-th best score so far; ranges
with just that bound are still opened, as a document in them may tie with a smaller id. A task carries its k-th scores from segment
to segment, and the tasks' best are merged in two steps.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm import common

#: Most documents and postings of a segment.
SEGMENT_DOCS, SEGMENT_POSTINGS = 4096, 1 << 19
LEAF, FAN = 64, 8
#: Terms of queries that are broadcast at once, and those that a task takes at once.
QUERY_TERMS, BLOCK_TERMS = 1 << 20, 2048
#: Parts in which an item's results are first merged.
PARTS = 64
_U = np.uint64

#: Bytes that part terms: ASCII but digits and letters.
GAPS = np.zeros(256, bool)
GAPS[:128] = [not chr(b).isalnum() for b in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each term of the texts, and the index of each text's first one (len + 1)."""
    data = LOWER[data]
    starts, ends, index = common.word_spans(data, offsets, GAPS)
    return common.word_hashes(data, starts, ends), index


# ---------------------------------------------------------------- index

SEGMENT = "n_docs long, n_terms long, ids binary, known binary, sizes binary, terms binary, df binary, docs binary, tf binary"
_SEGMENT = pa.schema([(n, pa.int64()) for n in ("n_docs", "n_terms")] + [(n, pa.binary()) for n in ("ids", "known", "sizes", "terms", "df", "docs", "tf")])


class _Segment:
    """Documents and postings that are collected until they make a segment."""

    def __init__(self):
        self.ids, self.known, self.sizes, self.postings, self.held, self.n = [], [], [], [], 0, 0

    def add(self, ids, known, sizes, term, doc, tf) -> None:
        self.postings.append((term, doc + self.n, tf))
        self.ids.append(ids), self.known.append(known), self.sizes.append(sizes)
        self.n, self.held = self.n + len(ids), self.held + len(term)

    def row(self) -> pa.RecordBatch:
        ids, known, sizes = (np.concatenate(c) for c in (self.ids, self.known, self.sizes))
        term, doc, tf = (np.concatenate(c) for c in zip(*self.postings, strict=True))
        order = np.lexsort((ids, sizes))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = place[doc]
        by = np.lexsort((doc, term))
        distinct, df = np.unique(term, return_counts=True)
        columns = [ids[order], known[order], sizes[order], distinct.astype(np.int32), df.astype(np.int32), doc[by].astype(np.int32), tf[by].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([self.n]), pa.array([int(sizes.sum())])] + [pa.array([c.tobytes()], pa.binary()) for c in columns], schema=_SEGMENT)


def _index(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    segment = _Segment()
    for batch in batches:
        known = np.asarray(batch.column(0).is_valid())
        ids = np.asarray(batch.column(0).fill_null(0), np.int64)
        data, offsets = common.text_buffer(batch.column(1))
        for lo, hi in common.chunks_by_bytes(offsets):
            for a in range(lo, hi, SEGMENT_DOCS):
                b = min(hi, a + SEGMENT_DOCS)
                hashes, index = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sizes = np.diff(index)
                some = np.flatnonzero(sizes)  # texts without a term don't count
                if not len(some):
                    continue
                doc = np.repeat(np.arange(len(some)), sizes[some])
                at = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
                hit = np.flatnonzero(vocabulary[at] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
                key, tf = np.unique(at[hit] * len(some) + doc[hit], return_counts=True)
                if segment.n and (segment.n + len(some) > SEGMENT_DOCS or segment.held + len(key) > SEGMENT_POSTINGS):
                    yield segment.row()
                    segment = _Segment()
                segment.add(ids[a:b][some], known[a:b][some], sizes[some].astype(np.int64), key // len(some), key % len(some), tf)
    if segment.n:
        yield segment.row()


#: Term numbers under which the counts of documents and of all their terms are summed along with document frequencies.
_DOCS, _TERMS = -1, -2


def _frequencies(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    df, docs, total = np.zeros(width, np.int64), 0, 0
    for batch in batches:
        for n, m, t, f in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            docs, total = docs + n, total + m
            df[np.frombuffer(t, np.int32)] += np.frombuffer(f, np.int32)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [_DOCS, _TERMS]), pa.int64()), pa.array(np.append(df[at], [docs, total]), pa.int64())], ["term", "n"])


# ---------------------------------------------------------------- search


class Ranges:
    """A segment's contributions for some terms: a row for each term, and the maxima of ranges of documents, level by level."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, dense: np.ndarray):
        self.ids, self.known, self.dense = ids, known, dense
        level = self._maxima(dense, LEAF)
        self.levels = [level]
        while level.shape[1] > 1:
            level = self._maxima(level, FAN)
            self.levels.append(level)

    @staticmethod
    def _maxima(rows: np.ndarray, width: int) -> np.ndarray:
        n = -(-rows.shape[1] // width)
        wide = np.zeros((rows.shape[0], n * width), rows.dtype)
        wide[:, : rows.shape[1]] = rows
        return wide.reshape(rows.shape[0], n, width).max(2)

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int, have: tuple) -> tuple:
        """The k best (ids, known, scores) of this segment and of those a query has already, and how many leaves were scored."""
        ids, known, scores = have
        least = max(1, int(scores[k - 1])) if len(scores) >= k else 1
        top = len(self.levels) - 1
        heap, opened = [(-int(weights @ self.levels[top][rows, 0]), top, 0)], 0
        while heap:
            bound, level, node = heapq.heappop(heap)
            if -bound < least:
                break
            if level:
                lo = node * FAN
                bounds = weights @ self.levels[level - 1][rows, lo : lo + FAN]
                for child in np.flatnonzero(bounds >= least).tolist():
                    heapq.heappush(heap, (-int(bounds[child]), level - 1, lo + child))
                continue
            opened += 1
            lo = node * LEAF
            score = weights @ self.dense[rows, lo : lo + LEAF]
            good = np.flatnonzero(score >= least)
            if len(good):
                ids, known, scores = np.concatenate([ids, self.ids[lo + good]]), np.concatenate([known, self.known[lo + good]]), np.concatenate([scores, score[good]])
                best = np.lexsort((ids, ~known, -scores))[:k]
                ids, known, scores = ids[best], known[best], scores[best]
                if len(scores) >= k:
                    least = max(least, int(scores[k - 1]))
        return ids, known, scores, opened


class _Queries:
    """A block of items: their terms as numbers of the vocabulary, in blocks of at most BLOCK_TERMS different ones if they can be."""

    def __init__(self, items: list[np.ndarray], width: int):
        self.items, self.width, self.weights, self.blocks = items, width, np.zeros(width, np.int64), []
        seen: set[int] = set()
        for number, t in enumerate(items):
            new = set(t.tolist())
            if not self.blocks or len(seen | new) > BLOCK_TERMS:
                self.blocks.append([])
                seen = set()
            seen |= new
            self.blocks[-1].append(number)

    def search(self, batches: Iterator[pa.RecordBatch], docs: int, total: int, k: int) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        have = [nothing] * len(self.items)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, tf = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in (0, 2, 6))
                known = np.frombuffer(batch.column(1)[row].as_buffer(), bool)
                term, df, doc = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int32) for c in (3, 4, 5))
                m = 100 - 50 + (50 * sizes * docs) // total
                part = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
                first = np.concatenate([[0], np.cumsum(df, dtype=np.int64)])
                for block in self.blocks:
                    wanted = np.unique(np.concatenate([self.items[i] for i in block]))
                    wanted = wanted[self.weights[wanted] > 0]
                    at = np.searchsorted(term, wanted)
                    there = (at < len(term)) & (term[np.minimum(at, max(0, len(term) - 1))] == wanted) if len(term) else np.zeros(len(wanted), bool)
                    wanted, at = wanted[there], at[there]
                    if not len(wanted):
                        continue
                    dense = np.zeros((len(wanted), len(ids)), np.int32)
                    for r, a in enumerate(at.tolist()):
                        dense[r, doc[first[a] : first[a + 1]]] = part[first[a] : first[a + 1]]
                    ranges = Ranges(ids, known, dense)
                    for i in block:
                        place = np.searchsorted(wanted, self.items[i])
                        rows = place[(place < len(wanted)) & (wanted[np.minimum(place, len(wanted) - 1)] == self.items[i])]
                        if len(rows):
                            have[i] = ranges.search(rows, self.weights[wanted[rows]], k, have[i])[:3]
        sizes = [len(h[2]) for h in have]
        if sum(sizes):
            ids, known, scores = (np.concatenate(c) for c in zip(*have, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(have)), sizes), pa.int64()), pa.array(ids, pa.int64(), mask=~known), pa.array(scores, pa.int64())], ["number", "doc_id", "score"])


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[np.ndarray], np.ndarray]]:
    """Item ids, the numbers of each one's terms in the vocabulary, and the vocabulary, some QUERY_TERMS terms at a time."""

    def whole():
        vocabulary = np.unique(np.concatenate(lists)) if lists else np.zeros(0, _U)
        return ids, [np.searchsorted(vocabulary, t) for t in lists], vocabulary

    ids, lists, held = [], [], 0
    for r in items.where("text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        data = np.frombuffer(r["text"].encode(), np.uint8)
        t = np.unique(terms(data, np.array([0, len(data)]))[0])
        if len(t):
            ids.append(r["item_id"]), lists.append(t)
            held += len(t)
            if held >= QUERY_TERMS:
                yield whole()
                ids, lists, held = [], [], 0
    if ids:
        yield whole()


def weight(docs: int, df: int) -> int:
    """floor(1000 * ln((2N + 2) / (2df + 1))), in doubles."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def rank(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Each item's k documents of highest score, exactly: item_id, rank (from 1), doc_id, score; equal scores by ascending doc_id.

    Terms are runs of ASCII letters and digits and of all other non-ASCII characters, only A-Z lower-cased, compared by 64-bit hashes.
    N counts the documents with a term, L all their terms, n one document's, df the documents with a term, tf its occurrences. The
    score sums, over the item's distinct terms, floor(1000 ln((2N+2)/(2df+1))) times (10^9 tf) div (1000 tf + 20 m), where m is
    50 + (50 n N) div L. Documents without a positive score are not returned.

    Null and empty texts hold no term: such documents don't count, such items have no rows. Documents without an id count and may be
    returned, after others of their score. Repeated documents count each; repeated items once; different texts of one item id are
    items of their own, each with its ranks. Empty tables give no rows, further columns are ignored, texts are read whole.

    Items are broadcast some QUERY_TERMS terms at a time; with each such block goes an index of its terms, stored once and read for
    the frequencies and for the search. A segment and its trees are of bounded size, so a task's memory grows with its longest text only.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    items = common.pick(items, "item_id", "text")
    blocks, out, kind = _blocks(items), None, items.schema["item_id"].dataType.simpleString()
    block = next(blocks, None)
    while block is not None:
        ids, lists, vocabulary = block
        shared, width = spark.sparkContext.broadcast(vocabulary), len(vocabulary)

        def index(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from _index(batches, shared.value)

        def frequencies(batches: Iterator[pa.RecordBatch], width=width) -> Iterator[pa.RecordBatch]:
            yield from _frequencies(batches, width)

        segments = common.materialize(docs.mapInArrow(index, SEGMENT), "segments")
        shared.unpersist()
        counted = segments.select("n_docs", "n_terms", "terms", "df").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counts = {r["term"]: r["n"] for r in counted.collect()}  # at most one for each term of the block, and two
        n_docs, n_terms = counts.pop(_DOCS, 0), counts.pop(_TERMS, 0)
        queries = _Queries(lists, width)
        for t, df in counts.items():
            queries.weights[t] = weight(n_docs, df)
        asked = spark.sparkContext.broadcast(queries)

        def search(batches: Iterator[pa.RecordBatch], asked=asked, n_docs=n_docs, n_terms=n_terms) -> Iterator[pa.RecordBatch]:
            yield from asked.value.search(batches, n_docs, n_terms, k)

        met = segments.select("ids", "known", "sizes", "terms", "df", "docs", "tf").mapInArrow(search, "number long, doc_id long, score long")
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        met = met.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
        met = met.withColumn("rank", F.row_number().over(W.partitionBy("number", "part").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "part")
        met = met.withColumn("rank", F.row_number().over(W.partitionBy("number").orderBy(*order)).cast("int")).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"number long, item_id {kind}")
        part = met.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")  # at most QUERY_TERMS items
        block = next(blocks, None)
        if out is not None or block is not None:
            part = common.materialize(part, "ranked")
            asked.unpersist()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item. Nulls, ties and repeats as in rank()."""
    return rank(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH t AS (SELECT doc_id, {_TERMS_SQL} AS terms FROM documents),
d AS (SELECT doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM t WHERE len(terms) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d),
p AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d) GROUP BY 1, 2, 3),
f AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY 1),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, s),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark)),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY 1, 2),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
