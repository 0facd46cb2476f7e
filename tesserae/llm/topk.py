"""Exact top-k by inner product of quantised vectors, with MaxScore.

A query's terms are its dimensions. The posting of a term holds what each vector of a shard contributes on it, counted from the least
contribution there is, so that contributions are never negative; the largest is the term's score bound. Postings are taken from the
largest bound down. The last ones, whose bounds together can't lift a vector over the k-th best score so far, are non-essential: they
are only probed, one after the other, for the vectors that are still competitive; so are essential ones for which the sum of what is
left has become too small. Queries are broadcast in blocks of bounded size, vectors stay where they are; a task takes its vectors shard
by shard and carries the k-th scores on, and the tasks' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm import common

SHARD_ROWS = 8192
#: Components of queries that are broadcast at once (8 bytes each).
QUERY_CELLS = 1 << 20
#: Postings that are taken between two looks at who is still competitive.
STRIDE = 8
#: Vectors from the heads of the first postings that give a first k-th score.
HEAD = 32


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component. Null vectors and those with null or non-finite components are left out."""
    c = F.col(f"`{vector_col}`")
    sound = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(c, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.where(c.isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), q.alias("q"))


class Shard:
    """Postings of a shard: a row of contributions for each dimension, and the vectors with the most extreme ones."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.width = ids, vectors.shape[1]
        self.rows = np.ascontiguousarray(vectors.T)
        self.high, self.low = (self.rows.max(1), self.rows.min(1)) if len(ids) else (np.zeros(self.width, np.int64),) * 2
        head = min(HEAD, len(ids))
        order = np.argpartition(self.rows, (head - 1, len(ids) - head), axis=1) if self.width and len(ids) else np.zeros((self.width, 0), np.int64)
        self.heads = order[:, :head], order[:, len(ids) - head :]


def best(query_id: int, query: np.ndarray, shard: Shard, k: int, have: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (vec_id, score) of a shard and of those a query has already, and how many entries of postings were read."""
    ids, scores = (np.zeros(0, np.int64), np.zeros(0, np.int64)) if have is None else have
    n = len(shard.ids)
    if n == 0:
        return ids, scores, 0
    ends = np.stack([query * shard.low, query * shard.high])
    least, bound = ends.min(0), ends.max(0) - ends.min(0)
    base = int(least.sum())
    order = np.argsort(-bound, kind="stable")
    # rest[j]: what the postings from the j-th on can still add
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])
    kth = int(scores[k - 1]) if len(scores) >= k else None
    if kth is None and n > 4 * k:
        # the heads of the first postings hold likely winners, whose exact scores give a first k-th score
        some = np.unique(np.concatenate([shard.heads[1 if query[t] > 0 else 0][t] for t in order[: max(1, 2 * k // HEAD + 2)]]))
        some = some[shard.ids[some] != query_id]
        if len(some) >= k:
            kth = int(np.partition(query @ shard.rows[:, some], len(some) - k)[len(some) - k])
    alive, partial, read = np.flatnonzero(shard.ids != query_id), None, 0
    for j in range(0, shard.width, STRIDE):
        terms = order[j : j + STRIDE]
        part = shard.rows[terms] if len(alive) == n else shard.rows[np.ix_(terms, alive)]
        more = query[terms] @ part - int(least[terms].sum())
        partial = more if partial is None else partial + more
        read += len(terms) * len(alive)
        if kth is not None:
            keep = np.flatnonzero(partial + rest[min(j + STRIDE, shard.width)] >= kth - base)
            if len(keep) < len(alive):
                alive, partial = alive[keep], partial[keep]
    score = (partial if partial is not None else np.zeros(len(alive), np.int64)) + base
    ids, scores = np.concatenate([ids, shard.ids[alive]]), np.concatenate([scores, score])
    top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top], read


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


class _Queries:
    """A block of queries by the length of their vectors: their numbers in the block, ids and vectors."""

    def __init__(self, rows: list):
        by_width: dict[int, list] = {}
        for number, r in enumerate(rows):
            by_width.setdefault(len(r["q"]), []).append((number, r["vec_id"], r["q"]))
        self.groups = {w: (np.array([x[0] for x in g]), np.array([x[1] for x in g], np.int64), np.array([x[2] for x in g], np.int64).reshape(len(g), w)) for w, g in by_width.items()}

    def search(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {w: [] for w in self.groups}
        held = dict.fromkeys(waiting, 0)
        have: dict[int, list] = {w: [None] * len(g[0]) for w, g in self.groups.items()}

        def take(width: int) -> None:
            ids, vectors = (np.concatenate(x) for x in zip(*waiting[width], strict=True))
            waiting[width], held[width] = [], 0
            _, query_ids, queries = self.groups[width]
            most = int(abs(queries).max(initial=0)) * int(abs(vectors).max(initial=0)) * max(1, width)
            if most >= 1 << 61:
                raise OverflowError("inner products of these vectors don't fit 64 bits")
            for lo in range(0, len(ids), SHARD_ROWS):
                shard = Shard(ids[lo : lo + SHARD_ROWS], vectors[lo : lo + SHARD_ROWS])
                for i, (query_id, query) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
                    have[width][i] = best(query_id, query, shard, k, have[width][i])[:2]

        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths(), np.int64)
            for width in np.unique(sizes).tolist():
                if width in self.groups:
                    at = pa.array(np.flatnonzero(sizes == width))
                    waiting[width].append((np.asarray(batch.column(0).take(at), np.int64), _matrix(batch.column(1).take(at), width)))
                    held[width] += len(at)
                    if held[width] >= SHARD_ROWS:
                        take(width)
        for width in waiting:
            if waiting[width]:
                take(width)
        for width, (numbers, query_ids, _) in self.groups.items():
            found = [(q, n, *h) for q, n, h in zip(query_ids.tolist(), numbers.tolist(), have[width], strict=True) if h is not None]
            if found:
                sizes = [len(f[2]) for f in found]
                columns = [np.repeat([f[0] for f in found], sizes), np.repeat([f[1] for f in found], sizes), np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "number", "vec_id", "score"])


def _blocks(queries: DataFrame) -> Iterator[list]:
    """Distinct queries in order, some QUERY_CELLS components at a time."""
    rows, cells = [], 0
    for r in queries.where("vec_id IS NOT NULL").select("vec_id", "q").distinct().orderBy("vec_id", "q").toLocalIterator():
        rows.append(r)
        cells += len(r["q"]) + 1
        if cells >= QUERY_CELLS:
            yield rows
            rows, cells = [], 0
    if rows:
        yield rows


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """For each query row (vec_id, q) its k highest integer inner products with the rows of vectors (vec_id, q), exactly.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; rows with the query's own id are no candidates;
    fewer candidates give fewer rows, an empty table none. Only vectors of a query's length are candidates. Rows with a null id take no
    part; repeated query rows count once, different vectors of one query id are queries of their own, each with its ranks; repeated
    candidate rows count each. Products that could pass 64 bits are an error. A query block and a shard are of bounded size, so a task's
    memory doesn't grow with the tables; with several blocks each one's result is stored and its broadcast freed.
    """
    spark = vectors.sparkSession
    vectors = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", "q")
    blocks, out, schema = _blocks(queries), None, "query_id long, number long, vec_id long, score long"
    block = next(blocks, None)
    while block is not None:
        shared = spark.sparkContext.broadcast(_Queries(block))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from shared.value.search(batches, k)

        met = vectors.mapInArrow(search, schema)
        rank = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
        part = met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        block = next(blocks, None)
        if out is not None or block is not None:
            part = common.materialize(part, "top-k")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quantise(common.table(spark, sf_dir, "embeddings"))
    return top_k(q, q.where(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(range(1, len(q) + 1)) AS d, unnest(q) AS c FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.c * b.c) AS BIGINT) AS score FROM e a JOIN e b ON a.d = b.d
      WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
