"""Periodic runs of words by harmonic grids and longest common extensions.

A run of period p that is at least 4p words long holds four neighbouring points of the grid 0, p, 2p, ..., so every third pair of
neighbours (jp, (j+1)p) is enough to meet it: one of these pairs lies within the run. The common extension of such a pair forward
and backward gives the whole stretch of period p around it. Extensions are asked of suffix arrays of the words and of the reversed
words, with range minima over the common prefixes of neighbours in the array. A pair is only asked if four neighbouring grid points
around it hold the same word, as those within a run do; a text without such a pair has no run and needs no arrays.

Documents of a batch stand one after the other in one sequence in which no two documents share a symbol, so no extension leaves its
document. Words are compared by 64-bit hashes; beyond that everything is exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common

#: A run is at least so many words, and so many of its periods, long.
LEAST, TIMES = 6, 4
#: Pairs of the grid, and symbols of extensions, that are looked at together.
CELLS = 1 << 20
#: Neighbours of the array whose least common prefix is kept by blocks.
BLOCK = 16
_U = np.uint64


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes and the rank of each. Groups of equal beginnings are split at twice the length until all are single."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    at, h = np.flatnonzero(~(new & np.append(new[1:], True))), 1
    while len(at):
        i = order[at]
        ahead = np.where(i + h < n, rank[np.minimum(i + h, n - 1)] + 1, 0)
        key = rank[i] * (n + 1) + ahead
        by = np.argsort(key, kind="stable")
        i, key = i[by], key[by]
        order[at] = i
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[i] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[~(new & np.append(new[1:], True))]
        h *= 2
    return order, rank


def _equal_lengths(padded: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far the symbols from i and from j on agree, compared one by one; the last symbol of all is like no other."""
    last, out = len(padded) - 1, np.zeros(len(i), np.int64)
    for lo in range(0, len(i), CELLS // 8):
        live, width = np.arange(lo, min(len(i), lo + CELLS // 8)), 4
        while len(live):
            step = np.arange(width)
            same = padded[np.minimum((i[live] + out[live])[:, None] + step, last)] == padded[np.minimum((j[live] + out[live])[:, None] + step, last)]
            whole = same.all(1)
            out[live] += np.where(whole, width, same.argmin(1))
            live = live[whole]
            width = max(4, min(2 * width, CELLS // max(1, len(live))))
    return out


def neighbour_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix in the array with the one before it.

    In the order of the text a prefix is one shorter than the last one's if the symbols before both suffixes agree. Only the others
    are compared by symbols; these sum up to O(n log n).
    """
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.append(symbols, symbols.min(initial=0) - 1)
    i = np.arange(n)
    follows = (before > 0) & (i > 0)
    follows &= symbols[np.maximum(i - 1, 0)] == symbols[np.maximum(before - 1, 0)]
    known = np.flatnonzero(~follows & (before >= 0))
    prefix = np.zeros(n, np.int64)
    prefix[known] = _equal_lengths(padded, known, before[known])
    source = np.maximum.accumulate(np.where(follows, 0, i))
    prefix = np.where(follows, prefix[source] - (i - source), prefix)
    return prefix[order]


class RangeMinimum:
    """Least of values[lo..hi]: minima from both ends of blocks, and of 2**k blocks from each block on."""

    def __init__(self, values: np.ndarray):
        blocks = max(1, -(-len(values) // BLOCK))
        wide = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        wide[: len(values)] = values
        self.values = wide
        by_block = wide.reshape(blocks, BLOCK)
        self.head = np.minimum.accumulate(by_block, axis=1).ravel()
        self.tail = np.minimum.accumulate(by_block[:, ::-1], axis=1)[:, ::-1].ravel()
        level, levels = by_block.min(1), []
        while True:
            levels.append(level)
            step = 1 << (len(levels) - 1)
            if len(level) <= step:
                break
            level = np.minimum(level[:-step], level[step:])
        self.levels = levels

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty(len(lo), np.int32)
        first, last = lo // BLOCK, hi // BLOCK
        within = np.flatnonzero(first == last)
        for a in range(0, len(within), CELLS // BLOCK):
            w = within[a : a + CELLS // BLOCK]
            place = lo[w][:, None] + np.arange(BLOCK)
            out[w] = np.where(place <= hi[w][:, None], self.values[np.minimum(place, hi[w][:, None])], np.iinfo(np.int32).max).min(1)
        across = np.flatnonzero(first != last)
        out[across] = np.minimum(self.tail[lo[across]], self.head[hi[across]])
        between = last - first - 1
        far = across[between[across] > 0]
        size = np.frexp(between[far].astype(np.float64))[1] - 1  # the largest power of two within
        for k in np.unique(size).tolist():
            f = far[size == k]
            level = self.levels[k]
            out[f] = np.minimum(out[f], np.minimum(level[first[f] + 1], level[last[f] - (1 << k)]))
        return out


class Extensions:
    """Longest common extensions of pairs of places of a sequence, in the direction of the sequence given."""

    def __init__(self, symbols: np.ndarray):
        order, self.rank = suffix_array(symbols)
        self.minimum = RangeMinimum(neighbour_prefixes(symbols, order))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.minimum.least(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def grid_pairs(symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, period) of the grid pairs (place, place + period) that can lie in a run.

    first, size: where each document's words stand in the sequence.
    """
    many_periods = np.where(size >= LEAST, size // TIMES, 0)
    total = np.concatenate([[0], np.cumsum(many_periods)])
    found = []
    lo, rows = 0, int(total[-1])
    while lo < rows:
        hi = min(rows, lo + CELLS // 4)
        row = np.arange(lo, hi)
        doc = np.searchsorted(total, row, "right") - 1
        period = row - total[doc] + 1
        pairs = ((size[doc] - 1) // period - 1) // 3 + 1
        ends = np.cumsum(pairs)
        take = max(1, int(np.searchsorted(ends, 4 * CELLS, "right")))
        doc, period, pairs, ends = doc[:take], period[:take], pairs[:take], ends[:take]
        for a, b in common.chunks_by_bytes(np.concatenate([[0], ends]), CELLS):
            # one period alone can have as many pairs as its document has words
            for skip in range(0, int(pairs[a:b].sum()), 4 * CELLS):
                n = min(int(pairs[a:b].sum()) - skip, 4 * CELLS)
                at = np.repeat(np.arange(a, b), pairs[a:b])[skip : skip + n]
                p = period[at]
                x = first[doc[at]] + 3 * p * (skip + np.arange(n) - (ends[at] - pairs[at] - (ends[a] - pairs[a])))
                word = symbols[x]
                hit = np.flatnonzero(word == symbols[x + p])
                found.append((doc[at[hit]], x[hit], p[hit]))
        lo += take
    if not found:
        return (np.zeros(0, np.int64),) * 3
    doc, x, p = (np.concatenate(c) for c in zip(*found, strict=True))
    start, end, word, n = first[doc], first[doc] + size[doc], symbols[x], len(symbols)
    like = lambda place: (place >= start) & (place < end) & (symbols[np.clip(place, 0, n - 1)] == word)
    left, right = like(x - p), like(x + 2 * p)
    points = 2 + left + (left & like(x - 2 * p)) + right + (right & like(x + 3 * p))
    keep = points >= 4
    return doc[keep], x[keep], p[keep]


def find_runs(symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start, period. No two documents may share a symbol."""
    doc, place, period = grid_pairs(symbols, first, size)
    if not len(doc):
        return (np.zeros(0, np.int64),) * 4
    some, which = np.unique(doc, return_inverse=True)
    sub_size = size[some]
    sub_first = np.concatenate([[0], np.cumsum(sub_size)[:-1]])
    part = np.concatenate([symbols[first[d] : first[d] + size[d]] for d in some.tolist()])
    i = place - first[doc] + sub_first[which]
    j = i + period
    n = len(part)
    forward = Extensions(part).of(i, j)
    backward = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    if len(inner):
        backward[inner] = Extensions(part[::-1].copy()).of(n - i[inner], n - j[inner])
    start, length = i - backward, period + forward + backward
    good = np.flatnonzero(length >= np.maximum(LEAST, TIMES * period))
    which, start, length, period = which[good], start[good], length[good], period[good]
    # a stretch has its smallest period only where no smaller one spans it
    order = np.lexsort((period, start + length, start))
    start, length, period, which = start[order], length[order], period[order], which[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period, which = start[new], length[new], period[new], which[new]
    order = np.lexsort((period, start))
    return some[which[order]], (start - sub_first[which])[order], length[order], period[order]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("kept", pa.binary())])
Rewrite = Callable[[int | None, int], np.ndarray | None]


def _chunk(ids: list, data: np.ndarray, offsets: np.ndarray, rewrite: Rewrite | None) -> pa.RecordBatch:
    starts, ends, index = common.word_spans(data, offsets)
    size = np.diff(index)
    first = index[:-1]
    hashes = common.word_hashes(data, starts, ends)
    order = np.arange(len(starts))
    changed = {}
    if rewrite is not None:
        for d in np.flatnonzero(size).tolist():
            new = rewrite(ids[d], int(size[d]))
            if new is not None:
                changed[d] = new
                order[first[d] : first[d] + size[d]] = first[d] + new
    salt = common.mix(np.repeat(np.arange(len(size), dtype=_U) + _U(1), size))
    symbols = np.unique(common.mix(hashes[order] ^ salt), return_inverse=True)[1].astype(np.int64)
    doc, start, length, period = find_runs(symbols, first, size)
    bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
    kept = []
    for d in range(len(ids)):
        words = data[offsets[d] : offsets[d + 1]].tobytes().split()  # parts at the same six bytes
        lo, hi = bounds[d], bounds[d + 1]
        if d in changed:
            words = [words[w] for w in changed[d].tolist()]
        if hi > lo:
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, start[lo:hi] + period[lo:hi], 1)
            np.add.at(change, start[lo:hi] + length[lo:hi], -1)
            words = [words[w] for w in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        kept.append(b" ".join(words))
    runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], fields=list(RUN)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), runs, pa.array(kept, pa.binary())], schema=RESULT)


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """Runs of consecutive words, and the text that stays when each run keeps its first period only.

    Words are `[^\\x20\\x09-\\x0D]+`. A run has smallest period q (words q apart are identical), at least max(6, 4q) words, and no
    neighbouring word that keeps the period. rewrite(doc_id, n) may give the word numbers that stand for a document's n words; None
    leaves them as they are. Returns for each row doc_id, n_words, runs (start, length, period; by start, then period) and kept (the
    words in no run after its first q words, joined by one space, as UTF-8).

    A null text has no words and no runs; a null doc_id stays, and rewrite gets None; repeated rows are judged each; an empty table
    gives no rows; further columns are ignored. Documents are judged by themselves, so there is no shuffle. A text is read whole,
    with some 120 bytes of memory a word where it has repeats; a batch holds texts of a megabyte, a longer one stands alone.
    """

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = common.text_buffer(batch.column(1))
            for lo, hi in common.chunks_by_bytes(offsets):
                begin = int(offsets[lo])
                yield _chunk(ids[lo:hi], data[begin : offsets[hi]], offsets[lo : hi + 1] - begin, rewrite)

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept binary"
    return docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text")).mapInArrow(call, schema)


def repeat_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's rewriting: where crc32 of the id is a multiple of ten, the words from a on repeat with period p."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every whole document after the contract's rewriting, as digests. Nulls, ties and repeats as in periodic_runs()."""
    found = periodic_runs(common.table(spark, sf_dir, "documents"), repeat_tail)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    # by start, then period: of equal exponents the first one stays
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * best.length) div best.period")
    return out.select("doc_id", "n_runs", *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")], exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
