"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed of MIN_MATCH consecutive tokens (or a whole item of fewer) are tiled: the longest match of tokens that are in no
tile yet becomes a tile, again and again, found by running Karp-Rabin over windows of a falling search length. The share of an
item's tokens that lie in tiles is its coverage, whatever the order of its parts in the document.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common

MIN_MATCH = 5
COVERAGE = 0.8
SEARCH_LENGTH = 20
#: Benchmark tokens that are broadcast at once; a larger benchmark is taken in several passes over the documents.
PASS_TOKENS = 4_000_000
_U = np.uint64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:0x80] = 0x20
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)

#: Scripts that are written without spaces, as ranges of code points: Thai, Lao, Myanmar, Khmer, Tai, Balinese, kana, Bopomofo, Han, Yi, Javanese, ...
_UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF)]


@functools.cache
def _unicode() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: what it folds to (a space, or its lower case), whether its script has no spaces, whether it is a mark."""
    fold, mark, unspaced = np.full(1 << 21, 0x20, np.uint32), np.zeros(1 << 21, bool), np.zeros(1 << 21, bool)
    for c in [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE0200)]:
        kind = unicodedata.category(chr(c))[0]
        if kind in "LMN":
            low = chr(c).lower()
            fold[c], mark[c] = ord(low) if len(low) == 1 else c, kind == "M"
    for a, b in _UNSPACED:
        unspaced[a : b + 1] = True
    return fold, unspaced, mark


def _code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code points whose first bytes stand at `lead`."""
    out = data[lead].astype(np.uint32)
    for least, most, more, bits in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
        at = np.flatnonzero((out >= least) & (out < most) & (data[lead] >= 0xC0))
        value = data[lead[at]].astype(np.uint32) & np.uint32(bits)
        for k in range(1, more + 1):
            value = (value << np.uint32(6)) | (data[np.minimum(lead[at] + k, len(data) - 1)] & np.uint8(0x3F))
        out[at] = value | np.uint32(1 << 31)
    return out & np.uint32((1 << 31) - 1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and the index of each document's first one (len + 1).

    Tokens are runs of letters, digits and the marks on them, by Unicode class and in lower case. In scripts that are written without
    spaces each character, with its marks, is a token.
    """
    if not (data > 0x7F).any():
        folded = _FOLD[data]
        starts, ends, first = common.word_spans(folded, offsets)
        return common.word_hashes(folded, starts, ends), first
    fold, unspaced, mark = _unicode()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points, edges = _code_points(data, lead), np.searchsorted(lead, offsets)
    folded, alone = fold[points], unspaced[points]
    ink = folded != 0x20
    edge = np.zeros(len(points) + 1, bool)
    edge[edges] = True
    new = edge[:-1].copy()
    new[1:] |= ~ink[:-1] | ((alone[1:] | alone[:-1]) & ~mark[points[1:]])
    new &= ink
    new[:1] |= ink[:1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | new[1:]
    starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
    return common.word_hashes(folded, starts, ends), np.searchsorted(starts, edges)


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows without marked tokens."""
    if len(marked) < length:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(sums[length:] == sums[:-length])


class Running:
    """Karp-Rabin hashes of a token sequence: of windows of any length, by one running sum."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(tokens * common.powers(common.WORD_BASE, n), out=self.sums[1:])
        self.inverse = common.powers(common.WORD_INV, n + 1)

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[starts + length] - self.sums[starts]) * self.inverse[starts]


def longest(item: np.ndarray, text: np.ndarray, item_marked: np.ndarray, text_marked: np.ndarray, length: int, hashes: tuple[Running, Running] | None = None) -> tuple[int, int, int] | None:
    """The longest match (length, place in item, place in text) of unmarked tokens, of `length` tokens at least; the first of equals."""
    at_item, at_text = _free(item_marked, length), _free(text_marked, length)
    if not len(at_item) or not len(at_text):
        return None
    of_item, of_text = hashes or (Running(item), Running(text))
    h_item, h_text = of_item.at(at_item, length), of_text.at(at_text, length)
    ranked = np.sort(h_item)
    place = np.minimum(np.searchsorted(ranked, h_text), len(ranked) - 1)
    same = ranked[place] == h_text
    at_text, h_text = at_text[same], h_text[same]
    best = None
    if not len(at_text):
        return None
    by_hash = np.argsort(h_text, kind="stable")
    in_order = h_text[by_hash]
    for p, h in zip(at_item.tolist(), h_item, strict=True):
        if best and len(item) - p <= best[0]:
            continue
        t = at_text[by_hash[np.searchsorted(in_order, h) : np.searchsorted(in_order, h, "right")]]
        for k in range(length):  # a token at a time: many matches of one repeated token need no table of their windows
            t = t[text[t + k] == item[p + k]]
            if not len(t):
                break
        k = length
        while len(t) and p + k < len(item) and not item_marked[p + k]:
            inside = t[t + k < len(text)]
            more = inside[(text[inside + k] == item[p + k]) & ~text_marked[inside + k]]
            if not len(more):
                break
            t, k = more, k + 1
        if len(t) and (best is None or k > best[0]):
            best = (int(k), int(p), int(t[0]))
    return best


def coverage(item: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH, search: int = SEARCH_LENGTH) -> float:
    """Share of the item's tokens in tiles of min_match tokens or more."""
    item_marked, text_marked = np.zeros(len(item), bool), np.zeros(len(text), bool)
    length, hashes = max(min_match, min(search, len(item))), (Running(item), Running(text))
    while True:
        found = longest(item, text, item_marked, text_marked, length, hashes)
        if found:
            k, p, t = found
            item_marked[p : p + k] = True
            text_marked[t : t + k] = True
        elif length > min_match:
            length = max(min_match, length // 2)
        else:
            break
    return float(item_marked.mean()) if len(item) else 0.0


def _passes(benchmark: DataFrame) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Benchmark items (ids, token hashes), PASS_TOKENS at a time."""
    ids, kept, total = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL AND item_id IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        data = np.frombuffer(row["text"].encode("utf-8"), np.uint8)
        hashes, _ = tokens(data, np.array([0, len(data)]))
        if not len(hashes):
            continue
        ids.append(row["item_id"])
        kept.append(hashes)
        total += len(hashes)
        if total >= PASS_TOKENS:
            yield np.array(ids, np.int64), kept
            ids, kept, total = [], [], 0
    if ids:
        yield np.array(ids, np.int64), kept


class _Finder:
    """Finds (row, item id, coverage) in batches of texts, for one pass of benchmark items."""

    def __init__(self, ids: np.ndarray, items: list[np.ndarray], threshold: float):
        sizes = np.array([len(x) for x in items])
        self.ids, self.threshold = ids, threshold
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.every = np.concatenate(items)
        # tables of seeds (length, keys in order, places): those of MIN_MATCH tokens, and items of fewer tokens as a whole
        self.seeds = []
        for length in range(1, MIN_MATCH + 1):
            fit = np.repeat(sizes >= MIN_MATCH if length == MIN_MATCH else sizes == length, sizes)
            keys = common.mix(common.window_hashes(self.every, length))
            room = np.repeat(self.first[1:], sizes)[: len(keys)] - np.arange(len(keys))
            place = np.flatnonzero(fit[: len(keys)] & (room >= length))
            order = np.argsort(keys[place], kind="stable")
            if len(place):
                self.seeds.append((length, keys[place][order], place[order]))

    def __call__(self, texts) -> Iterator[tuple[int, int, float]]:
        tables = []
        for length, keys, places in self.seeds:
            bits = max(16, int(len(keys)).bit_length() + 4)
            sieve = np.zeros(1 << bits, bool)
            sieve[(keys >> _U(64 - bits)).astype(np.int64)] = True
            tables.append((length, keys, places, sieve, _U(64 - bits)))
        data, offsets = common.text_buffer(texts)
        for lo, hi in common.chunks_by_bytes(offsets):
            hashes, starts = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            for table in tables:
                for d, i, share in self._in_chunk(hashes, starts, *table):
                    yield lo + d, int(self.ids[i]), share

    def _in_chunk(self, hashes: np.ndarray, starts: np.ndarray, length: int, keys: np.ndarray, places: np.ndarray, sieve: np.ndarray, shift: np.uint64) -> Iterator[tuple[int, int, float]]:
        """(document, item, coverage) of a chunk's tokens, for the seeds of one length."""
        first, every = self.first, self.every
        grams = common.mix(common.window_hashes(hashes, length))
        at = np.flatnonzero(sieve[(grams >> shift).astype(np.int64)])
        at = at[keys[np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)] == grams[at]]
        doc = np.searchsorted(starts, at, "right") - 1
        ok = at + length <= starts[doc + 1]
        at, doc = at[ok], doc[ok]
        edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            d, (found, where) = int(doc[a]), np.unique(grams[at[a:b]], return_index=True)
            left, right = np.searchsorted(keys, found), np.searchsorted(keys, found, "right")
            seeds = np.concatenate([places[x:y] for x, y in zip(left, right, strict=True)])
            item = np.searchsorted(first, seeds, "right") - 1
            if length < MIN_MATCH:  # the seed is the whole item
                text = np.repeat(at[a:b][where], right - left)
                same = (every[seeds[:, None] + np.arange(length)] == hashes[text[:, None] + np.arange(length)]).all(1)
                yield from ((d, int(i), 1.0) for i in item[same])
                continue
            order = np.argsort(item, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else []
            for part in parts:
                i = int(item[part[0]])
                most = np.zeros(first[i + 1] - first[i] + MIN_MATCH, bool)
                for k in range(MIN_MATCH):
                    most[seeds[part] - first[i] + k] = True
                most = most[: first[i + 1] - first[i]]
                if most.mean() >= self.threshold:
                    share = coverage(every[first[i] : first[i + 1]], hashes[starts[d] : starts[d + 1]])
                    if share >= self.threshold:
                        yield d, int(i), share


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """Pairs of a document and a benchmark item whose coverage in it is at least threshold: doc_id, item_id, coverage.

    Null texts and items without tokens match nothing; an item of under MIN_MATCH tokens has to stand in the document as a whole; rows
    that repeat give pairs each; a null doc_id stays; empty tables give no rows; further columns are ignored; texts are read whole,
    however long; of equally long tiles the first in the item, then in the text, is taken. A pair is tiled only if the tokens of its
    shared seeds, which all tiles are made of, reach the threshold. Documents aren't shuffled. Items are broadcast PASS_TOKENS at a
    time; with several such passes each one's pairs are stored and its broadcast freed.
    """
    spark, schema, out = docs.sparkSession, "doc_id long, item_id long, coverage double", None
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    passes = _passes(benchmark)
    items = next(passes, None)
    while items is not None:
        shared = spark.sparkContext.broadcast(_Finder(*items, threshold))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(shared.value(batch.column(1)))
                doc_ids = batch.column(0).take(pa.array([r for r, _, _ in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array([i for _, i, _ in rows], pa.int64()), pa.array([c for _, _, c in rows], pa.float64())], ["doc_id", "item_id", "coverage"])

        part = source.mapInArrow(find, schema)
        items = next(passes, None)
        if out is not None or items is not None:
            part = common.materialize(part, "contaminated")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """The rows of docs, with all their columns, that contaminated() has no pair of. No shuffle.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark keeps all rows. With several passes over the
    benchmark the rows that each one leaves are stored.
    """
    columns, passes = docs.columns, _passes(benchmark)
    items, several = next(passes, None), False
    while items is not None:
        shared = docs.sparkSession.sparkContext.broadcast(_Finder(*items, threshold))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for row, _, _ in shared.value(batch.column(columns.index("text"))):
                    good[row] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
        items = next(passes, None)
        several = several or items is not None
        if several:
            docs = common.materialize(docs, "uncontaminated")
            shared.unpersist()
    return docs


def op5_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
