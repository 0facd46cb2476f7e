"""Removal of repeated word sequences, by level-wise doubling of windows.

Windows of `base` words are looked up first. Those that are repeated, and no others, are extended to twice their length and looked
up again, until the asked length is reached or no candidate survives. A window is tracked by its anchor: the `base` words with the
smallest hash among the starts of its first half. Equal windows have equal anchors, so only anchors, about one in six words, are
looked up at the short lengths (base .. window / 2); at the full length all windows of the surviving anchors are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common

WINDOW = 20
BASE = 5
_U = np.uint64


class Block:
    """Words of a block's documents, and the hashes of their windows."""

    def __init__(self, part: pa.Table, window: int, base: int, anchors: bool):
        self.part = common.ordered(part)
        data, self.offsets = common.text_buffer(self.part["text"])
        self.data, hashes, counts = data, [], []
        for lo, hi in common.chunks_by_bytes(self.offsets):
            some = data[self.offsets[lo] : self.offsets[hi]]
            starts, ends, first = common.word_spans(some, self.offsets[lo : hi + 1] - self.offsets[lo])
            hashes.append(common.word_hashes(some, starts, ends))
            counts.append(np.diff(first))
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        n = len(self.words)
        left = np.repeat(self.first[1:], self.counts) - np.arange(n)
        self.starts = np.flatnonzero(left >= window)  # of the windows that a document has room for
        self.levels, length = {base: common.window_hashes(self.words, base)}, base
        while length < window:
            self.levels[2 * length] = common.widen(self.levels[length], length)
            length *= 2
        if anchors and len(self.starts):
            small = common.mix(self.levels[base])
            self.anchor = common.leftmost_minimum(small, window // 2 + 1)[self.starts]
            new = np.concatenate([[True], self.anchor[1:] != self.anchor[:-1]])
            self.anchors = self.anchor[new]
            self.of_anchor = np.cumsum(new) - 1
        elif anchors:
            self.anchor = self.anchors = self.of_anchor = np.zeros(0, np.int64)

    def keys(self, length: int, at: np.ndarray) -> np.ndarray:
        return common.mix(self.levels[length][at] ^ _U(length))

    def second(self, window: int, at: np.ndarray) -> np.ndarray:
        """Another hash of the windows, of 32 bits."""
        words = common.mix(self.words ^ _U(0xA5A5A5A55A5A5A5A))
        sums = np.zeros(len(words) + 1, _U)
        np.cumsum(words * common.powers(common.BYTE_BASE, len(words)), out=sums[1:])
        return (common.mix((sums[at + window] - sums[at]) * common.powers(common.BYTE_INV, len(sums))[at]) >> _U(32)).astype(np.uint32)


def _short_lengths(window: int, base: int) -> list[int]:
    lengths = [base]
    while lengths[-1] * 2 < window:
        lengths.append(lengths[-1] * 2)
    if lengths[-1] * 2 != window:
        raise ValueError("window must be base times a power of two, two at least")
    return lengths


def _distinct_anchors(block: Block, lengths: list[int]):
    """The distinct anchors by their longest hash: an index of each anchor, the keys at each length, and how often each is here."""
    longest = block.keys(lengths[-1], block.anchors)
    keys, index, inverse, count = np.unique(longest, return_index=True, return_inverse=True, return_counts=True)
    return inverse, [block.keys(n, block.anchors[index]) for n in lengths[:-1]] + [keys], count


def _ask_short(key, part: pa.Table, window: int, base: int, buckets: int) -> pa.Table:
    block, lengths = Block(part, window, base, True), _short_lengths(window, base)
    _, keys, count = _distinct_anchors(block, lengths)
    low = [k.astype(np.uint32) for k in keys[:-1]]
    return common.packed_rows(common.send(key[0].as_py(), common.bucket_of(keys[0], buckets), buckets, *low, keys[-1], (count > 1).astype(np.uint8)))


def _judge_short(key, rows: pa.Table, levels: int) -> pa.Table:
    """Levels in turn: a key is looked up at the next length only if it is repeated at this one."""
    sizes, columns = common.receive(rows["payload"].to_pylist(), *[np.uint32] * (levels - 1), np.uint64, np.uint8)
    weight, alive = 1 + columns[-1].astype(np.int64), np.arange(len(columns[-1]))
    for level in columns[:-1]:
        alive = alive[common.repeated(level[alive], weight[alive])]
        if not len(alive):
            break
    flags = np.zeros(len(weight), bool)
    flags[alive] = True
    return common.packed_rows(common.answer(key[0].as_py(), rows["block"].to_pylist(), sizes, flags))


def _first_here(block: Block, window: int, starts: np.ndarray):
    """The distinct windows at these starts: the first start of each, and its key."""
    keys, index = np.unique(block.keys(window, starts), return_index=True)
    return starts[index], keys


def _ask_full(key, part: pa.Table, rows: pa.Table, window: int, base: int, buckets: int) -> pa.Table:
    block, lengths = Block(part, window, base, True), _short_lengths(window, base)
    inverse, keys, _ = _distinct_anchors(block, lengths)
    alive = common.answered(rows, common.bucket_of(keys[0], buckets), buckets)[inverse]
    starts = block.starts[alive[block.of_anchor]] if len(block.starts) else block.starts
    if not len(starts):
        return common.packed_rows([])
    edge = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1]))
    runs = np.stack([starts[edge], np.diff(np.append(edge, len(starts)))])
    at, keys = _first_here(block, window, starts)
    doc = np.searchsorted(block.first, at, "right") - 1
    ids = np.asarray(block.part["doc_id"].fill_null(np.iinfo(np.int64).min))[doc]
    sent = common.send(key[0].as_py(), common.bucket_of(keys, buckets), buckets, keys, block.second(window, at), ids, (at - block.first[doc]).astype(np.int32))
    note = (key[0].as_py() % buckets, key[0].as_py(), 1, runs.astype(np.int64).tobytes())
    return common.packed_rows([*sent, note])


def _judge_full(key, rows: pa.Table) -> pa.Table:
    """A bit for each window: whether no earlier one has its words. Notes of a block to itself pass."""
    rows = rows.sort_by([("kind", "ascending"), ("block", "ascending")])  # ties go by block, however rows arrive
    kinds = np.asarray(rows["kind"])
    sent, notes = rows.filter(pa.array(kinds == 0)), rows.filter(pa.array(kinds == 1))
    sizes, (keys, more, ids, starts) = common.receive(sent["payload"].to_pylist(), np.uint64, np.uint32, np.int64, np.int32)
    order = np.lexsort((starts, ids, more, keys))
    k, m = keys[order], more[order]
    flags = np.zeros(len(keys), bool)
    if len(k):
        flags[order[np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])])]] = True
    out = common.packed_rows(common.answer(key[0].as_py(), sent["block"].to_pylist(), sizes, flags))
    return pa.concat_tables([out, notes.select(PACKED_NAMES).cast(common.PACKED_ARROW)])


PACKED_NAMES = common.PACKED_ARROW.names
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _remove(key, part: pa.Table, rows: pa.Table, window: int, base: int, buckets: int) -> pa.Table:
    block = Block(part, window, base, False)
    covered = np.zeros(len(block.words) + 1, np.int64)
    for kind, payload in zip(rows["kind"].to_pylist(), rows["payload"].to_pylist(), strict=True):
        if kind == 1:
            first, length = np.frombuffer(payload, np.int64).reshape(2, -1)
            starts = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            at, keys = _first_here(block, window, starts)
            stays = at[common.answered(rows, common.bucket_of(keys, buckets), buckets)]
            gone = starts[~np.isin(starts, stays, assume_unique=True)]
            covered[gone] += 1
            covered[gone + window] -= 1
    removed = np.cumsum(covered[:-1]) > 0
    n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[block.first])
    whole, texts = memoryview(block.data), []
    for i, (a, b) in enumerate(zip(block.offsets[:-1], block.offsets[1:], strict=True)):
        words = bytes(whole[a:b]).split()
        if n_removed[i]:
            keep = ~removed[block.first[i] : block.first[i + 1]]
            words = [words[j] for j in np.flatnonzero(keep)]
        texts.append(b" ".join(words))
    kept = pa.array(texts, pa.binary()).cast(pa.string())
    return pa.table([block.part["doc_id"], pa.array(block.counts), pa.array(n_removed.astype(np.int64)), kept], schema=RESULT)


def remove_repeats(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """Remove each word covered by a window of `window` consecutive words that also starts earlier.

    Words are runs of bytes other than ASCII white space, unchanged. Earlier means a smaller doc_id, or an earlier start in the same
    document; windows lie within a document and are judged on the input. Returns doc_id, n_words, n_removed, kept_text (kept words
    joined by one space) for each row. Null text has no words and gives empty kept_text; repeated rows are documents of their own, of
    which one counts as earlier, by a hash of id and text and then by the texts; a null doc_id comes before all others; empty tables give no rows;
    further columns are ignored. Windows are compared by 96-bit hashes.
    """
    blocks = common.block_count(docs)
    buckets = blocks
    dealt = common.in_blocks(docs, blocks)
    p = {"window": window, "base": base, "buckets": buckets}
    levels = len(_short_lengths(window, base))
    asked = dealt.groupBy("block").applyInArrow(common.grouped(_ask_short, **p), common.PACKED)
    short = asked.groupBy("bucket").applyInArrow(common.grouped(_judge_short, levels=levels), common.PACKED)
    full = dealt.groupBy("block").cogroup(short.groupBy("block")).applyInArrow(common.paired(_ask_full, **p), common.PACKED)
    judged = full.groupBy("bucket").applyInArrow(common.grouped(_judge_full), common.PACKED)
    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    return dealt.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(common.paired(_remove, **p), schema)


def op2_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d),
h AS (SELECT doc_id, s, md5(array_to_string(ws[s : s + 19], ' ')) AS h FROM p),
g AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM h) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, s + unnest(range(0, 20)) AS w FROM g),
r AS (SELECT doc_id, list(w) AS gone FROM c GROUP BY doc_id),
x AS (SELECT d.doc_id, ws, coalesce(gone, []) AS gone FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]), ' ')) AS kept_sha256
FROM x
"""
