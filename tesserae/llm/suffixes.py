"""Removal of repeated byte strings with suffix arrays built by linear grouping.

A window is `length` consecutive bytes of one document. Each window has an anchor: the start, in its first half, of the 16 bytes with
the smallest hash. Equal windows have equal anchors at equal places, so windows are brought together by the bytes from the anchor
on, half a window of them, which lie in every window of that anchor. Where all surroundings of such a core are alike, they are all
repeated or the only ones, and no more is asked. Otherwise the windows of an anchor are taken SPAN at a time: such a group has a
core of length - SPAN + 1 bytes and SPAN - 1 bytes on either side. Groups with equal cores become one string in which the core is a
single symbol; those of a very frequent core go by their nearest bytes as well, for the windows that hold these; a group that occurs again as a whole is in it twice. Its suffix array shows, by the neighbour of each suffix, which
windows are repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common

LENGTH = 400
GRAM = 16
SPAN = 8
#: Occurrences from which a core's strings are dealt by the bytes next to it, too; strings that make an array together, about.
HOT, ARRAY = 1 << 16, 1 << 15
_U = np.uint64


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of integers with a unique smallest one at the end, by grouping suffixes by their Lyndon prefixes.

    First, groups of suffixes are taken from the highest down. For each member the nearest suffix before it of a lower group is its
    previous smaller one; a suffix that is so pointed at by k members of the group is longer by k copies of the group's prefix, so
    those with equal k and equal group move together to a group right after their old one. Then the groups are emitted: each placed
    suffix puts the one before it, and the chain of its previous smaller ones, at the front of their groups.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for k, s in enumerate(order):
        if k and text[s] != text[order[k - 1]]:
            start = k
        place[s], group[s] = k, start
        size[start] += 1
    previous = [-1] * n
    end = n - 1
    while end >= 0:
        low = group[order[end]]
        members = order[low : end + 1]
        if end == low:
            p = members[0] - 1
            while p >= 0 and group[p] >= low:
                p = previous[p]
            previous[members[0]] = p
            pointed = {1: [p]} if p >= 0 else {}
        else:
            members.sort()
            times: dict[int, int] = {}
            for s in members:
                p = s - 1
                while p >= 0 and group[p] >= low:
                    p = previous[p]
                previous[s] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            pointed = {}
            for p, k in times.items():
                pointed.setdefault(k, []).append(p)
        for k in sorted(pointed, reverse=True):
            if len(pointed[k]) == 1:
                p = pointed[k][0]
                g = group[p]
                left = size[g] = size[g] - 1
                if left:
                    tail, at = g + left, place[p]
                    other = order[tail]
                    order[at], place[other] = other, at
                    order[tail], place[p] = p, tail
                    group[p], size[tail] = tail, 1
                else:
                    size[g] = 1
                continue
            by_group: dict[int, list[int]] = {}
            for p in pointed[k]:
                by_group.setdefault(group[p], []).append(p)
            for g, moved in by_group.items():
                many = len(moved)
                left = size[g] - many
                if not left:
                    continue
                tail = g + left
                for t, p in enumerate(moved):
                    to, at = g + size[g] - 1 - t, place[p]
                    other = order[to]
                    order[at], place[other] = other, at
                    order[to], place[p] = p, to
                for p in moved:
                    group[p] = tail
                size[g], size[tail] = left, many
        end = low - 1
    out = [-1] * n
    front = list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            placed[s] = 1
            s = previous[s]
    return out


def repeated_windows(strings: np.ndarray, width: int) -> np.ndarray:
    """For rows of symbols (all over 0), which of the first `width` windows of `width` symbols of each row occur again anywhere.

    The rows are joined, each with a mark after it, and the suffix array's neighbours are compared: a window occurs again if and only
    if a neighbour of its suffix begins with it.
    """
    rows, columns = strings.shape
    flat = np.concatenate([np.concatenate([strings + 1, np.ones((rows, 1), strings.dtype)], 1).ravel(), np.zeros(1, strings.dtype)])
    order = np.array(suffix_array(flat.tolist()))
    start, at = np.divmod(order, columns + 1)
    good = (at < width) & (start < rows)
    padded = np.concatenate([flat, np.zeros(width, flat.dtype)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    hit = np.zeros(len(order) + 1, bool)  # hit[k]: suffixes k-1 and k begin alike
    for a in range(1, len(order), 1 << 18):
        b = min(len(order), a + (1 << 18))
        hit[a:b] = good[a - 1 : b - 1] & good[a:b] & (windows[order[a - 1 : b - 1]] == windows[order[a:b]]).all(1)
    again = hit[:-1] | hit[1:]
    out = np.zeros((rows, width), bool)
    out[start[good], at[good]] = again[good]
    return out


class Block:
    """The anchors of a block: place (a), first and last start (lo, hi) of the windows they stand for."""

    def __init__(self, part: pa.Table, length: int):
        self.part = common.ordered(part)
        self.data, self.offsets = common.text_buffer(self.part["text"])
        found = []
        half = length // 2
        for first, last in common.chunks_by_bytes(self.offsets):
            begin = int(self.offsets[first])
            some, offsets = self.data[begin : self.offsets[last]], self.offsets[first : last + 1] - begin
            starts = np.flatnonzero(np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(some)) >= length)
            if not len(starts):
                continue
            prefix = common.prefix_hash(some)
            grams = common.mix((prefix[GRAM:] - prefix[:-GRAM]) * common.powers(common.BYTE_INV, len(prefix))[: len(prefix) - GRAM])
            anchor = common.leftmost_minimum(grams, half)[starts]
            # an anchor's windows end where the anchor changes, or where a document too short for windows lies between
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(starts) != 1)]))
            a, lo, hi = anchor[edge], starts[edge], starts[np.append(edge[1:], len(starts)) - 1]
            found.append((a + begin, lo + begin, hi + begin, common.range_hash(prefix, a, a + half), common.range_hash(prefix, lo, hi + length)))
        empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, _U)] * 2
        self.a, self.lo, self.hi, self.core, self.around = [np.concatenate(x) for x in zip(*found, strict=True)] if found else empty


def _cores(block: Block):
    """Distinct cores of a block: an index of each anchor, core, one surrounding, occurrences, and whether surroundings differ."""
    core, inverse, count = np.unique(block.core, return_inverse=True, return_counts=True)
    if not len(core):
        return inverse, core, core, count.astype(np.uint32), np.zeros(0, np.uint8)
    order = np.argsort(inverse, kind="stable")
    starts = np.concatenate([[0], np.cumsum(count)[:-1]])
    around = block.around[order]
    least, most = np.minimum.reduceat(around, starts), np.maximum.reduceat(around, starts)
    return inverse, core, least, np.minimum(count, 1 << 30).astype(np.uint32), (least != most).astype(np.uint8)


def _ask_cores(key, part: pa.Table, length: int, buckets: int, **_) -> pa.Table:
    _, core, around, count, differ = _cores(Block(part, length))
    return common.packed_rows(common.send(key[0].as_py(), common.bucket_of(core, buckets), buckets, core, around, count, differ))


ALONE, ALL, ASK, SPLIT = range(4)


def _judge_cores(key, rows: pa.Table, hot: int) -> pa.Table:
    sizes, (core, around, count, differ) = common.receive(rows["payload"].to_pylist(), _U, _U, np.uint32, np.uint8)
    state = np.zeros(len(core), np.uint8)
    if len(core):
        order = np.argsort(core, kind="stable")
        k = core[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        total = np.add.reduceat(count[order].astype(np.int64), starts)
        unlike = np.maximum.reduceat(differ[order], starts).astype(bool)
        unlike |= np.minimum.reduceat(around[order], starts) != np.maximum.reduceat(around[order], starts)
        verdict = np.where(total < 2, ALONE, np.where(~unlike, ALL, np.where(total < hot, ASK, SPLIT))).astype(np.uint8)
        state[order] = np.repeat(verdict, np.diff(np.append(starts, len(k))))
    ends = np.cumsum(sizes)
    blocks = rows["block"].to_pylist()
    return common.packed_rows([(key[0].as_py(), b, 0, state[e - n : e].tobytes()) for b, n, e in zip(blocks, sizes, ends, strict=True)])


def _bytes_back(rows: pa.Table, kind: int, bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Answers of a byte for each key, in the order in which the keys were sent."""
    order, bounds = common.split_by(bucket, buckets)
    out = np.zeros(len(bucket), np.uint8)
    for b, k, payload in zip(rows["bucket"].to_pylist(), rows["kind"].to_pylist(), rows["payload"].to_pylist(), strict=True):
        if k == kind:
            out[order[bounds[b] : bounds[b + 1]]] = np.frombuffer(payload, np.uint8)
    return out


def _spans(data: np.ndarray, prefix_at, a, lo, hi, length: int):
    """The windows of anchors, SPAN at a time: first start of each group, its core's hash, and the bytes on either side.

    Groups lie at multiples of SPAN from the anchor, so that equal windows are in groups with equal cores. The eighth byte of each
    side is how many of its bytes lie outside of the anchor's windows.
    """
    q_lo, q_hi = (a - hi) // SPAN, (a - lo) // SPAN
    many = q_hi - q_lo + 1
    of = np.repeat(np.arange(len(a)), many)
    q = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + q_lo[of]
    last = a[of] - q * SPAN
    first = last - (SPAN - 1)
    absent_left, absent_right = np.maximum(0, lo[of] - first), np.maximum(0, last - hi[of])
    sides = []
    for begin, absent, before in ((first, absent_left, True), (first + length, absent_right, False)):
        side = np.zeros((len(of), 8), np.uint8)
        for j in range(SPAN - 1):  # a column at a time, so that no wide table of places is made
            byte = data[np.clip(begin + j, 0, max(0, len(data) - 1))]
            byte[j < absent if before else j >= SPAN - 1 - absent] = 0
            side[:, j] = byte
        side[:, 7] = absent
        sides.append(side.view(_U)[:, 0])
    return of, first, prefix_at(last, first + length), *sides


def _hasher(block: Block):
    """Hashes of ranges of the block's bytes, by one prefix array over all of them."""
    prefix = common.prefix_hash(block.data)
    return lambda start, end: common.range_hash(prefix, start, end)


def _distinct_spans(core, left, right):
    whole = common.mix(core + common.mix(left ^ _U(0x5851F42D4C957F2D)) * _U(3) + common.mix(right ^ _U(0x14057B7EF767814F)) * _U(5))
    _, index, inverse, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    return index, inverse, count


class _Asked:
    """What a block asks for at full length; made once to send it, and again to read the answer.

    A string of a split core is asked for twice. The first half of its windows hold the SPAN / 2 bytes before the core, so equal ones
    are in strings that agree in these; the other half hold as many after it. Each time only that half of the answer counts.
    """

    def __init__(self, block: Block, a, lo, hi, split, length: int):
        hashed = _hasher(block)
        self.of, self.first, core, left, right = _spans(block.data, hashed, a, lo, hi, length)
        index, self.inverse, count = _distinct_spans(core, left, right)
        core, left, right = core[index], left[index], right[index]
        halves = split.astype(bool)[self.of][index]
        plain, two = np.flatnonzero(~halves), np.flatnonzero(halves)
        half = _U(8 * (SPAN // 2))
        before, after = (left[two] >> _U(8 * (SPAN // 2 - 1))) & ((_U(1) << half) - _U(1)), right[two] & ((_U(1) << half) - _U(1))
        near = [common.mix(core[two] + common.mix(x + _U(c))) for x, c in ((before, 0x51ED270B0F4D2A35), (after, 0x2545F4914F6CDD1D))]
        self.row = np.concatenate([plain, two, two])
        self.core, self.left, self.right, self.count = np.concatenate([core[plain], *near]), left[self.row], right[self.row], count[self.row]
        low = (1 << SPAN // 2) - 1
        self.mask = np.repeat(np.array([255, low, 255 ^ low], np.uint8), [len(plain), len(two), len(two)])
        self.strings = len(index)

    def bits(self, answers: np.ndarray) -> np.ndarray:
        """For each group of windows the answers to what was asked for it."""
        out = np.zeros(self.strings, np.uint8)
        np.bitwise_or.at(out, self.row, answers & self.mask)
        return out[self.inverse]


def _ask_windows(key, part: pa.Table, rows: pa.Table, length: int, buckets: int, **_) -> pa.Table:
    block = Block(part, length)
    inverse, core, *_ = _cores(block)
    state = _bytes_back(rows, 0, common.bucket_of(core, buckets), buckets)[inverse]
    if not state.any():
        return common.packed_rows([])
    me = key[0].as_py()
    sure, ask = state == ALL, state >= ASK
    asked = _Asked(block, block.a[ask], block.lo[ask], block.hi[ask], state[ask] == SPLIT, length)
    out = common.send(me, common.bucket_of(asked.core, buckets), buckets, asked.core, asked.left, asked.right, (asked.count > 1).astype(np.uint8))
    note = [np.array([sure.sum(), ask.sum()]), block.lo[sure], block.hi[sure], block.a[ask], block.lo[ask], block.hi[ask], state[ask] == SPLIT]
    out.append((me % buckets, me, 1, np.concatenate(note).astype(np.int64).tobytes()))
    return common.packed_rows(out)


def _judge_windows(key, rows: pa.Table) -> pa.Table:
    kinds, blocks = np.asarray(rows["kind"]), np.asarray(rows["block"])
    payloads = rows["payload"].to_pylist()
    of = [np.flatnonzero(kinds == k) for k in range(2)]
    sizes, (core, left, right, multi) = common.receive([payloads[i] for i in of[0]], _U, _U, _U, np.uint8)
    bits = np.zeros(len(core), np.uint8)
    if len(core):
        order = np.lexsort((right, left, core))
        c, x, y, m = core[order], left[order], right[order], multi[order]
        new_core = np.concatenate([[True], c[1:] != c[:-1]])
        new = new_core | np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        at = np.flatnonzero(new)
        times = np.add.reduceat(1 + m.astype(np.int64), at)
        which = np.cumsum(new_core) - 1  # of a core
        strings_of = np.bincount(which[at], minlength=which[-1] + 1)
        fed = np.flatnonzero((strings_of[which[at]] > 1) | (times > 1))  # all but distinct strings that are alone with their core
        found = np.zeros(len(at), np.uint8)
        if len(fed):
            fed = np.repeat(fed, np.where(times[fed] > 1, 2, 1))  # one that occurs again stands there twice
            string = np.zeros((len(fed), 2 * SPAN - 1), np.int64)
            xs, ys = (np.ascontiguousarray(v[at[fed]]).view(np.uint8).reshape(-1, 8) for v in (x, y))
            near = np.arange(SPAN - 1)
            string[:, : SPAN - 1] = np.where(near < xs[:, 7:], 1, xs[:, : SPAN - 1].astype(np.int64) + 2)
            string[:, SPAN - 1] = 258 + which[at[fed]]
            string[:, SPAN:] = np.where(near >= SPAN - 1 - ys[:, 7:].astype(np.int64), 1, ys[:, : SPAN - 1].astype(np.int64) + 2)
            # cores share no window, so an array holds whole cores only
            edge = np.append(np.flatnonzero(np.concatenate([[True], np.diff(string[:, SPAN - 1]) != 0])), len(fed))
            lo = 0
            while lo < len(fed):
                hi = max(int(edge[np.searchsorted(edge, lo, "right")]), int(edge[np.searchsorted(edge, lo + ARRAY, "right") - 1]))
                found[fed[lo:hi]] = np.packbits(repeated_windows(string[lo:hi], SPAN), axis=1, bitorder="little")[:, 0]
                lo = hi
        bits[order] = np.repeat(found, np.diff(np.append(at, len(c))))
    ends, out = np.cumsum(sizes), []
    out += [(key[0].as_py(), int(blocks[i]), 0, bits[e - n : e].tobytes()) for i, n, e in zip(of[0], sizes, ends, strict=True)]
    out += [(key[0].as_py(), int(blocks[i]), 1, payloads[i]) for i in of[1]]
    return common.packed_rows(out)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


class _Texts(Block):
    """A block without its anchors."""

    def __init__(self, part: pa.Table):
        self.part = common.ordered(part)
        self.data, self.offsets = common.text_buffer(self.part["text"])


def _remove(key, part: pa.Table, rows: pa.Table, length: int, buckets: int, **_) -> pa.Table:
    block = _Texts(part)
    change = np.zeros(len(block.data) + 1, np.int64)
    for kind, payload in zip(rows["kind"].to_pylist(), rows["payload"].to_pylist(), strict=True):
        if kind != 1:
            continue
        note = np.frombuffer(payload, np.int64)
        sure, ask = note[:2]
        lo_sure, hi_sure, a, lo, hi, split = np.split(note[2:], np.cumsum([sure, sure, ask, ask, ask]))
        np.add.at(change, lo_sure, 1)
        np.add.at(change, hi_sure + length, -1)
        asked = _Asked(block, a, lo, hi, split, length)
        bits = asked.bits(_bytes_back(rows, 0, common.bucket_of(asked.core, buckets), buckets))
        for j in range(SPAN):
            start = asked.first + j
            good = ((bits >> np.uint8(j)) & 1).astype(bool) & (start >= lo[asked.of]) & (start <= hi[asked.of])
            change += np.bincount(start[good], minlength=len(change)) - np.bincount(start[good] + length, minlength=len(change))
    removed = np.cumsum(change[:-1]) > 0
    opens = removed.copy()
    opens[1:] &= ~removed[:-1]
    firsts = block.offsets[:-1][np.diff(block.offsets) > 0]
    opens[firsts] = removed[firsts]
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[block.offsets]).astype(np.int64)
    n_removed, kept = count(removed), []
    for i, (a, b) in enumerate(zip(block.offsets[:-1], block.offsets[1:], strict=True)):
        kept.append((block.data[a:b][~removed[a:b]] if n_removed[i] else block.data[a:b]).tobytes())
    return pa.table([block.part["doc_id"], pa.array(np.diff(block.offsets)), pa.array(n_removed), pa.array(count(opens)), pa.array(kept, pa.binary())], schema=RESULT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts anywhere else, in the same document or another.

    Texts are UTF-8 bytes; strings lie within a document, may overlap, and are judged on the input. Returns doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs) and kept (the remaining bytes, which may begin or end amid a character) for each row.
    Null counts as empty; repeated rows are copies of each other; a null doc_id stays; empty tables give no rows; further columns are
    ignored; texts are read whole, however long. A core with `hot`
    or more occurrences is dealt by its nearest bytes to several tasks. Cores are compared by 64-bit hashes along with hashes or bytes of what is around them.
    """
    if length < 4 * GRAM or length < 4 * SPAN:
        raise ValueError("length is too short for anchors")
    blocks = common.block_count(docs)
    dealt = common.in_blocks(docs, blocks)
    p = {"length": length, "buckets": blocks}
    asked = dealt.groupBy("block").applyInArrow(common.grouped(_ask_cores, **p), common.PACKED)
    cores = asked.groupBy("bucket").applyInArrow(common.grouped(_judge_cores, hot=hot), common.PACKED)
    windows = dealt.groupBy("block").cogroup(cores.groupBy("block")).applyInArrow(common.paired(_ask_windows, **p), common.PACKED)
    judged = windows.groupBy("bucket").applyInArrow(common.grouped(_judge_windows), common.PACKED)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return dealt.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(common.paired(_remove, **p), schema)


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
