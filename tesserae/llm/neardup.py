"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. Equal texts are merged by 128 bits of hash; one of each goes on. Blocks of texts send the hashes of their shingles, packed, to
   buckets that count in how many texts each occurs, and get the counts above one back. Texts with equal tokens are found on the way.
2. A text whose shingles that occur elsewhere too weigh under the threshold can't have a partner. The others are sampled: only
   shingles that occur elsewhere are, as no other can be shared, so the chance to be a candidate can only rise.
3. Texts that share a band are candidates. Samples estimate their similarities. First a spanning forest of the best estimates is
   verified in each band's group: of a group of n texts n - 1 pairs at most, and its links make up most classes. Then every pair of
   different classes whose estimate isn't clearly too low is verified, so no link between classes is lost. Large groups are dealt
   out in chunks; only members that aren't of the group's largest class meet all chunks.
4. Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common, tiling

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 20
ROWS = 4
#: A pair that just reaches the threshold has some expected number x of unequal samples; it is verified up to x + DEVIATIONS * sqrt(x) + 2
#: of them, which such a pair exceeds once in some 10,000 times at most.
DEVIATIONS = 4.0
#: Members of a band's group, or of a chunk of it, that one call compares; members of all groups that go to a call, about.
GROUP = 2048
LOT = 50_000
LOT_BYTES = 1 << 24
_U = np.uint64


class Block:
    """The distinct shingles of each text of a block (hash, times), sorted by hash; and a hash of each text's tokens."""

    def __init__(self, part: pa.Table, size: int):
        self.part = part.take(pa.compute.sort_indices(part, sort_keys=[("h1", "ascending"), ("h2", "ascending")]))
        data, offsets = common.text_buffer(self.part["text"])
        parts, texts = [], []
        for lo, hi in common.chunks_by_bytes(offsets):
            hashes, first = tiling.tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            grams = common.mix(common.window_hashes(hashes, size))
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(common.mix(hashes ^ _U(0x1234567)) * common.powers(common.BYTE_BASE, len(hashes)), dtype=_U)])
            inverse = common.powers(common.BYTE_INV, len(hashes) + 1)
            texts.append((sums[first[1:]] - sums[first[:-1]]) * inverse[first[:-1]] + np.diff(first).astype(_U))
            short = common.mix(texts[-1] ^ _U(0x7654321))  # a short text is one shingle, its tokens in their order
            for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                own = grams[a : b - size + 1] if b - a >= size else short[k : k + 1] if b > a else grams[:0]
                parts.append(np.sort(own))
        self.text_key = common.mix(np.concatenate([np.zeros(0, _U), *texts])).view(np.int64) & 0x7FFFFFFFFFFFFFFF  # not negative
        sizes = np.array([len(p) for p in parts], np.int64)
        every = np.concatenate(parts) if parts else np.zeros(0, _U)
        doc = np.repeat(np.arange(len(parts)), sizes)
        new = np.concatenate([[True], (every[1:] != every[:-1]) | (doc[1:] != doc[:-1])]) if len(every) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        self.hash, self.doc = every[at], doc[at]
        self.times = np.diff(np.append(at, len(every)))
        self.first = np.searchsorted(self.doc, np.arange(len(parts) + 1))

    def sent(self, buckets: int):
        """Distinct shingles of the block with the number of its documents, and an index of each document's shingles."""
        keys, inverse, count = np.unique(self.hash, return_inverse=True, return_counts=True)
        return keys, inverse, count, common.bucket_of(keys, buckets)

    def texts(self, buckets: int):
        """The distinct texts with tokens: the first row of each, and the bucket."""
        has = np.flatnonzero(np.diff(self.first) > 0)
        keys, index = np.unique(self.text_key[has], return_index=True)
        return keys, has[index], (keys % buckets).astype(np.int32)


def _ask(key, part: pa.Table, size: int, buckets: int, **_) -> pa.Table:
    block, me = Block(part, size), key[0].as_py()
    keys, _, count, bucket = block.sent(buckets)
    # forty bits tell keys of a bucket apart; more buckets make up for more data
    low, high = keys.astype(np.uint32), (keys >> _U(32)).astype(np.uint8)
    rows = common.send(me, bucket, buckets, low, high, count.astype(np.uint32))
    texts, _, where = block.texts(buckets)
    rows += [(b, k, 2, p) for b, k, _, p in common.send(me, where, buckets, texts)]
    return common.packed_rows(rows)


def _count(key, rows: pa.Table) -> pa.Table:
    """Document counts of the shingles that occur in two documents or more; and for each text which block takes it on."""
    kinds, blocks, payloads = np.asarray(rows["kind"]), np.asarray(rows["block"]), rows["payload"].to_pylist()
    me, of = key[0].as_py(), {k: np.flatnonzero(kinds == k) for k in (0, 2)}
    sizes, (low, high, count) = common.receive([payloads[i] for i in of[0]], np.uint32, np.uint8, np.uint32)
    total = np.zeros(len(low), np.int64)
    if len(low):
        keys = low.astype(_U) | (high.astype(_U) << _U(32))
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        total[order] = np.repeat(np.add.reduceat(count[order].astype(np.int64), starts), np.diff(np.append(starts, len(k))))
    ends, out = np.cumsum(sizes), []
    for i, n, e in zip(of[0], sizes, ends, strict=True):
        many = total[e - n : e]
        flags = many > 1
        out.append((me, int(blocks[i]), 0, np.packbits(flags).tobytes() + np.minimum(many[flags], 0xFFFFFFFF).astype(np.uint32).tobytes()))
    sizes, (texts,) = common.receive([payloads[i] for i in of[2]], np.int64)
    owner = np.repeat(blocks[of[2]], sizes)
    order = np.lexsort((owner, texts))
    mine = np.zeros(len(texts), bool)
    if len(texts):
        mine[order[np.concatenate([[True], np.diff(texts[order]) != 0])]] = True
    out += [(b, k, 2, p) for b, k, _, p in common.answer(me, blocks[of[2]].tolist(), sizes, mine)]
    return common.packed_rows(out)


def sample(hashes: np.ndarray, weights: np.ndarray, first: np.ndarray, samples: int) -> np.ndarray:
    """Improved consistent weighted sampling: for each document (a range of first) and sample, a hash of the pair drawn.

    For each element, r and c are drawn from Gamma(2, 1) and b from the unit interval, by its hash alone; t = floor(log w / r + b)
    and the element with the smallest log c - r * (t - b) - r is drawn, along with t.
    """
    n, docs = len(hashes), len(first) - 1
    out = np.zeros((docs, samples), _U)
    if n == 0:
        return out
    log_w, starts, sizes = np.log(weights), first[:-1], np.diff(first)

    def unit(x: np.ndarray) -> np.ndarray:
        return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53

    for k in range(samples):
        h = common.mix(hashes + _U((0x9E3779B97F4A7C15 * (2 * k + 1)) & ((1 << 64) - 1)))
        u = [unit(common.mix(h + _U((0xD1342543DE82EF95 * (j + 1)) & ((1 << 64) - 1)))) for j in range(5)]
        r, c, b = -np.log(u[0] * u[1]), -np.log(u[2] * u[3]), u[4]
        t = np.floor(log_w / r + b)
        a = np.log(c) - r * (t - b) - r
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == np.repeat(least, sizes))
        doc = np.searchsorted(first, hit, "right") - 1
        hit = hit[np.concatenate([[True], doc[1:] != doc[:-1]])]
        out[:, k] = common.mix(hashes[hit] + t[hit].astype(np.int64).view(_U) * _U(0x9FB21C651E98DF25))
    return out


SKETCH = "h1 long, h2 long, text_key long, weight double, shared double, bands array<long>, samples binary, vector binary"
SKETCH_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("text_key", pa.int64()), ("weight", pa.float64()), ("shared", pa.float64()), ("bands", pa.list_(pa.int64())), ("samples", pa.binary()), ("vector", pa.binary())])


def tf_idf(times: np.ndarray, df: np.ndarray, n_texts: int) -> np.ndarray:
    """Times in the text by smoothed inverse document frequency, over distinct texts: copies don't make a shingle common."""
    return times * (1 + np.log((1 + n_texts) / (1 + df)))


def levelled(weight: np.ndarray, times: np.ndarray, shared: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Weights in which shingles of one text alone weigh as much as the text's others do on average."""
    own = np.bincount(doc[shared], weight[shared], docs) / np.maximum(1, np.bincount(doc[shared], times[shared], docs))
    return np.where(shared | (own[doc] == 0), weight, times * own[doc])


def _sketch(key, part: pa.Table, rows: pa.Table, size: int, buckets: int, n_texts: int, threshold: float, bands: int, band_rows: int, level: bool) -> pa.Table:
    block = Block(part, size)
    keys, inverse, _, bucket = block.sent(buckets)
    order, bounds = common.split_by(bucket, buckets)
    df = np.ones(len(keys), np.int64)
    for b, kind, payload in zip(rows["bucket"].to_pylist(), rows["kind"].to_pylist(), rows["payload"].to_pylist(), strict=True):
        if kind == 0:
            at = order[bounds[b] : bounds[b + 1]]
            many = np.frombuffer(payload, np.uint8, (len(at) + 7) // 8)
            flags = np.unpackbits(many, count=len(at)).astype(bool)
            df[at[flags]] = np.frombuffer(payload, np.uint32, offset=len(many))
    texts, row_of, where = block.texts(buckets)
    owned = pa.table([rows["bucket"], pa.array(np.where(np.asarray(rows["kind"]) == 2, 0, 1)), rows["payload"]], names=["bucket", "kind", "payload"])
    mine = np.zeros(len(block.text_key), bool)
    mine[row_of[common.answered(owned, where, buckets)]] = True
    df = df[inverse]
    weight = tf_idf(block.times, df, n_texts)
    shared = df > 1
    if level:
        weight = levelled(weight, block.times, shared, block.doc, len(block.text_key))
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[block.first])
    total, in_common = sums(weight), sums(np.where(shared, weight, 0))
    going = mine & (in_common > 0) & (in_common >= threshold * total - 1e-6)
    chosen = np.flatnonzero(going)
    keep = going[block.doc] & shared
    first = np.concatenate([[0], np.cumsum(np.bincount(block.doc[keep], minlength=len(going))[chosen])]).astype(np.int64)
    drawn = sample(block.hash[keep], weight[keep], first, bands * band_rows)
    # samples go by 16 bits, in bands as well: who shares a band is then seen by the samples alone
    drawn = (drawn >> _U(48)).astype(np.uint16)
    signature = np.zeros((len(chosen), bands), _U)
    for j in range(band_rows):
        signature = common.mix(signature * _U(0x9E3779B97F4A7C15) + drawn[:, j::band_rows].astype(_U) + np.arange(bands, dtype=_U))
    signature = (signature >> _U(6) << _U(5)) | np.arange(bands, dtype=_U)  # the band's number in the low bits
    all_bands: list = [None] * len(going)
    vectors: list = [None] * len(going)
    samples: list = [None] * len(going)
    for i, d in enumerate(chosen):
        all_bands[d] = signature[i].astype(np.int64)
        samples[d] = drawn[i].tobytes()
        a, b = block.first[d], block.first[d + 1]
        ids = block.hash[a:b].astype(np.uint32)
        by_id = np.argsort(ids, kind="stable")
        ids = ids[by_id]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        vectors[d] = ids[starts].tobytes() + np.add.reduceat(weight[a:b][by_id], starts).astype(np.float32).tobytes()
    # a text without tokens is alone, whatever its key
    return pa.table([block.part["h1"], block.part["h2"], pa.array(np.where(np.diff(block.first) > 0, block.text_key, -1)), pa.array(total), pa.array(in_common), pa.array(all_bands, pa.list_(pa.int64())), pa.array(samples, pa.binary()), pa.array(vectors, pa.binary())], schema=SKETCH_ARROW)


def weighted_jaccard(left: bytes, right: bytes) -> float:
    """Sum of smaller over sum of larger weights of two vectors (sorted ids, then weights)."""
    n, m = len(left) // 8, len(right) // 8
    a, b = np.frombuffer(left, np.uint32, n), np.frombuffer(right, np.uint32, m)
    x, y = np.frombuffer(left, np.float32, n, 4 * n).astype(np.float64), np.frombuffer(right, np.float32, m, 4 * m).astype(np.float64)
    at = np.minimum(np.searchsorted(b, a), m - 1)
    both = b[at] == a
    low = np.minimum(x[both], y[at[both]]).sum()
    return float(low / (x.sum() + y.sum() - low))


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(start: np.ndarray, many: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each row with the rows start[row], start[row] + 1, ..., many[row] of them; some `most` pairs at a time."""
    ends = np.cumsum(many)
    lo = 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        some = many[lo:hi]
        row = np.repeat(np.arange(lo, hi), some)
        yield row, np.repeat(start[lo:hi], some) + np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some)
        lo = hi


def _forest(n: int, i: np.ndarray, j: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Places of the edges of a spanning forest of greatest estimates, by rounds in which each tree takes its best edge."""
    order = np.argsort(-same.astype(np.int64), kind="stable")  # a rank for each edge, so that no two are equal and no cycle closes
    rank = np.empty(len(i), np.int64)
    rank[order] = np.arange(len(i))
    label, out, live = np.arange(n), [], np.arange(len(i))
    while True:
        live = live[label[i[live]] != label[j[live]]]
        if not len(live):
            return np.concatenate([np.zeros(0, np.int64), *out])
        best = np.full(n, len(i))
        np.minimum.at(best, label[i[live]], rank[live])
        np.minimum.at(best, label[j[live]], rank[live])
        taken = order[np.unique(best[best < len(i)])]
        out.append(taken)
        up = np.arange(n)
        for x, y in zip(label[i[taken]].tolist(), label[j[taken]].tolist(), strict=True):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def _candidates(key, rows: pa.Table, threshold: float, band_rows: int, every: bool) -> pa.Table:
    """Pairs (smaller key, larger key) within the groups (band, chunk) of a lot: those worth verifying, or all that are similar enough.

    every: all pairs between different classes, each in the first band that both share, verified here by the vectors that came along:
    pairs just under the threshold may be as many as a group's square, so no table is made of them. A chunk has rows that are at home there and
    copies of the group's others (minor: not of its largest class). A row at home meets all minor ones, if it is minor itself those of
    smaller keys only; so each pair is looked at once in a group. Otherwise the edges of a spanning forest of each group.
    """
    rows = rows.sort_by([("band", "ascending"), ("chunk", "ascending"), *([("minor", "descending")] if every else []), ("text_key", "ascending")])
    band, chunk, ids, weight, shared = (np.asarray(rows[c]) for c in ("band", "chunk", "text_key", "weight", "shared"))
    samples = np.frombuffer(b"".join(rows["samples"].to_pylist()), np.uint16).reshape(len(ids), -1)
    edge = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (chunk[1:] != chunk[:-1])]))
    size, left, right, sames = samples.shape[1], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    comp = np.asarray(rows["comp"]) if every else ids
    groups, at = np.diff(np.append(edge, len(ids))), np.arange(len(ids))
    start = np.repeat(edge, groups)
    if every:
        home, minor = np.asarray(rows["home"]), np.asarray(rows["minor"])
        minors = np.repeat(np.add.reduceat(minor.astype(np.int64), edge), groups) if len(ids) else start
        many = np.where(home, np.where(minor, at - start, minors), 0)
    else:
        many = at - start
    for j, i in _pairs(start, many, 400_000):
        # what both must have in common to reach the threshold, and what that is as a similarity of the sampled parts
        common_weight = (threshold - 1e-6) / (1 + threshold) * (weight[i] + weight[j])
        ok = (common_weight <= np.minimum(shared[i], shared[j])) & (comp[i] != comp[j])
        i, j, common_weight = i[ok], j[ok], common_weight[ok]
        unlike = size * (1 - common_weight / (shared[i] + shared[j] - common_weight))
        most = unlike + DEVIATIONS * np.sqrt(np.maximum(unlike, 0)) + 2
        for a in range(0, len(i), 50_000):
            x, y = i[a : a + 50_000], j[a : a + 50_000]
            equal = samples[x] == samples[y]
            same = equal.sum(1)
            near = size - same <= most[a : a + 50_000]
            if every:
                shares = equal[near].reshape(-1, size // band_rows, band_rows).all(2)
                number = band[x[near]] & 31
                near[near] = (shares.argmax(1) == number) & shares[np.arange(len(number)), number]
            left.append(x[near])
            right.append(y[near])
            sames.append(same[near])
    i, j = np.concatenate(left), np.concatenate(right)
    if not every:
        kept = _forest(len(ids), i, j, np.concatenate(sames))
        i, j = i[kept], j[kept]
    elif len(i):
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        vectors = rows["vector"].take(pa.array(used)).to_pylist()
        kept = np.array([weighted_jaccard(vectors[x], vectors[y]) >= threshold for x, y in zip(at[: len(i)].tolist(), at[len(i) :].tolist(), strict=True)], bool)
        i, j = i[kept], j[kept]
    return pa.table([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], schema=PAIRS)


def _compared(members: DataFrame, sketches: DataFrame, labels: DataFrame | None, threshold: float, band_rows: int) -> DataFrame:
    """Pairs from all groups: candidates that make up forests of the best estimates without labels, else all links between different classes."""
    spark = sketches.sparkSession
    about = sketches.select("text_key", "weight", "shared", "samples", *(["vector"] if labels is not None else []))
    chunk = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("text_key", "band"), F.col("chunks"))).otherwise(0).cast("int")
    rows, copies = members.withColumn("chunk", chunk), None
    if labels is not None:
        known = rows.join(labels, "text_key", "left").withColumn("comp", F.coalesce("comp", "text_key"))
        known = common.materialize(known, "members-known")
        # groups of one class have nothing left to compare
        sizes = known.groupBy("band", "comp").agg(F.count("*").alias("n"), F.first("chunks").alias("chunks"))
        largest = sizes.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("largest"), F.sum("n").alias("n"), F.first("chunks").alias("chunks"), F.count("*").alias("classes"))
        largest = largest.where("classes > 1").select("band", F.col("largest.comp").alias("major"), (F.col("n") + (F.col("n") - F.col("largest.n")) * (F.col("chunks") - 1)).alias("copies"))
        largest = common.materialize(largest, "members-open")
        copies = largest.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
        rows = known.join(largest.drop("copies"), "band").withColumn("minor", F.col("comp") != F.col("major")).drop("major").join(about, "text_key")
        each = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
        rows = rows.withColumn("home_chunk", F.col("chunk")).withColumn("chunk", F.explode(each)).withColumn("home", F.col("chunk") == F.col("home_chunk")).drop("home_chunk")
    else:
        rows = rows.join(about, "text_key")
    # many groups go to a call together, about LOT rows of them, copies counted
    lots = max(common.shuffle_width(spark), -(-(members.count() if copies is None else copies) // LOT))
    if copies:  # and vectors of about LOT_BYTES
        lots = max(lots, int(copies * sketches.agg(F.avg(F.octet_length("vector"))).first()[0]) // LOT_BYTES)
    rows = rows.withColumn("lot", F.pmod(F.xxhash64("band", "chunk"), F.lit(lots)))
    call = common.grouped(_candidates, threshold=threshold, band_rows=band_rows, every=labels is not None)
    pairs = rows.groupBy("lot").applyInArrow(call, "a long, b long")
    return pairs if labels is not None else pairs.distinct()


def _verified(pairs: DataFrame, sketches: DataFrame, threshold: float, name: str) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    left, right = (sketches.select(F.col("text_key").alias(k), F.col("vector").alias(f"v{k}")) for k in "ab")
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "va", "vb")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = [weighted_jaccard(x, y) >= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            flags = pa.array(similar, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(flags), batch.column(1).filter(flags)], ["a", "b"])

    return common.materialize(joined.mapInArrow(judge, "a long, b long"), name)


def components(edges: DataFrame) -> DataFrame:
    """(text_key, comp) for the texts of edges (a, b), with comp the smallest key of the connected component.

    Labels travel along edges, and each round then follows labels to the labels' own, so long chains take few rounds. Texts without
    an edge take no part.
    """
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = common.materialize(edges.select("a", "b").unionByName(back).distinct(), "edges")
    labels = common.materialize(both.groupBy(F.col("a").alias("text_key")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        heard = both.join(labels.select(F.col("text_key").alias("b"), "comp"), "b").groupBy(F.col("a").alias("text_key")).agg(F.min("comp").alias("heard"))
        jump = labels.select(F.col("text_key").alias("low"), F.col("comp").alias("further"))
        moved = labels.join(heard, "text_key").select("text_key", F.col("comp").alias("before"), F.least("comp", "heard").alias("low"))
        moved = moved.join(jump, "low").select("text_key", F.least("low", "further").alias("comp"), "before")
        moved = common.materialize(moved, "labels")
        labels = moved.select("text_key", "comp")
        if moved.where("comp <> before").isEmpty():
            return labels


def links(sketches: DataFrame, threshold: float = THRESHOLD, band_rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Verified links that make up the classes, and the components (text_key, comp) of the texts that have any."""
    members = sketches.select("text_key", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / GROUP).cast("int").alias("chunks"))
    members = common.materialize(members.join(common.materialize(sizes, "bands"), "band"), "members")
    # only texts that share a band are looked up from here on
    sketches = common.materialize(sketches.drop("bands").join(members.select("text_key").distinct(), "text_key", "left_semi"), "candidates")
    found = _verified(_compared(members, sketches, None, threshold, band_rows), sketches, threshold, "links-best")
    labels = components(found)
    more = common.materialize(_compared(members, sketches, labels, threshold, band_rows), "links-rest")
    ends = more
    for k in "ab":
        ends = ends.join(labels.select(F.col("text_key").alias(k), F.col("comp").alias(f"c{k}")), k, "left")
    of = lambda k: F.coalesce(f"c{k}", k).alias(k)
    joined = common.materialize(ends.select(of("a"), of("b")).where("a <> b").distinct(), "joined")
    if joined.isEmpty():
        return found.unionByName(more), labels
    top = components(joined)
    above = top.select(F.col("text_key").alias("comp"), F.col("comp").alias("top"))
    lower = labels.join(above, "comp", "left").select("text_key", F.coalesce("top", "comp").alias("comp"))
    alone = top.join(labels, "text_key", "left_anti")  # classes of one text, which have no label of before
    return found.unionByName(more), common.materialize(lower.unionByName(alone), "labels-all")


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and 128 bits of the text's hash; null for a null or empty text."""
    some = F.col("text") != ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(some, F.xxhash64("text")).alias("h1"), F.when(some, F.xxhash64(F.lit(7), "text")).alias("h2"))


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once for a task: copies are dropped before they travel."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys, new = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True), []
        for i, k in enumerate(keys):
            if k not in seen:
                seen.add(k)
                new.append(i)
        yield batch.take(pa.array(new, pa.int64()))


def classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, band_rows: int = ROWS, level: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id and class_id, the smallest doc_id of its class of near-duplicates.

    Tokens are lower-cased runs of letters and digits, shingles are `size` of them; a text of fewer tokens is one shingle. Texts of
    equal tokens are of one class, and so are texts linked by a weighted Jaccard similarity of at least threshold, directly or over
    others. Null, empty and token-less texts are alone. Repeated rows get the same class; a null doc_id gets the class of its text,
    which is null if no row of it has an id; empty tables give no rows; further columns are ignored. A very long text is taken whole,
    in a block of its own size.

    level: shingles that no other text holds weigh what the text's others do on average. Else they weigh most of all, so that the
    edits of a near copy count for more the larger its group is, as what the group shares is common then.
    """
    keyed = _hashed(docs)
    texts = keyed.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max(F.octet_length("text")).alias("bytes"))
    texts = common.materialize(texts, "texts")
    n_texts, total = texts.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    blocks = max(common.shuffle_width(docs.sparkSession), -(-total // common.BLOCK_BYTES))
    once = keyed.where("h1 IS NOT NULL").select("text", "h1", "h2").mapInArrow(_first_seen, "text string, h1 long, h2 long")
    dealt = once.withColumn("block", F.pmod("h1", F.lit(blocks)).cast("int")).repartition("block").groupBy("block", "h1", "h2").agg(F.first("text").alias("text"))
    p = {"size": size, "buckets": blocks}
    asked = dealt.groupBy("block").applyInArrow(common.grouped(_ask, **p), common.PACKED)
    counted = asked.groupBy("bucket").applyInArrow(common.grouped(_count), common.PACKED)
    sketch = common.paired(_sketch, n_texts=max(1, n_texts), threshold=threshold, bands=bands, band_rows=band_rows, level=level, **p)
    rows = common.materialize(dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(sketch, SKETCH), "sketches")
    _, labels = links(rows.where("bands IS NOT NULL").select("text_key", "weight", "shared", "bands", "samples", "vector"), threshold, band_rows)
    known = texts.join(rows.where("text_key >= 0").select("h1", "h2", "text_key"), ["h1", "h2"])
    known = common.materialize(known.join(labels, "text_key", "left").select("h1", "h2", "least", F.coalesce("comp", "text_key").alias("comp")), "known")
    least = known.groupBy("comp").agg(F.min("least").alias("class_id"))
    of_text = known.select("h1", "h2", "comp").join(least, "comp").select("h1", "h2", "class_id", F.lit(True).alias("known"))
    named = keyed.drop("text").join(common.materialize(of_text, "classes"), ["h1", "h2"], "left")
    return named.select("doc_id", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"), level=True)
