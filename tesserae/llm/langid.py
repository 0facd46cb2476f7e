"""Language identification by a string kernel.

Two texts are compared by the blended spectrum of 1- to 4-grams of their folded UTF-8 bytes, as presence features: the kernel is the
number of shared n-grams over the root of the product of both counts. Nystroem landmarks stand for the training rows; kernel ridge
regression, one language against the rest, is solved on them. As the kernel is a product of presence vectors, landmarks and
coefficients fold into one matrix (n-gram by language), and a batch of texts is scored by one sparse product with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm import common

#: Bounds of the fit: rows of each language, characters of a row taken for training, landmarks over all languages.
ROWS_PER_LANGUAGE = 600
TRAIN_CHARS = 20_000
LANDMARKS = 200
#: Every language is learned. With over 64 of them (or 66), the rows of each are fewer and the landmarks more.
ALL_ROWS = 64 * ROWS_PER_LANGUAGE
#: Characters of the whole sample, which the driver holds; rows of many languages are cut shorter, but not below LEAST_CHARS.
ALL_CHARS = 64_000_000
LEAST_CHARS = 500
LEAST_ROWS = 50
LANDMARKS_PER_LANGUAGE = 3
RIDGE = 1e-4
#: Bits of the places for 3- and 4-grams; single bytes and pairs have a place each.
BITS = {3: 16, 4: 17}
PLACES = 256 + 65536 + (1 << BITS[3]) + (1 << BITS[4])
_LETTER = r"\p{L}"
#: Bytes of a text that are folded and marked at a time.
PIECE = 1 << 18

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:0x80] = 0x20
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters; other ASCII becomes a space; further bytes stay."""
    out = _FOLD[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


class Presence:
    """Finds the distinct n-gram places of one text at a time, by a table that is never cleared. Long texts are marked piece by piece."""

    def __init__(self):
        self.seen = np.full(PLACES, -1, np.int64)
        self.clock = 0

    def __call__(self, folded: np.ndarray) -> np.ndarray:
        return self._new(folded, self.clock, 0)

    def long(self, data: np.ndarray) -> np.ndarray:
        """The same of a text that isn't folded yet."""
        began, found = self.clock, []
        for at in range(0, len(data), PIECE):
            lead = min(at, 3)  # n-grams that reach back over the cut
            before = min(at, lead + 1)  # and the byte before, on which folding looks
            found.append(self._new(fold(data[at - before : at + PIECE])[before - lead :], began, lead))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def _new(self, folded: np.ndarray, began: int, lead: int) -> np.ndarray:
        """Places that weren't seen since `began`; the first `lead` bytes belong to the piece before."""
        b = folded.astype(np.uint32)
        n, parts = len(b), [b]
        if n > 1:
            two = (b[:-1] << np.uint32(8)) | b[1:]
            parts.append(two + np.uint32(256))
            if n > 2:
                three = (two[:-1] << np.uint32(8)) | b[2:]
                parts.append(((three * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS[3])) + np.uint32(256 + 65536))
                if n > 3:
                    four = (three[:-1] << np.uint32(8)) | b[3:]
                    parts.append((((four ^ (four >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS[4])) + np.uint32(256 + 65536 + (1 << BITS[3])))
        codes = np.concatenate(parts).astype(np.int64)
        if began < self.clock or lead:
            codes = codes[self.seen[codes] < began]
        stamp = np.arange(self.clock, self.clock + len(codes))
        self.clock += len(codes)
        self.seen[codes] = stamp
        return codes[self.seen[codes] == stamp]


def is_held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, chars: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """A bounded sample (lang, text) of the labelled rows that aren't held out: of each language those with the smallest hashes of id and text.

    Texts of over `chars` characters fill up languages that have too few others, by an excerpt from their first letter on. Rows are
    chosen on the executors by a total order, `rows` of each language.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    known = known.select("doc_id", "lang", "text", (F.length("text") > chars).alias("long"))
    counts = {r["lang"]: (r["short"], r["long"]) for r in known.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count_if("long").alias("long")).collect()}
    if not counts:
        return []
    rows = max(min(rows, LEAST_ROWS), min(rows, ALL_ROWS // len(counts)))
    cut = min(chars, max(LEAST_CHARS, ALL_CHARS // (rows * len(counts))))
    shares = []
    for lang, (short, many) in counts.items():
        if short:
            shares.append((lang, False, min(1.0, (1.2 * rows + 20) / short)))
        if many and short < rows:
            shares.append((lang, True, min(1.0, (1.2 * (rows - short) + 20) / many)))
    place = F.pmod(F.xxhash64(F.lit("train"), "doc_id", "text"), F.lit(1 << 30))
    known = known.join(F.broadcast(spark.createDataFrame(shares, "lang string, long boolean, share double")), ["lang", "long"])  # two rows a language
    excerpt = F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, cut)
    picked = known.withColumn("place", place).where(F.col("place") < F.col("share") * (1 << 30)).select("lang", "long", "place", excerpt.alias("text"))
    order = W.partitionBy("lang").orderBy("long", "place", "text")  # each task keeps its first rows of a language before they are shuffled
    picked = picked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).collect()
    return [(r["lang"], r["text"]) for r in sorted(picked, key=lambda r: (r["n"], r["lang"]))]


def fit(sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages, and the matrix n-gram place by language that holds landmarks and regression coefficients."""
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return [], np.zeros((PLACES, 0), np.float32)
    find, grams = Presence(), []
    for _, text in sample:
        grams.append(find(fold(np.frombuffer(text.encode("utf-8"), np.uint8))))
    norm = np.sqrt([max(1, len(g)) for g in grams])
    landmarks = max(landmarks, LANDMARKS_PER_LANGUAGE * len(langs))
    # landmarks turn by turn from each language, in the order of the sample
    turn, seen = [], dict.fromkeys(langs, 0)
    for i, (lang, _) in enumerate(sample):
        turn.append((seen[lang], i))
        seen[lang] += 1
    chosen = [i for _, i in sorted(turn)[:landmarks]]
    table = np.zeros((PLACES, len(chosen)), np.uint8)
    for k, i in enumerate(chosen):
        table[grams[i], k] = 1
    kernel = np.stack([table[g].sum(0, dtype=np.float64) for g in grams]) / norm[:, None] / norm[chosen][None, :]
    target = np.where(np.array([lang for lang, _ in sample])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    small = kernel[chosen]
    weights = 1.0 / np.array([seen[lang] for lang, _ in sample]) / len(langs)  # each language counts alike
    left = (kernel * weights[:, None]).T @ kernel + ridge * small + 1e-9 * np.eye(len(chosen))
    alpha = np.linalg.solve(left, (kernel * weights[:, None]).T @ target)
    fold_in = (alpha / norm[chosen][:, None]).astype(np.float32)
    matrix = np.concatenate([table[i : i + 65536].astype(np.float32) @ fold_in for i in range(0, PLACES, 65536)])
    return langs, matrix


def score_batch(data: np.ndarray, offsets: np.ndarray, matrix: np.ndarray, find: Presence) -> np.ndarray:
    """Decision values of a batch of texts, a row each: sums of matrix rows over the n-grams present, over the root of their number."""
    grams = []
    if len(data) > 4 * PIECE:
        grams = [find.long(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    else:
        folded = fold(data)
        grams = [find(folded[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sizes = np.array([len(g) for g in grams], np.int64)
    out = np.zeros((len(grams), matrix.shape[1]), np.float64)
    lo = 0
    while lo < len(grams):  # products over about two million n-grams at a time
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), 2_000_000)) + lo)
        some = [g for g in grams[lo:hi]]
        full = np.flatnonzero(sizes[lo:hi])
        if len(full):
            rows = matrix[np.concatenate(some)]
            starts = np.concatenate([[0], np.cumsum(sizes[lo:hi])[:-1]])[full]
            out[lo + full] = np.add.reduceat(rows, starts, axis=0, dtype=np.float64) / np.sqrt(sizes[lo:hi][full])[:, None]
        lo = hi
    return out


def identify(docs: DataFrame, languages: list[str], matrix: np.ndarray, carry: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add lang_pred and score, under these or other names, to the rows of docs; only their text is looked at. carry: the columns to
    keep (default doc_id); those that are called like a name are replaced.

    lang_pred is `und` with score 0 if text is null or has no letter, or if nothing could be learned; else the language of the
    largest decision value d, the first by name among equals, with score (d + 1) / 2 held within 0 and 1. Letters are the
    characters of Unicode class L. Texts are read whole, however long, PIECE bytes at a time; repeated rows get the same answer, each; a null doc_id stays; an empty table gives no rows.
    """
    carry = ["doc_id"] if carry is None else [c for c in carry if c.lower() not in names]
    shared = docs.sparkSession.sparkContext.broadcast((languages, matrix))
    text_at = carry.index("text") if "text" in carry else len(carry)
    schema = common.pick(docs, *carry).schema.add(names[0], "string").add(names[1], "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights = shared.value
        labels, find = np.array([*langs, "und"], object), Presence()
        for batch in batches:
            texts = batch.column(text_at)
            has = np.asarray(pa.compute.match_substring_regex(texts, _LETTER).fill_null(False), bool)
            data, offsets = common.text_buffer(texts)
            best, score = np.full(len(has), len(langs)), np.zeros(len(has))
            if langs and len(has):
                parts = [score_batch(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], weights, find) for a, b in common.chunks_by_bytes(offsets)]
                d = np.concatenate([np.zeros((0, len(langs))), *parts])
                best = np.where(has, d.argmax(1), len(langs))
                score = np.where(has, np.clip((d.max(1) + 1) / 2, 0, 1), 0.0)
            columns = [batch.column(i) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(labels[best], pa.string()), pa.array(score)], [*carry, *names])

    source = common.pick(docs, *carry) if "text" in carry else docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").alias(common.unlike(carry, "text")[0]))
    return source.mapInArrow(predict, schema)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return fit(training_sample(docs))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), *train(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def held_out_by_hand(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
