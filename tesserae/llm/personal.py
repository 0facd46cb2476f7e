"""Personal data by weak supervision.

Candidates are what the strict patterns match, with or without passing their checks, and what looser patterns match. Labelers vote
for or against each: the strict pattern, a checksum or structure test, a gazetteer (top-level domains, calling codes, card issuers,
address ranges), words of context for and against, and the characters around. All votes of the corpus are counted by pattern, which
is a small table; expectation-maximisation over the counts estimates each labeler's reliability and the chance of each pattern, and
a logistic span classifier is trained on those chances. Strict matches that pass their checks always stay; the classifier decides on
the others.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import common

KINDS = ["email", "ip", "card", "phone"]
ACCEPT = 0.5
#: Characters before and after a candidate that the context labelers read.
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]{1,63}(?:\s?[\[(]\s?dot\s?[\])]\s?[A-Za-z0-9-]{1,63}){1,8}", re.IGNORECASE)
_LOOSE_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_LOOSE_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")

#: Generic top-level domains in wide use. A country's domain is any two letters.
DOMAINS = frozenset(
    """aero app art asia audio bank bio biz blog cat cloud club com community company coop dev digital edu email events expert finance
    gmbh gov group guru health help host info ink int io jobs law life link live ltd media mil mobi money museum name net network news ngo
    online org page photo post press pro pub research school science services shop site social software solutions space store studio support
    systems team tech tel today tools top travel university vip web website wiki work world xyz zone""".split()
)
#: Country calling codes; those of three digits as ranges of their first one and last one.
CALLING_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()) + tuple(
    str(c)
    for a, b in ((210, 219), (220, 269), (290, 299), (350, 359), (370, 389), (420, 429), (500, 509), (590, 599), (670, 699), (800, 809), (850, 859), (870, 889), (960, 979), (992, 998))
    for c in range(a, b + 1)
)
#: Words of context in English, Spanish, French, German, Italian and Portuguese.
FOR = {
    "email": ("mail", "contact", "write to", "reach", "correo", "contacto", "courriel", "écri", "kontakt", "schreib", "posta", "scriv", "contato", "escrev"),
    "ip": ("ip", "host", "server", "address", "login", "adresse", "dirección", "indirizzo", "endereço", "servidor", "serveur", "gateway", "subnet", "dns", "ping", "client"),
    "card": ("card", "visa", "credit", "debit", "payment", "mastercard", "amex", "karte", "zahlung", "carte", "paiement", "tarjeta", "pago", "carta", "pagamento", "cartão", "cvv", "expir"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp", "sms", "telefon", "anruf", "handy", "téléphone", "appel", "portable", "teléfono", "llam", "móvil", "chiam", "ligue", "celular"),
}
AGAINST = ("version", "isbn", "issn", "doi", "order", "invoice", "serial", "sha", "hash", "token", "part no", "figure", "table", "chapter", "section", "page", "build", "release", "sku", "model", "patent", "case no", "ref.", "bestell", "rechnung", "commande", "facture", "pedido", "factura")
LABELERS = ("pattern", "checked", "gazetteer", "context for", "context against", "around")


def luhn(digits: str) -> bool:
    values = [int(c) for c in digits[::-1]]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, in linear time: a match can only be at an @."""
    pos = 0
    while (at := text.find("@", pos)) >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        pos = found.end() if found else at + 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def strict(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, passes its check) of all matches of the strict patterns."""
    out = [(0, a, b, True) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            out.append((1, m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19:
                out.append((2, m.start(), m.end(), luhn(d)))
        if "+" in text:
            for m in _PHONE.finditer(text):
                out.append((3, m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15))
    return out


def loose(text: str) -> list[tuple[int, int, int]]:
    out = []
    if "(" in text or "[" in text:
        out += [(0, m.start(), m.end()) for m in _AT.finditer(text)]
    if _DIGIT.search(text):
        if ":" in text:
            out += [(1, m.start(), m.end()) for m in _LOOSE_IP.finditer(text)]
        out += [(2, m.start(), m.end()) for m in _LOOSE_CARD.finditer(text)]
        out += [(3, m.start(), m.end()) for m in _LOOSE_PHONE.finditer(text)]
    return out


def votes(text: str, kind: int, start: int, end: int, passes: bool | None) -> list[int]:
    """One vote of each labeler: 1 for, -1 against, 0 none. passes is None for a match of a looser pattern."""
    span, name = text[start:end], KINDS[kind]
    digits = _digits(span)
    pattern = 1 if passes else 0 if passes is None else -1
    if name == "card":
        checked = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[:1] in ("3", "4", "5", "6") else -1
    elif name == "phone":
        checked = 1 if 10 <= len(digits) <= 13 else -1 if not 7 <= len(digits) <= 15 else 0
        gazetteer = 1 if span.startswith("+") and digits.startswith(CALLING_CODES) else 0
    elif name == "ip":
        parts = span.split(".")
        checked = 1 if len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) or ":" in span else -1
        gazetteer = -1 if parts[0] in ("0", "00", "000") or span.startswith("255.255") else 1 if len(parts) == 4 and all(len(p) == len(str(int(p))) for p in parts if len(p) < 9) else 0
    else:
        tail = re.split(r"[^A-Za-z0-9]+", span)[-1].lower()
        checked = 1 if ".." not in span and not span.startswith(".") else -1
        gazetteer = 1 if tail in DOMAINS or len(tail) == 2 and tail.isalpha() else -1 if tail.isdigit() else 0
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    near = before + " " + after
    context_for = 1 if any(w in near for w in FOR[name]) else 0
    context_against = -1 if any(w in before for w in AGAINST) else 0
    around = -1 if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum() else 0
    return [pattern, checked, gazetteer, context_for, context_against, around]


#: Values that each feature of shape() can have.
SHAPE = (4, 2, 2, 2, 3, 3, 3)


def shape(text: str, start: int, end: int) -> list[int]:
    """Features that no labeler sees: length, kinds of separators, the share of digits, and what stands right before and after."""
    span = text[start:end]
    kind = lambda c: 0 if not c or c.isspace() else 1 if c.isalnum() else 2
    digits = sum(c.isdigit() for c in span)
    return [min(3, (end - start) // 8), int(" " in span), int("-" in span), int("." in span), 0 if not digits else 2 if 2 * digits > end - start else 1, kind(text[start - 1 : start]), kind(text[end : end + 1])]


def _code(kind: int, v: list[int], s: list[int]) -> int:
    code = kind
    for x in v:
        code = code * 3 + x + 1
    for x, n in zip(s, SHAPE, strict=True):
        code = code * n + x
    return code


def _decode(code: int) -> tuple[int, list[int], list[int]]:
    s, v = [], []
    for n in reversed(SHAPE):
        code, x = divmod(code, n)
        s.insert(0, x)
    for _ in LABELERS:
        code, x = divmod(code, 3)
        v.insert(0, x - 1)
    return code, v, s


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("code", pa.int32())]))
_SPAN_DDL = "array<struct<start:bigint,kind:int,end:bigint,base:boolean,code:int>>"


def candidates(text: str | None) -> list[dict]:
    """All candidates of a text; those of looser patterns only where no strict match that passes its check lies."""
    if not text:
        return []
    first = strict(text)
    kept = _Taken((a, b) for _, a, b, ok in first if ok)
    out = [(k, a, b, ok, True) for k, a, b, ok in first]
    seen = {(k, a, b) for k, a, b, _ in first}
    for k, a, b in loose(text):
        if (k, a, b) not in seen:
            out.append((k, a, b, False, False))
    spans = []
    for k, a, b, ok, is_strict in out:
        if not ok and kept.meets(a, b):
            continue
        code = _code(k, votes(text, k, a, b, ok if is_strict else None), shape(text, a, b))
        spans.append({"start": a, "kind": k, "end": b, "base": ok, "code": code})
    return spans


class _Taken:
    """Spans that stay, and whether another one meets any of them: by the furthest end of all that start before its own end."""

    def __init__(self, spans):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))

    def meets(self, a: int, b: int) -> bool:
        at = bisect_left(self.starts, b)
        return at > 0 and self.ends[at - 1] > a


def estimate(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Chance that each code's candidates are personal data: EM over vote patterns, with a reliability of each labeler for each kind."""
    chance: dict[int, float] = {}
    for kind in range(len(KINDS)):
        rows = [(c, n, v) for c, n in counts.items() for k, v, _ in [_decode(c)] if k == kind]
        if not rows:
            continue
        weight = np.array([n for _, n, _ in rows], float)
        seen = np.stack([[[v[j] == x for x in (-1, 0, 1)] for j in range(len(LABELERS))] for _, _, v in rows]).astype(float)
        p = 1 / (1 + np.exp(-1.5 * np.array([sum(v) for _, _, v in rows], float)))
        for _ in range(rounds):
            yes, no = weight * p, weight * (1 - p)
            # a prior of some votes keeps each labeler better than chance
            t1 = np.einsum("r,rlv->lv", yes, seen) + np.array([0.5, 1.0, 1.5])
            t0 = np.einsum("r,rlv->lv", no, seen) + np.array([1.5, 1.0, 0.5])
            t1, t0 = t1 / t1.sum(1, keepdims=True), t0 / t0.sum(1, keepdims=True)
            prior = (yes.sum() + 1) / (weight.sum() + 2)
            logit = np.log(prior / (1 - prior)) + np.einsum("rlv,lv->r", seen, np.log(t1) - np.log(t0))
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        chance |= {c: float(x) for (c, _, _), x in zip(rows, p, strict=True)}
    return chance


def _features(code: int) -> np.ndarray:
    kind, v, s = _decode(code)
    row = [1.0]
    for k in range(len(KINDS)):
        on = float(k == kind)
        row += [on, *(on * x for x in v), on * s[0] / 3, *(on * x for x in s[1:4]), *(on * float(x == y) for x in s[4:] for y in (1, 2))]
    return np.array(row)


def train(counts: dict[int, int], steps: int = 300) -> dict[int, float]:
    """The span classifier's chance for each code: logistic regression on the estimated chances, by weighted Newton-like steps."""
    if not counts:
        return {}
    codes = sorted(counts)
    target = estimate(counts)
    x = np.stack([_features(c) for c in codes])
    y, w = np.array([target[c] for c in codes]), np.array([counts[c] for c in codes], float)
    w = np.sqrt(w) / np.sqrt(w).sum()
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + 1e-4 * beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x + 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return dict(zip(codes, p.tolist(), strict=True))


class _Accepted:
    """The codes that the trained classifier accepts, and the spans of a batch that they or the strict rules keep."""

    def __init__(self, codes: list[int]):
        self.codes = np.array(sorted(codes), np.int64)

    def keep(self, spans: pa.ListArray) -> pa.ListArray:
        each = spans.flatten()
        good = np.asarray(each.field("base").fill_null(False), bool) | np.isin(np.asarray(each.field("code"), np.int64), self.codes)
        offsets = np.concatenate([[0], np.cumsum(good)])[np.concatenate([[0], np.cumsum(np.asarray(spans.value_lengths().fill_null(0)))])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each.filter(pa.array(good)))


def _judged(docs: DataFrame, carry: list[str]):
    """The stored candidates of each text, after the columns carry, the name of their column, and the accepted codes as a broadcast."""
    name = common.unlike(carry, "spans")[0]
    schema = T.StructType(common.pick(docs, *carry).schema.fields + T.StructType.fromDDL(f"{name} {_SPAN_DDL}").fields)
    width, at = len(carry), carry.index("text") if "text" in carry else len(carry)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [candidates(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), pa.array(found, _SPAN)], [*carry, name])

    source = common.pick(docs, *carry) if "text" in carry else docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").alias(common.unlike(carry, "text")[0]))
    made = common.materialize(source.mapInArrow(scan, schema), "spans")
    counts = {r["code"]: r["count"] for r in made.select(F.explode(F.col(name)["code"]).alias("code")).groupBy("code").count().collect()}
    return made, name, docs.sparkSession.sparkContext.broadcast(_Accepted([c for c, p in train(counts).items() if p >= ACCEPT]))


def find(docs: DataFrame, *carry: str) -> DataFrame:
    """Columns carry of docs, then spans: all candidates of each text that are accepted, sorted by start and kind.

    A span has start, kind (index into KINDS), end, base (a strict match that passes its check) and code. Offsets count code points,
    ends are exclusive. Null text counts as empty; repeated rows get the same spans; empty tables give no rows; columns that aren't in
    carry are ignored; where one in carry is called spans, the last column is _spans. Texts are read whole, one at a time. The corpus
    is read once; its candidates are kept as a table for the second step, to which the accepted codes are broadcast: a code is a kind
    and what labelers and features say, so there are no more of them than such patterns, four bytes each.
    """
    made, name, accepted = _judged(docs, list(carry))

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], accepted.value.keep(batch.columns[-1])], batch.schema.names)

    return made.mapInArrow(accept, made.schema).withColumn(name, F.array_sort(F.col(name)))


def written(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def mask(docs: DataFrame) -> DataFrame:
    """docs with each accepted span of text replaced by <KIND>, spans that overlap by the first one's; same columns, n_chars counted anew.

    Null and empty texts stay as they are, repeated rows are masked alike, an empty table gives an empty one. Texts are masked whole;
    further columns keep their values, whatever they are called.
    """
    columns = docs.columns
    made, _, accepted = _judged(docs, columns)
    at = columns.index("text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(accepted.value.keep(batch.column(len(columns))).to_pylist()):
                if spans:
                    parts, pos = [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], s["kind"], s["end"])):
                        if s["start"] >= pos:
                            parts += [texts[i][pos : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                            pos = s["end"]
                        elif s["end"] > pos:
                            pos = s["end"]
                    texts[i] = "".join([*parts, texts[i][pos:]])
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    out = made.mapInArrow(put, docs.schema)  # accepted and masked in one pass, by one worker
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), "doc_id").withColumn("b", F.filter("spans", lambda s: s["base"]))
    count = lambda k: F.size(F.filter("b", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(written(F.col("b")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
