import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu") for b in ("n", "ra", "sti", "tol", "ver", "wix", "yo", "zam", "qe", "p")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, langs=None, ids=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs):
    """The same documents with more columns, called like what operators use inside."""
    from pyspark.sql import functions as F

    names = ["block", "bucket", "kind", "payload", "row", "spans", "rank", "salt", "score", "lang_pred", "text_key", "class_id", "band", "a", "b", "length", "count"]
    return docs.withColumns({n: F.lit("x") for n in names})


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def mixed(seed: int = 7):
    """Null, empty, blank, long and repeated texts, copies, near copies and shared passages."""
    rng = random.Random(seed)
    passage, base = prose(rng, 90), prose(rng, 150)
    near = base.split()
    near[40] = "changed"
    texts = [None, "", " \n\t ", "one", "a b c d", base, base, " ".join(near), passage + " " + prose(rng, 60), prose(rng, 30) + " " + passage, "x " * 900, prose(rng, 4000), prose(rng, 25), "é ü ñ " * 150, "é ü ñ " * 150 + "end"]
    return texts + [prose(rng, rng.randint(1, 120)) for _ in range(12)] + [passage]
