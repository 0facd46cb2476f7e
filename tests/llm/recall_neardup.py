"""Recall of near-duplicate classes against an exact comparison; run by hand: python -m tests.llm.recall_neardup [folder of tables].

All links between different texts of a weighted Jaccard similarity of 0.8 or more are found by prefixes: shingles are ordered by how
many texts hold them, and two similar texts share one of those that make up the rarest part of each. Prints the links, how many lie
within a class, those that don't with their similarity, and links within classes that are only held together over others.
"""

import math
import os
import sys
from collections import Counter, defaultdict

from tests.llm.test_neardup import tokens

THRESHOLD = 0.8


def exact_links(texts):
    """(i, j, similarity) of all pairs of different texts of at least the threshold."""
    toks = [tokens(t) for t in texts]
    bags = [Counter(t[j : j + 5] for j in range(len(t) - 4)) if len(t) >= 5 else Counter([t]) if t else Counter() for t in toks]
    df = Counter(s for b in bags for s in b)
    weight = {s: 1 + math.log((1 + len(texts)) / (1 + n)) for s, n in df.items()}
    vectors = [{s: c * weight[s] for s, c in b.items()} for b in bags]
    total = [sum(v.values()) for v in vectors]
    holders, found = defaultdict(list), {}
    for i, v in enumerate(vectors):
        left, mine = total[i], set()
        for s in sorted(v, key=lambda s: (df[s], s)):
            if left < THRESHOLD * total[i] - 1e-9:  # what is left can't be a similar text's whole overlap
                break
            left -= v[s]
            if df[s] > 1:
                mine.update(holders[s])
                holders[s].append(i)
        for j in mine:
            if min(total[i], total[j]) < THRESHOLD * max(total[i], total[j]) - 1e-9:
                continue
            small, large = (v, vectors[j]) if len(v) < len(vectors[j]) else (vectors[j], v)
            low = sum(min(x, large.get(s, 0.0)) for s, x in small.items())
            similar = low / (total[i] + total[j] - low)
            if similar >= THRESHOLD:
                found[j, i] = similar
    return found, toks


def main(folder):
    from pyspark.sql import SparkSession

    from tesserae.llm import neardup

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").getOrCreate()
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("text <> ''").groupBy("text").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "doc_id").select("doc_id", "text")
    rows = docs.collect()
    links, toks = exact_links([r["text"] for r in rows])
    of = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    key = lambda i: of[rows[i]["doc_id"]]
    lost = {p: s for p, s in links.items() if key(p[0]) != key(p[1])}
    equal = sum(toks[i] == toks[j] for i, j in links)
    print(f"texts {len(rows)}, links {len(links)} (of equal tokens {equal}), within classes {len(links) - len(lost)}, recall {1 - len(lost) / max(1, len(links)):.4f}")
    for (i, j), s in sorted(lost.items(), key=lambda x: -x[1])[:50]:
        print("lost", rows[i]["doc_id"], rows[j]["doc_id"], round(s, 4))
    # what the classes join must be joined by links
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in links:
        root[find(i)] = find(j)
    wrong = sum(1 for i in range(len(rows)) if of[rows[i]["doc_id"]] != rows[i]["doc_id"] and find(i) != find(next(k for k in range(len(rows)) if rows[k]["doc_id"] == key(i))))
    print(f"texts in a class that no chain of links leads to: {wrong}")
    spark.stop()


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
