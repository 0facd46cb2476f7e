"""The corpus pipeline: language filter, near-duplicate removal, decontamination, masking of personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last one with the columns of documents. A stage that reads
its documents more than once expects them to be stored; run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common, langid, neardup, packing, personal, tiling


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter. Labels are learned from the documents themselves.

    Texts of every language stay, very long ones are read whole, repeated rows stay or go together, null ids stay, an empty table
    gives an empty one; further columns stay as they are.
    """
    names = common.unlike(docs.columns, "lang_pred", "score")
    found = langid.identify(docs, *langid.train(docs), carry=docs.columns, names=tuple(names))
    # where no labels are, nothing is learned: texts with letters stay nevertheless
    return common.pick(found.where((F.col(names[0]) != "und") | F.col("text").rlike(r"\p{L}")), *docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays. Documents without an id stay.

    Rows of one id and text are one document; where an id has several texts, each is a document of its own, and of a class the
    smallest (id, text) stays. Of repeated rows that differ in further columns the one with the smallest values stays.
    """
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = neardup.classes(docs, level=True).where(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
        return docs.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held, row, group = common.unlike(docs.columns, "_rest", "_row", "class_id")
    fields = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)]
    known = docs.where("doc_id IS NOT NULL").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("none"), *fields)).alias(held))
    known = known.select("doc_id", "text", *[F.col(held)[f"c{k}"].alias(c) for k, c in enumerate(rest)])
    each = common.materialize(known.unionByName(docs.where("doc_id IS NULL")).withColumn(row, F.monotonically_increasing_id()), "rows")
    found = neardup.classes(each.select(F.col(row).alias("doc_id"), "text"), level=True).select(F.col("doc_id").alias(row), F.col("class_id").alias(group))
    first = each.where("doc_id IS NOT NULL").join(found, row).groupBy(group).agg(F.min_by(row, F.struct("doc_id", "text")).alias(row))
    return common.pick(each.join(first.select(row), row, "left_semi").unionByName(each.where("doc_id IS NULL")), *docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go.

    Null and empty texts cover none and stay, and so do all where the benchmark is empty; repeated rows stay or go together; texts
    are read whole, however long; columns stay as they are.
    """
    return tiling.uncontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked. Every row stays, with null and empty texts as they are; n_chars is counted anew."""
    return personal.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences, one row for each piece.

    A null or empty text is a piece of one token, a very long one has many pieces, repeated rows are packed each, an empty table
    gives no rows, and further columns are left out.
    """
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: Shingling, sampling, tiling and estimation can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over all documents. What a stage has written for itself goes when its rows are stored."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = common.made()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            own = [path for path in common.made() if path not in before]
            docs = common.materialize(docs, name)
            common.release(spark, own)
    return docs
