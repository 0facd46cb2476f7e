"""File sources and sinks with fixed schemas that fail on what they don't expect."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file (plain or gzip) with a header of exactly these columns, all as strings; ragged rows and other headers are errors.

    A gzip file is one task; rows are dealt anew after it.
    """
    head = spark.read.option("header", False).option("multiLine", True).csv(path).limit(1).first()
    names = [] if head is None else list(head)
    if names != columns:
        raise ValueError(f"header {names} is not {columns}")
    schema = ", ".join(f"`{c}` string" for c in columns)
    out = spark.read.csv(path, header=True, schema=schema, multiLine=True, mode="FAILFAST", enforceSchema=False, quote='"', escape='"')
    return out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if path.endswith(".gz") else out


def project_csv(spark: SparkSession, path: str, columns: list[str], keep: list[str], out: str) -> None:
    """Write some columns of a CSV file anew, in the order of keep; unknown or repeated names are errors."""
    if len(set(keep)) != len(keep) or not set(keep) <= set(columns):
        raise ValueError("columns to keep must be distinct and known")
    read_csv(spark, path, columns).select(*[f"`{c}`" for c in keep]).write.csv(out, header=True)


def bit(column: Column) -> Column:
    """0 or 1 from exactly 'True', 'False', '1' or '0'; null for all else (not Spark's wider boolean cast)."""
    return F.when(column.isin("True", "1"), 1).when(column.isin("False", "0"), 0)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A run table: identities are not empty, bits are bits, slots of a task are unique and run from 0."""
    from tesserae.operators import validation

    columns = ["run", "domain", "task_id", "criterion_id", "criterion_index", "category", "provider", "model", "gold", "prediction"]
    rows = read_csv(spark, path, columns)
    empty = [F.coalesce(F.trim(c), F.lit("")) == "" for c in ("run", "task_id", "criterion_id")]
    out = rows.select("run", "domain", "task_id", "criterion_id", F.expr("try_cast(criterion_index AS INT)").alias("slot"), "category", bit(F.col("gold")).alias("gold"), bit(F.col("prediction")).alias("prediction"))
    validation.require_none(rows.where(empty[0] | empty[1] | empty[2]), "empty identity")
    validation.require_none(out.where("gold IS NULL OR prediction IS NULL OR slot IS NULL OR slot < 0"), "not a bit or slot")
    validation.require_unique(out, ["run", "task_id", "slot"])
    validation.require_unique(out, ["run", "task_id", "criterion_id"])
    validation.require_none(validation.broken_slots(out, ["run", "task_id"]), "slots are not contiguous")
    return out


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """The top-level entries of JSON objects, a file each: file, key, n (how often the key occurs).

    Spark's reader would drop repeated keys unseen; json_object_keys doesn't.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    keys = whole.select("file", "value", F.explode(F.expr("json_object_keys(value)")).alias("key"))
    return keys.groupBy("file", "key").agg(F.count("*").alias("n"))


def reject_repeated_keys(pairs: list[tuple]) -> dict:
    """object_pairs_hook for json.loads: a repeated key is an error."""
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated JSON key")
    return out


def score_status(value: Column) -> Column:
    """What may be said of a raw JSON score without its value: present, error, missing or unparseable. Booleans are unparseable."""
    text = F.trim(value)
    plain = text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")
    as_number = text.try_cast("double")
    return F.when(value.isNull() | (text == "null"), "missing").when(text == '"ERR"', "error").when(plain & as_number.between(0, 1), "present").otherwise("unparseable")


def write_json_receipt(path: str, content: dict) -> None:
    """A receipt on the driver: sorted keys, no NaN, put in place by a rename."""
    with open(path + ".partial", "w", encoding="utf-8") as f:
        json.dump(content, f, sort_keys=True, indent=1, allow_nan=False)
    os.replace(path + ".partial", path)


def write_rows(df: DataFrame, path: str, *partition_by: str) -> int:
    """Write Parquet, and return the number of rows, counted on the way."""
    from pyspark.sql import Observation

    seen = Observation("rows")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy(*partition_by).parquet(path)
    return seen.get["n"]
