"""Checks that stop with an error, and the rows that break them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_none(bad: DataFrame, message: str) -> None:
    some = bad.limit(3).collect()
    if some:
        raise ValueError(f"{message}: {some}")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> None:
    require_none(repeated_keys(df, keys), f"{keys} repeat")


def broken_slots(df: DataFrame, task: list[str]) -> DataFrame:
    """Tasks whose slots aren't 0 .. k - 1, each once."""
    sound = (F.min("slot") == 0) & (F.max("slot") == F.count("*") - 1) & (F.count_distinct("slot") == F.count("*"))
    return df.groupBy(*task).agg(sound.alias("sound")).where(~F.col("sound"))


def require_aligned(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> None:
    """Both sides have the same keys, and equal fields (nulls equal) for each."""
    right = right.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields]).withColumn("_there", F.lit(1))
    both = left.select(*keys, *fields).withColumn("_here", F.lit(1)).join(right, keys, "full_outer")
    unlike = F.lit(False)
    for f in fields:
        unlike = unlike | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    require_none(both.where(F.col("_here").isNull() | F.col("_there").isNull() | unlike), "not aligned")


def assert_close(left, right, rel: float = 1e-9, abs_: float = 1e-8, at: str = "") -> None:
    """Recursive comparison on the driver: floats within a tolerance, all else exactly."""
    if isinstance(left, dict) and isinstance(right, dict) and set(left) == set(right):
        for k in left:
            assert_close(left[k], right[k], rel, abs_, f"{at}.{k}")
    elif isinstance(left, (list, tuple)) and isinstance(right, (list, tuple)) and len(left) == len(right):
        for i, (a, b) in enumerate(zip(left, right, strict=True)):
            assert_close(a, b, rel, abs_, f"{at}[{i}]")
    elif isinstance(left, float) and isinstance(right, float) and math.isclose(left, right, rel_tol=rel, abs_tol=abs_):
        return
    elif type(left) is not type(right) or left != right:
        raise AssertionError(f"{at}: {left!r} is not {right!r}")


def compare_tables(left: DataFrame, right: DataFrame, keys: list[str], rel: float = 1e-9, abs_: float = 1e-8) -> DataFrame:
    """Rows of two tables that differ: those on one side only, and fields off by more than a tolerance. Empty when they agree."""
    fields = [c for c in left.columns if c not in keys]
    other = right.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields]).withColumn("_there", F.lit(1))
    both = left.withColumn("_here", F.lit(1)).join(other, keys, "full_outer")
    kinds = dict(left.dtypes)
    unlike = F.col("_here").isNull() | F.col("_there").isNull()
    for c in fields:
        a, b = F.col(c), F.col(f"_{c}")
        if kinds[c] in ("double", "float"):
            far = F.abs(a - b) > F.greatest(F.lit(abs_), F.lit(rel) * F.greatest(F.abs(a), F.abs(b)))
            unlike = unlike | (a.isNull() != b.isNull()) | F.coalesce(far, F.lit(False))
        else:
            unlike = unlike | ~a.eqNullSafe(b)
    return both.where(unlike)
