"""A budget ledger over a stream of reservations (an extension: batches stand for polls, and files for the queue)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def run_ledger(spark: SparkSession, source: str, out: str, checkpoint: str, cap: int, schema: str = "account string, job_id string, cost long") -> None:
    """Admit jobs from Parquet files in source while their account's admitted cost stays within cap; available input, then stop.

    Each micro-batch is one append to `out`, named by its number, so a batch that is replayed after a crash replaces its own rows. A
    job_id that has been admitted before is not admitted again. Costs of refused jobs aren't charged.
    """

    def batch(rows: DataFrame, number: int) -> None:
        try:
            past = spark.read.parquet(out).where(F.col("batch") < number)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            past = None
        rows = rows.dropDuplicates(["job_id"])
        if past is not None:
            rows = rows.join(past.where("admitted").select("job_id"), "job_id", "left_anti")
            rows = rows.join(past.where("admitted").groupBy("account").agg(F.sum("cost").alias("spent")), "account", "left")
        else:
            rows = rows.withColumn("spent", F.lit(0).cast("long"))
        before = F.coalesce("spent", F.lit(0)) + F.sum("cost").over(W.partitionBy("account").orderBy("cost", "job_id").rowsBetween(W.unboundedPreceding, W.currentRow))
        done = rows.withColumn("admitted", before <= cap).select("account", "job_id", "cost", "admitted")
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
