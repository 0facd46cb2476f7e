"""Tables written to the folder that driver and executors share, so that a plan is cut and survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder given to setCheckpointDir; a local master without either gets one that goes with Python."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if place:
        return place.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share: master is {master}")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tesserae-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which made() lists from now on."""
    path = f"{shared_dir(spark)}/tesserae/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once and read from there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """The folders that queries have written for themselves and nothing has removed."""
    return list(_made)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove such folders (all that there are, unless some are named), once the results that read them have been read or written."""
    for path in made() if paths is None else paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _made.remove(path)
