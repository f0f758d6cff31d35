"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage: if an executor is lost, later stages reread the
files instead of recomputing. It also gives the optimizer the table's true
size, which a checkpointed frame does not: its estimate is that of its plan and
grows with every join of an iteration.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="graphloom-")
    spark.sparkContext.setCheckpointDir(f"file://{found}")
    return f"file://{found}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it reread."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more: a round of an iteration whose successor is written."""
    spark, path = df.sparkSession, df.written_at
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _written.remove(path)


def release(spark: SparkSession) -> None:
    """Delete the tables written so far; frames that read them are then of no more use."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
