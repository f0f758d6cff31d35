"""Points added by a stream, each of which counts once whatever fails.

A micro-batch's points are written to a folder of the batch's own number, which
a retry of the batch overwrites; the checkpoint says which batches are done.
A later batch's point replaces an earlier one of the same key when points are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_of(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int | None = None) -> DataFrame:
    """The Parquet files of a folder as a stream, or one file that is given by its name."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jvm).isFile():
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def add_points(stream: DataFrame, path: str, checkpoint: str, points: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> None:
    """Write the points of all that the stream has now to ``path``, and return when that is done.

    ``points`` makes points of a micro-batch. After a failure the same call goes on where the checkpoint says; the batch
    that failed is written again over what it had written. A stream that is aggregated itself takes ``mode`` update.
    """

    def write(batch: DataFrame, number: int) -> None:
        (points(batch) if points else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_points(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The points written to ``path``, of each key the one of its latest batch; an empty table if nothing is written but batches without points."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    values = [c for c in rows.columns if c not in [*keys, "batch"]]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("point"))
    return latest.select(*keys, "point.*")


def remaining(grid: DataFrame, spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The points of ``grid`` that have not been written yet: what a resumed run has to do."""
    return grid.join(read_points(spark, path, keys).select(*keys), keys, "left_anti")
