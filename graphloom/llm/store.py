"""Batches of bounded size; the written tables are those of ``graphloom.storage``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.storage import new_path, release, shared_dir, staged

__all__ = ["by_bytes", "new_path", "release", "shared_dir", "staged"]


def by_bytes(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """``df``, with Arrow batches to Python bounded in bytes, not only in rows: long texts would fill a worker's memory.

    Sets the session's ``spark.sql.execution.arrow.maxBytesPerBatch`` unless it is lower already.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= most:
        conf.set(name, str(most))
    return df
