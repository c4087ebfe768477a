"""Places for files that a query writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``; our own where that is unset, on a local master only).

    It is removed when the driver ends, or earlier by ``clear``.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(there)
    path = f"{there.rstrip('/')}/{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as written to a scratch path: it is computed once, and what is lost is read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; its folder goes with it
            return


atexit.register(clear)
