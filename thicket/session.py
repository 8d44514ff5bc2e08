"""Storage that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_used: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the session's checkpoint folder, removed when the driver ends.

    A local folder serves a local session that names none; on a cluster it would be lost to others, so that is an error.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints/thicket")
        found = spark.sparkContext.getCheckpointDir()
    own = f"{found.rstrip('/')}/thicket-{spark.sparkContext.applicationId}"
    if own not in _used:
        _used.add(own)
        atexit.register(_remove, own)
    return own


def _remove(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):
            drop(spark, path)


def materialised(df: DataFrame, keep: list | None = None) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, a lost executor loses no result, and partition ids stay as they were.

    keep collects the paths, so that a loop can drop() what it no longer reads.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
