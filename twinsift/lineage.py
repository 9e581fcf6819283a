"""Tables written between the steps of a job.

A staged table cuts the lineage like ``DataFrame.checkpoint`` does, but is computed
once, stays columnar and can be dropped. It lives under ``spark.checkpoint.dir``,
the folder every executor reaches, so losing an executor costs no staged work.
"""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, or else a folder below its warehouse; both are shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/twinsift/{name}-{uuid.uuid4().hex}"


_staged: list[list[str]] = []
# Seconds between two calls of the collector.
COLLECT_S = 3.0
_collected = 0.0


@contextmanager
def temporary(spark: SparkSession):
    """Remove the tables staged inside when the block ends; its results must be written by then."""
    _staged.append([])
    try:
        yield
    finally:
        for path in _staged.pop():
            drop(spark, path)


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, compressed well as it is read only a few times, and read it back."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    if _staged:
        _staged[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    _collect(spark)
    return spark.read.schema(df.schema).parquet(path)


def _collect(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that have ended.

    It does so when the driver's collector finds their plans unused, and that can take until the end of a job.
    """
    global _collected
    if time.monotonic() - _collected >= COLLECT_S:
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def drop(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
