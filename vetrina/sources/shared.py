"""Intermediate tables in the folder that driver and executors share, and the disk that making them takes."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def one_jvm(spark: SparkSession) -> bool:
    """Whether driver and executors are the same process."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session of one JVM may do without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not one_jvm(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_GUARD = threading.Lock()
#: By session: how many are within ``freed``, and the setting that comes back.
_WITHIN: dict[str, list] = {}


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when it ends. Else they stay until the driver collects garbage, and the disk
    holds those of a whole import at once. The session's own setting comes back."""
    session = spark._jsparkSession.sessionUUID()
    with _GUARD:
        own = _WITHIN.setdefault(session, [0, spark.conf.get(_CLEANUP, None)])
        own[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _GUARD:
            own[0] -= 1
            if not own[0]:
                del _WITHIN[session]
                spark.conf.unset(_CLEANUP) if own[1] is None else spark.conf.set(_CLEANUP, own[1])


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: several readers share it, and its lineage ends there."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/vetrina/table-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(schema).parquet(path)
