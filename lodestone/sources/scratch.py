"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many rows of a few fixed-width columns.
BROADCAST_ROWS = 200_000

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session or its context; a temporary folder for a local session that names none.

    On a cluster a missing name raises: executors wouldn't see the driver's own
    folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _OWN_DIRS:
        _OWN_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(_OWN_DIRS[sc.applicationId])
    return _OWN_DIRS[sc.applicationId]


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"


def _store(spark: SparkSession):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def kept(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` written as Parquet and read again: what follows starts from the table, also when an executor is lost.

    With ``free`` the driver collects its garbage then, by which Spark deletes
    the shuffles that led to the table; for large ones.
    """
    path = f"{_own(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if free:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_exists(spark: SparkSession) -> bool:
    store, path = _store(spark)
    return store.exists(path)


def drop_kept(spark: SparkSession) -> None:
    """Delete this application's tables, once what was made of them is written."""
    store, path = _store(spark)
    store.delete(path, True)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count finds it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
