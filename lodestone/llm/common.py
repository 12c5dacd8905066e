"""What the operators of this subpackage share: scratch tables, sized broadcasts, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as the characters themselves.
WORD_SPACE = " \t\n\x0b\x0c\r"

#: A side of a join is broadcast up to this many rows of a few fixed-width columns.
BROADCAST_ROWS = 200_000

#: Of a batch of rows that a Python worker gets.
BATCH_BYTES = 4 << 20

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where neither the session nor its context names one, a local session gets a
    temporary folder, once per application; on a cluster that raises, as
    executors wouldn't see it.
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


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of rows for Python workers hold ``BATCH_BYTES`` at most, or what the session says if that is less; set for this time only.

    Batches of 10,000 whole texts otherwise grow the memory of the JVM outside
    its heap, and of the workers.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    if old is None or not old.isdigit() or int(old) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def released(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task``, a function of a Python worker from batches to batches, that gives Arrow's unused memory back at its end.

    Workers are kept for later tasks, beside an executor whose JVM needs the room.
    """

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage and fixes the rows: tasks that are run again after the
    loss of an executor read the same files.
    """
    path = scratch_path(df.sparkSession, name)
    with bounded_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once their results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count finds it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_join(rows: DataFrame, side: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row a key, or none (nulls).

    A counted small side is broadcast.  Otherwise the rows of a key are dealt to
    ``salts`` tasks, each with its own copy of the side's row.
    """
    small = sized(side)
    if small is not side:
        return rows.join(small, key, "left")
    spread = F.sequence(F.lit(0), F.lit(salts - 1))
    dealt = side.withColumn("_salt", F.explode(spread))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c != key]), F.lit(salts)).cast("int")).join(dealt, [key, "_salt"], "left").drop("_salt")


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys in which nulls are equal."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond
