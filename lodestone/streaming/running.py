"""Structured Streaming: running sufficient statistics, windowed counts with late data, and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_statistics(stream: DataFrame, keys: Sequence[str], value: str, pass_value: float) -> DataFrame:
    """Count, sum and passes by key so far: algebraic sums, so state is one row a key."""
    return stream.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.count_if(F.col(value) >= pass_value).alias("passed"))


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Event times without a zone are the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts by time window; rows later than ``late`` are left out and their state is dropped."""
    return _timed(stream, time).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), *keys, "n")


def first_seen(stream: DataFrame, time: str, late: str, keys: Sequence[str]) -> DataFrame:
    """Each key once within the lateness bound."""
    return _timed(stream, time).withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Work off what is there now into an in-memory table (tests and small reports)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
