"""Learned buckets and categorical levels, histograms and calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNSEEN = -1


def fit_top(df: DataFrame, code: str, n: int = 5) -> DataFrame:
    """``code, n_rows`` of the most frequent codes; of equals the smallest."""
    counts = df.where(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("n_rows"))
    order = Window.orderBy(F.col("n_rows").desc(), F.col(code))  # one row a code
    return counts.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def apply_top(df: DataFrame, top: DataFrame, known: DataFrame, code: str, out: str, other: str = "other", missing: str = "missing") -> DataFrame:
    """Frequent codes keep themselves, other known ones are ``other``; NULL and codes never seen are ``missing``."""
    t = F.broadcast(top.select(F.col(code), F.lit(True).alias("_top")))
    k = known.where(F.col(code).isNotNull()).select(code).distinct().withColumn("_known", F.lit(True))
    rows = df.join(t, code, "left").join(k, code, "left")
    return rows.withColumn(out, F.when(F.col("_top"), F.col(code).cast("string")).when(F.col("_known"), other).otherwise(missing)).drop("_top", "_known")


def label_collisions(top: DataFrame, code: str, reserved: Sequence) -> DataFrame:
    """Codes that equal a reserved label: there must be none."""
    return top.where(F.col(code).isin(*reserved))


def learn_levels(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def apply_levels(df: DataFrame, levels: DataFrame, column: str, unseen=UNSEEN) -> DataFrame:
    """Values outside the learned levels, and missing ones, become ``unseen``."""
    side = levels.select(F.col(column).alias("_v"))
    out = df.join(side, F.col(column) == F.col("_v"), "left")
    return out.withColumn(column, F.coalesce(F.col("_v"), F.lit(unseen).cast(levels.schema[column].dataType))).drop("_v")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """``bin, n``: equal bins from ``low`` to ``high``, the last closed."""
    b = F.least(F.greatest(F.floor((F.col(value) - low) * bins / (high - low)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def quantile_edges(df: DataFrame, value: str, q: int = 10) -> DataFrame:
    """One row: the exact inner edges ``e1..`` of ``q`` equally filled bins."""
    p = F.percentile(value, F.array(*[F.lit(i / q) for i in range(1, q)])).alias("e")
    return df.agg(p).select(*[F.col("e")[i - 1].alias(f"e{i}") for i in range(1, q)])


def quantile_bin(value: Column, q: int = 10) -> Column:
    """Right-closed bin of a value by edges ``e1..``; equal values share a bin."""
    return sum([(value > F.col(f"e{i}")).cast("int") for i in range(1, q)], F.lit(0))


def calibration(df: DataFrame, predicted: str, actual: str, q: int = 10) -> DataFrame:
    """Per quantile bin of the prediction: rows, mean prediction, mean outcome."""
    out = df.crossJoin(F.broadcast(quantile_edges(df, predicted, q))).withColumn("bin", quantile_bin(F.col(predicted), q))
    return out.groupBy("bin").agg(F.count("*").alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(actual).alias("mean_actual"))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average rank of each value: ranks come from counts by value, so rows themselves aren't sorted in one place."""
    n = df.groupBy(column).agg(F.count("*").alias("_c"))
    upto = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = n.select(column, (F.sum("_c").over(upto) - (F.col("_c") - 1) / 2.0).alias(out))
    return df.join(ranks, column)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return average_ranks(average_ranks(rows, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("spearman"))
