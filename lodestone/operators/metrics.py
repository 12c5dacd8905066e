"""Exact classification and regression metrics as aggregations.

Ranking metrics work on the distinct scores of a group, summed first, so that
ties are exact and the window runs over sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by_score(df: DataFrame, score: Column, positive: Column, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, score.alias("_s")).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_q"))


def ranking(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC area and average precision of both classes; NULL where a class is missing."""

    def side(s: Column, positive: Column, auc: bool, name: str) -> DataFrame:
        t = _by_score(df, s, positive, by)
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
        down = w.orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        t = t.withColumns({"_tp": F.sum("_p").over(down), "_n": F.sum(F.col("_p") + F.col("_q")).over(down), "_ps": F.sum("_p").over(w), "_qs": F.sum("_q").over(w)})
        ap = F.sum(F.try_divide(F.col("_p") * F.col("_tp"), F.col("_ps") * F.col("_n")))
        cols = [ap.alias(name)]
        if auc:
            # a positive beats the negatives below it, and half of those at its score
            below = F.col("_qs") - (F.col("_n") - F.col("_tp"))
            cols.append(F.sum(F.try_divide(F.col("_p") * (below + F.col("_q") / 2.0), F.col("_ps") * F.col("_qs"))).alias("auc"))
        return t.groupBy(*by).agg(*cols)

    y = F.col(label) == 1
    a, b = side(F.col(score), y, True, "ap_positive"), side(-F.col(score), ~y, False, "ap_negative")
    return a.join(b, list(by)) if by else a.crossJoin(b)


def classification(df: DataFrame, score: str, label: str, threshold: float = 0.80, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts at a threshold, precision, recall and F1 of both classes, accuracy and Brier score."""
    y, p = F.col(label) == 1, F.col(score) >= threshold
    out = df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"), F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.withColumns(
        {
            "precision_pass": div(tp, tp + fp),
            "recall_pass": div(tp, tp + fn),
            "f1_pass": div(2 * tp, 2 * tp + fp + fn),
            "precision_fail": div(tn, tn + fn),
            "recall_fail": div(tn, tn + fp),
            "f1_fail": div(2 * tn, 2 * tn + fp + fn),
            "accuracy": div(tp + tn, tp + tn + fp + fn),
        }
    )


def regression(df: DataFrame, predicted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.sum(e * e).alias("_sse"), (F.var_pop(actual) * F.count(actual)).alias("_sst"))
    return out.withColumn("r2", 1 - F.try_divide("_sse", "_sst")).drop("_sse", "_sst")


def by_segment(df: DataFrame, segments: dict[str, Column]) -> DataFrame:
    """Rows once for each segment that they are in, as ``segment``."""
    return df.withColumn("segment", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in segments.items()]))))


def segment_auc(df: DataFrame, score: str, label: str, segments: dict[str, Column], least: int = 100) -> DataFrame:
    """ROC area by segment; segments of few rows or one class are left out."""
    rows = by_segment(df, segments)
    n = rows.groupBy("segment").agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positives"))
    n = n.where((F.col("n") >= least) & (F.col("positives") > 0) & (F.col("positives") < F.col("n")))
    return ranking(rows, score, label, ["segment"]).join(n, "segment").select("segment", "n", "positives", "auc")


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Counts and rates of the warned class (score below a threshold) at each threshold.

    Rows are counted once by the number of thresholds at or below their score;
    the thresholds are summed over those counts.
    """
    ts = sorted(thresholds)
    passed = sum([(F.col(score) >= t).cast("int") for t in ts], F.lit(0)).alias("_k")
    counts = df.groupBy(passed).agg(F.count_if(F.col(label) == 0).alias("f"), F.count_if(F.col(label) == 1).alias("p"))
    grid = df.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(ts)], "_i int, threshold double")
    at = F.col("_k") <= F.col("_i")
    out = F.broadcast(grid).join(counts).groupBy("threshold").agg(F.sum(F.when(at, F.col("f")).otherwise(0)).alias("tp"), F.sum(F.when(at, F.col("p")).otherwise(0)).alias("fp"), F.sum("f").alias("fails"), F.sum(F.col("f") + F.col("p")).alias("n"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", "fails")
    return out.select("threshold", "tp", "fp", precision.alias("precision_fail"), recall.alias("recall_fail"), F.try_divide(5 * precision * recall, 4 * precision + recall).alias("f2_fail"), ((F.col("tp") + F.col("fp")) / F.col("n")).alias("warning_rate"))


def best_threshold(sweep: DataFrame, value: str, constraint: Column) -> DataFrame:
    """The threshold with the largest value among those that meet a constraint."""
    return sweep.where(constraint).orderBy(F.col(value).desc_nulls_last(), "threshold").limit(1)


def missed(df: DataFrame, score: str, label: str, by: Column, threshold: float = 0.80) -> DataFrame:
    """Failures that no warning caught, by group."""
    fail = F.col(label) == 0
    return df.groupBy(by.alias("group_name")).agg(F.count_if(fail).alias("fails"), F.count_if(fail & (F.col(score) >= threshold)).alias("missed")).withColumn("missed_rate", F.try_divide("missed", "fails"))


def paired_deltas(runs: DataFrame, seed: str, arm: str, metric: str, value: str, base: str, other: str, better_high: bool = True) -> DataFrame:
    """Seed by seed differences of two arms: mean, median, spread, and how many seeds improved."""
    x = runs.where(F.col(arm) == base).select(seed, metric, F.col(value).alias("_b"))
    y = runs.where(F.col(arm) == other).select(seed, metric, F.col(value).alias("_o"))
    d = F.col("_o") - F.col("_b") if better_high else F.col("_b") - F.col("_o")
    rows = x.join(y, [seed, metric]).withColumn("_d", d)
    return rows.groupBy(metric).agg(F.count("*").alias("n"), F.avg("_d").alias("mean_delta"), F.median("_d").alias("median_delta"), F.stddev_samp("_d").alias("sd_delta"), F.min("_d").alias("min_delta"), F.max("_d").alias("max_delta"), F.count_if(F.col("_d") > 0).alias("improved"), F.count_if(F.col("_d") < 0).alias("worsened"), F.count_if(F.col("_d") == 0).alias("tied"))


def noise_verdict(deltas: DataFrame, band: Column, least: int) -> DataFrame:
    """improved or worsened when the mean leaves the noise band and enough seeds agree, else noise."""
    verdict = F.when((F.col("mean_delta") > band) & (F.col("improved") >= least), "improved").when((F.col("mean_delta") < -band) & (F.col("worsened") >= least), "worsened").otherwise("noise")
    return deltas.withColumn("verdict", verdict)


def prior_accuracy(df: DataFrame, prior: str, actual: str, masks: dict[str, Column]) -> DataFrame:
    """Mean absolute error of a prior against the outcome, by mask."""
    rows = by_segment(df.where(F.col(prior).isNotNull() & F.col(actual).isNotNull()), masks)
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.avg(F.abs(F.col(prior) - F.col(actual))).alias("mae"))
