"""Timelines: what an entity's strictly earlier periods say.

All windows of a timeline share one partitioning (the timeline key) and one
order, so Spark shuffles and sorts once for the whole family.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean


def period_order(period: str) -> list[Column]:
    """Numeric periods in order, missing last, text as the tie-break."""
    as_text = F.col(period).cast("string")
    return [as_text.try_cast("double").asc_nulls_last(), as_text.asc_nulls_last()]


def collapse_periods(df: DataFrame, keys: Sequence[str], maxima: Sequence[str]) -> DataFrame:
    """One row per period: the maxima of columns that should be constant there, and the row count."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in maxima], F.count("*").alias("n_rows"))


def interruption(reg: str = "reg_credits", passed: str = "pass_credits", gpa: str = "gpa") -> Column:
    """A period with registrations but nothing passed and a zero average."""
    return ((F.coalesce(F.col(reg), F.lit(0)) > 0) & (F.coalesce(F.col(passed), F.lit(0)) == 0) & F.coalesce(F.col(gpa) == 0, F.lit(False))).cast("int")


def first_active(columns: Sequence[str]) -> Column:
    """1 where all given start totals are 0 or missing; 0 without such columns."""
    if not columns:
        return F.lit(0)
    out = F.lit(True)
    for c in columns:
        out = out & (F.coalesce(F.col(c), F.lit(0)) == 0)
    return out.cast("int")


def add_history(periods: DataFrame, timeline: Sequence[str], period: str, gpa: str = "gpa", flag: str = "is_interruption") -> DataFrame:
    """Interruption runs and the valid-value trend, each from earlier periods only.

    ``last_valid`` and ``second_last_valid`` walk the subsequence of valid
    periods (value above 0, not interrupted).
    """
    order = Window.partitionBy(*timeline).orderBy(*period_order(period))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    valid = F.when((F.col(gpa) > 0) & (F.col(flag) == 0), F.col(gpa))
    out = periods.withColumns(
        {
            "_rn": F.row_number().over(order),
            "prev_interrupted": F.coalesce(F.lag(flag).over(order), F.lit(0)),
            "prior_interruptions": F.coalesce(F.sum(flag).over(before), F.lit(0)),
            "last_valid": F.last(valid, ignorenulls=True).over(before),
        }
    )
    at_valid = F.when(valid.isNotNull(), F.col("last_valid"))
    last_clear = F.max(F.when(F.col(flag) == 0, F.col("_rn"))).over(before)
    out = out.withColumns(
        {
            "second_last_valid": F.last(at_valid, ignorenulls=True).over(before),
            "prior_run": F.col("_rn") - 1 - F.coalesce(last_clear, F.lit(0)),
            "is_first_row": (F.col("_rn") == 1).cast("int"),
        }
    )
    return out.withColumn("trend", F.col("last_valid") - F.col("second_last_valid")).drop("_rn")


def lagged_trend(periods: DataFrame, timeline: Sequence[str], period: str, value: Column) -> Column:
    """The rejected variant: the forward-filled value two rows back (a diagnostic for wrong zero trends)."""
    order = Window.partitionBy(*timeline).orderBy(*period_order(period))
    filled = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.lag(filled, 2).over(order)


def source_period(timeline: Sequence[str], period: str, valid: Column) -> Column:
    """The period that ``last_valid`` comes from."""
    before = Window.partitionBy(*timeline).orderBy(*period_order(period)).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(valid, F.col(period)), ignorenulls=True).over(before)


def attach_history(rows: DataFrame, history: DataFrame, keys: Sequence[str], zero: Sequence[str], nullable: Sequence[str]) -> DataFrame:
    """Period features on item rows: counts become 0 where missing, trends stay NULL beside a flag."""
    side = history.select(*[F.col(k).alias(f"_h_{k}") for k in keys], *zero, *nullable)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    out = rows.join(side, on, "left").drop(*[f"_h_{k}" for k in keys])
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
    return out.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in nullable})


def previous_value_chain(raw: str, last_valid: str, start: str, first_active_flag: str) -> dict[str, Column]:
    """Previous value by priority raw, last valid, start total, zero; with its source and flags."""
    value, source = clean.first_positive([("raw", F.col(raw)), ("last_valid", F.col(last_valid)), ("start", F.col(start))])
    zero = F.coalesce(F.col(raw) == 0, F.lit(False))
    invalid = zero & (F.col(first_active_flag) != 1)
    return {
        "prev_missing": F.col(raw).isNull().cast("int"),
        "prev_zero": zero.cast("int"),
        "prev_invalid_zero": invalid.cast("int"),
        "prev_clean": value,
        "prev_source": source,
        "prev_replaced": (invalid & (source != "raw")).cast("int"),
        "model_prev": F.when(source != "zero_fallback", value),
    }


def attempts(df: DataFrame, timeline: Sequence[str], period: str, row_id: str) -> DataFrame:
    """Attempt number and count of an entity at an item."""
    w = Window.partitionBy(*timeline)
    order = w.orderBy(*period_order(period), row_id)
    return df.withColumn("attempt", F.row_number().over(order)).withColumn("attempts", F.count("*").over(w))


def attempt_history(df: DataFrame, timeline: Sequence[str], period: str, attempt: str, row_id: str, mark: str, failed: str, status: str) -> DataFrame:
    """What earlier attempts at the same item gave."""
    order = Window.partitionBy(*timeline).orderBy(*period_order(period), attempt, row_id)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns(
        {
            "prior_attempts": F.row_number().over(order) - 1,
            "prior_max_attempt": F.max(attempt).over(before),
            "last_mark": F.lag(mark).over(order),
            "best_mark": F.max(mark).over(before),
            "mean_mark": F.avg(mark).over(before),
            "prior_failures": F.coalesce(F.sum(failed).over(before), F.lit(0)),
            "last_status": F.lag(status).over(order),
            "last_period": F.lag(period).over(order),
        }
    ).withColumn("is_retake", (F.col("prior_attempts") > 0).cast("int"))


def period_outcomes(df: DataFrame, keys: Sequence[str], snapshot: Sequence[str], row_id: str, credits: str, mark: str, passed: str, failed: str) -> DataFrame:
    """One row per period: the first known value of each snapshot column (by row id), and observed totals."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(row_id))).alias(c) for c in snapshot]
    out = df.groupBy(*keys).agg(
        *firsts,
        F.count(row_id).alias("n_items"),
        F.sum(credits).alias("credits"),
        F.avg(mark).alias("mean_mark"),
        F.sum(passed).alias("n_passed"),
        F.sum(failed).alias("n_failed"),
    )
    return out.withColumns({"any_failed": (F.col("n_failed") > 0).cast("int"), "all_passed": ((F.col("n_items") > 0) & (F.col("n_passed") == F.col("n_items"))).cast("int")})


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by a total order (``row_number`` at most 1, which Spark limits early)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn <= 1").drop("_rn")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def calendar_cumulative(df: DataFrame, key: str, period: str, value: str, end_state: bool = True) -> DataFrame:
    """Totals of each key before every period of the calendar, periods without rows included.

    ``n`` and ``total`` are over earlier periods; ``rate`` is NULL before any.
    With ``end_state`` each key has a last row with a NULL period: its final state.
    """
    per = df.groupBy(key, period).agg(F.count(value).alias("c"), F.sum(value).alias("s"))
    calendar = per.select(period).distinct()
    if end_state:
        calendar = calendar.unionByName(calendar.limit(1).select(F.lit(None).cast(df.schema[period].dataType).alias(period)))
    grid = per.select(key).distinct().crossJoin(F.broadcast(calendar))
    full = grid.join(per, [key, period], "left")
    before = Window.partitionBy(key).orderBy(F.col(period).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = full.select(key, period, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("total"))
    return out.withColumn("rate", F.when(F.col("n") > 0, F.col("total") / F.col("n")))


def taper(df: DataFrame, key: str, period: str, active_rows: int = 5, silent: int = 3) -> DataFrame:
    """Last active period of each key, silent periods behind it, share of active periods, and whether it tapers off."""
    ranked = df.select(period).distinct().withColumn("pos", F.dense_rank().over(Window.orderBy(period)))  # one row a period
    per = df.groupBy(key, period).agg(F.count("*").alias("n")).join(F.broadcast(ranked), period)
    last = ranked.agg(F.max("pos").alias("end_pos"))
    agg = per.groupBy(key).agg(
        F.min("pos").alias("first_pos"),
        F.max(F.when(F.col("n") >= active_rows, F.col("pos"))).alias("active_pos"),
        F.max(F.when(F.col("n") >= active_rows, F.col(period))).alias("last_active"),
        F.count_if(F.col("n") >= active_rows).alias("active_periods"),
    )
    out = agg.crossJoin(F.broadcast(last))
    out = out.withColumn("silent_periods", F.col("end_pos") - F.coalesce("active_pos", F.col("first_pos") - 1))
    out = out.withColumn("persistence", F.col("active_periods") / (F.col("end_pos") - F.col("first_pos") + 1))
    return out.select(key, "last_active", "active_periods", "silent_periods", "persistence", (F.col("silent_periods") >= silent).cast("int").alias("tapers"))


def interval_gaps(df: DataFrame, group: Sequence[str], low: str, high: str) -> DataFrame:
    """Whether an interval leaves a gap to, or overlaps, the one before it."""
    before = F.lag(high).over(Window.partitionBy(*group).orderBy(low, high))
    return df.withColumn("issue", F.when(before.isNull(), "first").when(F.col(low) > before + 1, "gap").when(F.col(low) <= before, "overlap").otherwise("ok"))


def period_distance(df: DataFrame, a: str, b: str, periods: DataFrame, period: str) -> DataFrame:
    """Calendar steps from period ``a`` to period ``b``."""
    ranked = periods.select(period).distinct().withColumn("pos", F.dense_rank().over(Window.orderBy(period)))
    x, y = (F.broadcast(ranked.select(F.col(period).alias(c), F.col("pos").alias(f"_{c}"))) for c in (a, b))
    return df.join(x, a, "left").join(y, b, "left").withColumn("steps", F.col(f"_{b}") - F.col(f"_{a}")).drop(f"_{a}", f"_{b}")
