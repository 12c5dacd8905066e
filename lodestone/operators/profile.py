"""Profiles: distributions, shares, coverage, activity, lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def column_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, nulls, kinds``, in one aggregation."""
    cols = columns or df.columns
    cells = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(F.col(c)).alias("kinds")) for c in cols]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def integer_like(df: DataFrame, column: str) -> DataFrame:
    """How many values are missing, integral, fractional or no numbers."""
    d = F.col(column).cast("string").try_cast("double")
    whole = F.abs(d - F.round(d)) <= 1e-9
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(column).isNull()).alias("nulls"), F.count_if(whole).alias("integral"), F.count_if(~whole).alias("fractional"), F.count_if(F.col(column).isNotNull() & d.isNull()).alias("not_numbers"))


def id_signature(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shape of identifier columns: digits only, dotted, with a decimal zero, blank, other."""

    def one(c: str) -> Column:
        t = F.trim(F.col(c).cast("string"))
        kinds = {"digits": t.rlike(r"^\d+$"), "decimal_zero": t.rlike(r"^\d+\.0+$"), "dotted": t.rlike(r"^\d+\.\d+$") & ~t.rlike(r"^\d+\.0+$"), "blank": t == ""}
        other = t.isNotNull()
        for k in kinds.values():
            other = other & ~k
        return F.struct(F.lit(c).alias("column_name"), F.count_if(t.isNull()).alias("nulls"), *[F.count_if(v).alias(k) for k, v in kinds.items()], F.count_if(other).alias("other"))

    return df.agg(F.array(*[one(c) for c in columns]).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def distribution(df: DataFrame, value: str, by: Sequence[str] = (), percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """Count, nulls, mean, extremes and exact percentiles."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("nulls"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.percentile(value, F.array(*[F.lit(p) for p in percentiles])).alias("_p"))
    return out.withColumns({f"p{round(100 * p):02d}": F.col("_p")[i] for i, p in enumerate(percentiles)}).drop("_p")


def shares(df: DataFrame, column: str) -> DataFrame:
    """Value counts and their share of all rows."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def crosstab(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    return df.groupBy(a).pivot(b, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def concentration(df: DataFrame, dimension: str, bad: Column, top: int = 10) -> DataFrame:
    """Where a predicate concentrates: its rows by dimension, most first."""
    out = df.groupBy(dimension).agg(F.count_if(bad).alias("bad"), F.count("*").alias("n")).withColumn("rate", F.col("bad") / F.col("n"))
    return out.orderBy(F.col("bad").desc(), F.col(dimension)).limit(top)


def describe_split(df: DataFrame, split: str, entity: str, item: str, period: str, mark: str, pass_mark: float = 50) -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"), F.count_distinct(entity).alias("entities"), F.count_distinct(item).alias("items"), F.min(period).alias("first_period"), F.max(period).alias("last_period"), F.avg((F.col(mark) >= pass_mark).cast("int")).alias("pass_rate"))


def coverage(targets: DataFrame, known: DataFrame, key: str, least: int = 20) -> DataFrame:
    """``targets`` with ``coverage``: covered, thin (few known rows) or never_seen."""
    n = known.groupBy(key).agg(F.count("*").alias("_n"))
    kind = F.when(F.col("_n").isNull(), "never_seen").when(F.col("_n") < least, "thin").otherwise("covered")
    return targets.join(n, key, "left").withColumn("coverage", kind).drop("_n")


def debut(df: DataFrame, key: str, period: str) -> DataFrame:
    """How many keys occur first in each period."""
    return df.groupBy(key).agg(F.min(period).alias(period)).groupBy(period).agg(F.count("*").alias("debuts"))


def activity(df: DataFrame, key: str, period: str, entity: str, program: str) -> DataFrame:
    return df.groupBy(key, period).agg(F.count("*").alias("n"), F.count_distinct(entity).alias("entities"), F.count_distinct(program).alias("programs"))


def activity_profile(df: DataFrame, key: str, period: str, final_from: int) -> DataFrame:
    """First and last period, volume, final volume, and final volume over the mean of earlier periods."""
    out = df.groupBy(key).agg(F.min(period).alias("first_period"), F.max(period).alias("last_period"), F.count("*").alias("n"), F.count_if(F.col(period) >= final_from).alias("n_final"), F.count_distinct(F.when(F.col(period) < final_from, F.col(period))).alias("_early"))
    return out.withColumn("collapse_ratio", F.try_divide(F.col("n_final").cast("double"), F.try_divide(F.col("n") - F.col("n_final"), F.col("_early")))).drop("_early")


def name_index(df: DataFrame, name_key: str, item: str, rate: str, support: str, family: str, risky: int = 5) -> DataFrame:
    """Per name: its items by support, the spread of their rates, and whether many families share it."""
    pair = F.struct((-F.col(support)).alias("s"), F.col(item).alias("i"))
    out = df.groupBy(name_key).agg(F.array_sort(F.collect_set(pair)).alias("_p"), (F.max(rate) - F.min(rate)).alias("spread"), F.count_distinct(family).alias("families"))
    return out.select(name_key, F.transform("_p", lambda p: p["i"]).alias("items"), "spread", "families", (F.col("families") >= risky).cast("int").alias("is_service"))


def lineage(stages: dict[str, DataFrame], entity: str, value) -> DataFrame:
    """Rows of one entity in each stage."""
    out = None
    for name, df in stages.items():
        n = df.where(F.col(entity) == value).agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def trend_coverage(periods: DataFrame, split: str, last_valid: str = "last_valid", trend: str = "trend") -> DataFrame:
    """Periods with a trend, with one earlier value only, and with none, by split."""
    return periods.groupBy(split).agg(F.count_if(F.col(trend).isNotNull()).alias("computable"), F.count_if(F.col(trend).isNull() & F.col(last_valid).isNotNull()).alias("one_prior"), F.count_if(F.col(last_valid).isNull()).alias("none"))


def priority_dedup(df: DataFrame, keys: Sequence[str], priority: Column, order: Sequence[Column]) -> DataFrame:
    """One row a key: the highest priority, then a total order."""
    w = Window.partitionBy(*keys).orderBy(priority.desc(), *order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn <= 1").drop("_rn")


def exact_duplicates(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).where("n > 1")
