"""Role binding: the star-schema tables as timelines of entities that take items period by period.

An order's customer is the entity, the nation its program, the region the unit,
the order's quarter the period (``YYYYQ``), brand and type the item, the type
its category, and twice the quantity the mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins, timeline

# Lower bound of each interval of the grade scale, and a hundred times its points.
GRADES = ((0, 0), (50, 150), (55, 175), (60, 200), (65, 225), (70, 250), (75, 275), (80, 300), (85, 325), (90, 350), (95, 375), (98, 400))
TIMELINE, TERM = ["entity", "program"], ["entity", "program", "period"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grade_scale(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GRADES), "low int, points int")


def enrolment(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """One row per line: ``row_id`` is unique.

    With ``by_order``, for large tables, lines are dealt out by order first, so
    that their numbering and the join with orders share one shuffle, and lines
    aren't sorted for joins with tables whose keys are unique.
    """
    line = table(spark, sf_dir, "lineitem")
    if by_order:
        line = line.repartition("l_orderkey")
    same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    line = line.withColumn("n", F.row_number().over(same))
    # what an order's entity says is joined to orders, of which there are fewer than lines
    who = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    part = table(spark, sf_dir, "part")
    if by_order:
        orders, part = orders.hint("shuffle_hash"), part.hint("shuffle_hash")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    return rows.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("n").cast("string")).alias("row_id"),
        F.col("o_custkey").alias("entity"),
        F.col("c_nationkey").alias("program"),
        F.col("n_regionkey").alias("unit"),
        (F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).alias("period"),
        F.concat_ws("/", "p_brand", "p_type").alias("item"),
        F.col("p_type").alias("category"),
        brand.alias("brand"),
        (brand % 4 + 1).alias("credits"),
        (F.col("l_quantity") * 2).cast("int").alias("mark"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linenumber").alias("line"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_quantity").cast("long") * 2) % 101).cast("int").alias("score100"),
        F.col("l_partkey").alias("part"),
    )


def attempted(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    return timeline.attempts(enrolment(spark, sf_dir, by_order), ["entity", "item"], "period", "row_id")


def _graded(rows: DataFrame) -> DataFrame:
    return joins.range_lookup(rows, "mark", grade_scale(rows.sparkSession), "low", {"points": "points"}, (0, 100))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(enrolment(spark, sf_dir))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms_of(enrolment(spark, sf_dir))


def terms_of(rows: DataFrame) -> DataFrame:
    """One row per entity, program and period, with its average and whether it was an interruption."""
    out = _graded(rows).groupBy(*TERM).agg(
        F.count("*").alias("n_items"),
        F.sum("credits").alias("reg_credits"),
        F.sum(F.when(F.col("mark") >= 50, F.col("credits")).otherwise(0)).alias("pass_credits"),
        F.sum(F.col("points") * F.col("credits")).alias("points"),
    )
    out = out.withColumn("gpa", F.round(F.col("points") / (F.col("reg_credits") * F.lit(100.0)), 6))
    return out.withColumn("is_interruption", timeline.interruption())


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_of(enrolment(spark, sf_dir))


def history_of(rows: DataFrame) -> DataFrame:
    return timeline.add_history(terms_of(rows), TIMELINE, "period")
