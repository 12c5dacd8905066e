"""Composed pipelines: feature engineering, statistics builds, peers, histories, recommendation, rebuild."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import cascade, difficulty, expect, joins, neighbors, peers, timeline
from ..sources import tables
from ..sources.scratch import kept
from . import binding, planning
from .binding import TERM, TIMELINE


@dataclass(frozen=True)
class Features:
    """What feature engineering gives; all lazy."""

    audit: DataFrame
    primary: DataFrame
    excluded: DataFrame
    conflicts: DataFrame


def engineer(items: DataFrame, periods: DataFrame, snapshot: tuple[str, ...] = ("reg_credits", "n_items")) -> Features:
    """History from all periods, then items with history, flags and the policy split."""
    h = timeline.add_history(periods, TIMELINE, "period")
    rows = timeline.attach_history(items, h.withColumn("_reg", F.col("reg_credits")), TERM, ["prior_interruptions", "prior_run", "prev_interrupted", "_reg", "n_items"], ["last_valid", "trend"])
    rows = rows.withColumns(clean.policy_flags(F.col("credits"), F.col("_reg"), F.col("n_items"), F.lit(0))).drop("_reg")
    return Features(rows, rows.where("excluded = 0"), rows.where("excluded = 1"), expect.conflicts(items, TERM, ["unit"]))


def build_statistics(spark: SparkSession, rows: DataFrame, path: str, split: str, version: str = "1") -> dict[str, DataFrame]:
    """Temporal statistics for training rows, a frozen state for the rest; the state is written and read back."""
    train = rows.where(F.col(split) == "train")
    state = difficulty.fit(train)
    tables.save_state(state, path, version, {"k": difficulty.Config().k})
    state, _ = tables.load_state(spark, path, version)
    out = {"train": difficulty.temporal(train, train)}
    out |= {s: difficulty.apply_state(rows.where(F.col(split) == s), state) for s in ("valid", "test")}
    checks = {"support_known": F.col("item_support").isNotNull(), "level_in_range": F.col("level").between(1, 6)}
    for name, df in out.items():
        expect.expect(df, checks, name)
    return out


def build_peers(registrations: DataFrame, targets: DataFrame, catalogue: DataFrame, history: DataFrame) -> DataFrame:
    """Roster of the targets' periods, statistics as of each period, and leave-one-out features of the targets."""
    members = peers.roster(registrations, targets, catalogue, TERM, "row_id", "item", "program", "status")
    members = difficulty.temporal(members, history)
    return peers.leave_one_out(members, TERM, "pass_rate", "is_weak", "category").where("is_target = 1")


def trend_dataset(items: DataFrame, periods: DataFrame) -> DataFrame:
    """Items with the trend of their timeline; raises if an item's period isn't found."""
    h = timeline.add_history(periods, TIMELINE, "period").select(*TERM, "last_valid", "second_last_valid", "trend")
    joins.require_covered(items, h, TERM, "items")
    return joins.many_to_one(items, h, TERM, "inner")


def neighbor_history(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attempt history by item, and outcomes by period."""
    rows = items.withColumn("passed", (F.col("mark") >= 50).cast("int")).withColumn("failed", (F.col("mark") < 50).cast("int")).withColumn("status", F.when(F.col("mark") >= 50, "P").otherwise("F"))
    courses = timeline.attempt_history(rows, ["entity", "item"], "period", "attempt", "row_id", "mark", "failed", "status")
    return courses, timeline.period_outcomes(rows, TERM, ["unit"], "row_id", "credits", "mark", "passed", "failed")


def recommend(spark: SparkSession, sf_dir: str, n_plans: int = 500, k: int = 5) -> DataFrame:
    """The best plans of every entity.

    Candidates are scored by frozen statistics; plans are combinations of them.
    Each plan is rescored as such: its items' peers are the plan's other items
    (``planning.rescored``), and an item's chance falls with their mean
    difficulty.  Evidence comes from the nearest entities by the first known of
    cumulative and last value: their failures, and the marks of those of their
    periods whose items cover half of the plan, which are asked for where no
    failures are known.

    Plans are some hundred times their candidates: they are made, scored and
    ranked in the task of their entity (``planning.best_of_each``).
    """
    items = timeline.attempts(binding.enrolment(spark, sf_dir), ["entity", "item"], "period", "line")
    rows = kept(items.select(*TERM, "unit", "item", "category", "credits", "mark", "attempt"), "items", free=True)
    state = difficulty.fit(rows)
    terms = kept(binding.history_of(rows), "terms", free=True)
    snapshot = timeline.latest_by(terms, ["entity"], [F.col("period").desc(), F.col("program")])
    value, source = neighbors.query_value([("cumulative", F.col("last_valid")), ("period", F.col("gpa"))])
    snapshot = kept(snapshot.withColumn("position", value).withColumn("position_source", source), "snapshot")

    points = kept(neighbors.latest_positions(terms.where("gpa > 0"), ["program"], "entity", "period", "gpa"), "points")
    asked = snapshot.select("program", "entity", F.col("position").alias("gpa"), F.col("entity").alias("query"))
    near = neighbors.nearest_1d(asked, points, ["program"], "gpa", "query", "entity", "period")
    facts = points.select("program", F.col("entity").alias("neighbor_entity"), (F.col("pass_credits") < F.col("reg_credits")).cast("int").alias("failed"))
    evidence = neighbors.predict(near, facts, ["program", "neighbor_entity"], ["query"], ["failed"], []).select(F.col("query").alias("entity"), "p_failed")
    evidence = kept(evidence, "evidence", free=True)

    # an entity's first row of an item stands for it
    options = rows.where("attempt = 1").select("entity", "item", "category", "credits", "unit")
    scored = difficulty.apply_state(snapshot.select("entity", "program").join(options, "entity"), state)
    chance, units = F.col("pass_rate"), F.coalesce(F.col("credits").cast("double"), F.lit(planning.DEFAULT_CREDITS))
    option = F.struct((-chance).alias("p"), F.col("item").alias("i"), units.alias("c"), F.col("mean_mark").alias("m"))
    per = scored.where(chance >= planning.MIN_PROBABILITY).groupBy("entity").agg(F.array_sort(F.collect_list(option)).alias("options"))
    per = per.join(evidence, "entity", "left")
    lacking = evidence.where("p_failed is null").select("entity")
    if lacking.isEmpty():
        per = per.withColumn("groups", F.lit(None).cast("array<struct<g:array<string>,m:double>>"))
    else:
        taken = rows.groupBy("program", F.col("entity").alias("neighbor_entity"), F.col("period").alias("neighbor_period")).agg(F.collect_set("item").alias("g"), F.avg("mark").alias("m"))
        found = near.join(lacking.withColumnRenamed("entity", "query"), "query", "left_semi")
        groups = neighbors.neighbor_items(found, taken, ["program", "neighbor_entity", "neighbor_period"])
        per = per.join(groups.groupBy(F.col("query").alias("entity")).agg(F.collect_list(F.struct("g", "m")).alias("groups")), "entity", "left")
    return planning.best_of_each(per, binding.GRADES, k, n_plans)


def split_rows(rows: DataFrame, period: str = "period", **limits) -> DataFrame:
    split, reason = clean.split_of(F.col(period), **limits)
    return rows.withColumn("split", split).withColumn("split_reason", reason)


def rebuild(spark: SparkSession, rows: DataFrame, root: str, **limits) -> dict[str, DataFrame]:
    """Split, statistics, peers and published tables, each read back and verified."""
    parts = build_statistics(spark, split_rows(rows, **limits), f"{root.rstrip('/')}/state", "split")
    out = {}
    for name, df in parts.items():
        full = peers.leave_one_out(df, TERM, "pass_rate", "is_weak", "category")
        path = tables.table_path(root, "features", "items", name)
        tables.write_table(full, path, {"split": name, "columns": full.columns})
        out[name] = spark.read.parquet(path)
    return out


def clean_enrolment(raw: DataFrame, critical: list[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with their reason."""
    rows = cascade.cascade(raw, cascade.enrolment_rules(critical=critical))
    return cascade.accepted(rows), cascade.rejected(rows)
