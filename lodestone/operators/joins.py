"""Joins with declared cardinality, tiered resolution, as-of and range lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import sized
from .expect import ExpectationError, require_unique

CASES = 200  # bounds of a scale that are written out


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", indicator: str | None = None, checked: bool = False, suffix: str = "_r") -> DataFrame:
    """Join that neither repeats nor (by default) drops rows of ``left``; with ``checked`` a job makes sure.

    Columns of ``right`` that ``left`` has too get the suffix.
    """
    if checked:
        require_unique(right, keys, "right side")
    cols = [c for c in right.columns if c not in keys]
    side = right.select(*keys, *[F.col(c).alias(c + suffix if c in left.columns else c) for c in cols])
    if indicator:
        side = side.withColumn(indicator, F.lit(1))
    out = left.join(side, list(keys), how)
    return out.withColumn(indicator, F.coalesce(F.col(indicator), F.lit(0))) if indicator else out


def coalesce_pair(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """One column from two; ``<out>_conflict`` marks rows where both are known and differ."""
    return df.withColumn(f"{out}_conflict", F.coalesce(F.col(a) != F.col(b), F.lit(False)).cast("int")).withColumn(out, F.coalesce(a, b))


def resolve_reference(rows: DataFrame, catalogue: DataFrame, item: str, program: str) -> DataFrame:
    """Where a (program, item) is found in the catalogue: as it stands, under the item's only program, or not.

    Adds ``resolved_program`` and ``match_type`` (exact, fallback, ambiguous, absent).
    """
    exact = catalogue.select(item, program).distinct().withColumn("_exact", F.lit(True))
    other = catalogue.groupBy(item).agg(F.count_distinct(program).alias("_n"), F.min(program).alias("_only"))
    out = rows.join(exact, [item, program], "left").join(other, item, "left")
    kind = F.when(F.col("_exact"), "exact").when(F.col("_n") == 1, "fallback").when(F.col("_n") > 1, "ambiguous").otherwise("absent")
    resolved = F.when(kind == "exact", F.col(program)).when(kind == "fallback", F.col("_only"))
    return out.withColumn("match_type", kind).withColumn("resolved_program", resolved).drop("_exact", "_n", "_only")


def only_in_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(groups.select(*keys).distinct(), list(keys), "left_semi")


def uncovered(targets: DataFrame, sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Targets without a source: a coverage gate wants none."""
    return targets.join(sources.select(*keys).distinct(), list(keys), "left_anti")


def require_covered(targets: DataFrame, sources: DataFrame, keys: Sequence[str], label: str = "targets") -> DataFrame:
    bad = uncovered(targets, sources, keys).limit(5).collect()
    if bad:
        raise ExpectationError(f"{label} without a source: {[r.asDict() for r in bad]}")
    return targets


def override(rows: DataFrame, trusted: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of trusted rows replace a row's own, a missing value too; ``is_target`` marks those rows."""
    side = trusted.select(F.col(key), F.lit(True).alias("_t"), *[F.col(c).alias(f"_t_{c}") for c in columns])
    out = rows.join(side, key, "left")
    out = out.withColumns({c: F.when(F.col("_t"), F.col(f"_t_{c}")).otherwise(F.col(c)) for c in columns})
    return out.withColumn("is_target", F.coalesce("_t", F.lit(False)).cast("int")).drop("_t", *[f"_t_{c}" for c in columns])


def as_of(queries: DataFrame, history: DataFrame, keys: Sequence[str], period: str, totals: Sequence[str]) -> DataFrame:
    """Each query row with its key's totals over strictly earlier periods; NULL where the key wasn't seen before.

    History is summed by (key, period) first; a query adds no weight.
    """
    deltas = history.groupBy(*keys, period).agg(*[F.sum(c).alias(c) for c in totals], F.lit(1).alias("_seen"))
    asked = queries.select(*keys, period).distinct()
    both = deltas.unionByName(asked.select(*keys, period, *[F.lit(None).alias(c) for c in totals], F.lit(None).alias("_seen")), allowMissingColumns=True)
    per = both.groupBy(*keys, period).agg(*[F.sum(c).alias(c) for c in totals], F.max("_seen").alias("_seen"))
    before = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    state = per.select(*keys, period, F.max("_seen").over(before).alias("_hit"), *[F.sum(c).over(before).alias(c) for c in totals])
    state = state.select(*keys, period, *[F.when(F.col("_hit") == 1, F.coalesce(F.col(c), F.lit(0))).alias(c) for c in totals])
    return queries.join(state, [*keys, period], "left")


def range_lookup(df: DataFrame, value: str, scale: DataFrame, low: str, out: dict[str, str], clip: tuple[float, float] | None = None) -> DataFrame:
    """Value to interval by lower bounds, half-open; NULL below the first.

    The scale is read at once: up to ``CASES`` bounds become one CASE a column,
    so rows aren't joined at all; a larger one is broadcast by ``sized`` and
    met by a range join.
    """
    v = F.greatest(F.least(F.col(value), F.lit(clip[1])), F.lit(clip[0])) if clip else F.col(value)
    rows = scale.select(low, *out).where(F.col(low).isNotNull()).limit(CASES + 1).collect()
    known = F.col(value).isNotNull()
    if len(rows) <= CASES:
        rows = sorted(rows, key=lambda r: r[0], reverse=True)
        found = {}
        for k, (column, name) in enumerate(out.items(), 1):
            case = F.lit(None).cast(scale.schema[column].dataType)
            for r in reversed(rows):
                case = F.when(known & (v >= F.lit(r[0])), F.lit(r[k]).cast(scale.schema[column].dataType)).otherwise(case)
            found[name] = case
        return df.withColumns(found)
    bounds = scale.select(F.col(low).alias("_lo"), F.lead(low).over(Window.orderBy(low)).alias("_hi"), *[F.col(c).alias(n) for c, n in out.items()])
    on = (v >= F.col("_lo")) & (F.col("_hi").isNull() | (v < F.col("_hi")))
    return df.join(sized(bounds), F.when(known, on).otherwise(F.lit(False)), "left").drop("_lo", "_hi")


def reuse_tiers(rows: DataFrame, known: DataFrame, base: Sequence[str], full: Sequence[str], outputs: Sequence[str], checked: bool = False) -> DataFrame:
    """Outputs of ``known`` rows where they agree by ``base`` key, else by ``full`` key, else the row's own.

    Adds ``reuse`` (base, full, own).  With ``checked`` a job raises where full
    keys disagree, which ``tier_conflicts`` shows.
    """
    if checked and (bad := tier_conflicts(known, full, outputs).limit(5).collect()):
        raise ExpectationError(f"known outputs disagree by {list(full)}: {[r.asDict() for r in bad]}")
    value = F.struct(*outputs)
    side = lambda keys, name: known.groupBy(*keys).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(name)).where("_n = 1").drop("_n")
    out = rows.join(side(base, "_b"), list(base), "left").join(side(full, "_f"), list(full), "left")
    out = out.withColumn("reuse", F.when(F.col("_b").isNotNull(), "base").when(F.col("_f").isNotNull(), "full").otherwise("own"))
    return out.withColumns({c: F.when(F.col("_b").isNotNull(), F.col(f"_b.{c}")).when(F.col("_f").isNotNull(), F.col(f"_f.{c}")).otherwise(F.col(c)) for c in outputs}).drop("_b", "_f")


def tier_conflicts(known: DataFrame, full: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    return known.groupBy(*full).agg(F.count_distinct(F.struct(*outputs)).alias("n")).where("n > 1")


def shared_pairs(df: DataFrame, side: str, on: str) -> DataFrame:
    """Set overlap of all pairs that share something: shared size, Jaccard and containment.

    An equi-join on what is shared; pairs that share nothing don't occur.
    """
    sets = df.select(side, on).distinct()
    size = sets.groupBy(side).agg(F.count("*").alias("n"))
    x, y = sets.select(F.col(side).alias("a"), on), sets.select(F.col(side).alias("b"), on)
    both = x.join(y, on).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = both.join(size.select(F.col(side).alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col(side).alias("b"), F.col("n").alias("n_b")), "b")
    return out.withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).withColumn("containment", F.col("shared") / F.least("n_a", "n_b"))


def migrations(df: DataFrame, entity: str, side: str, least: int = 5) -> DataFrame:
    """How many entities occur on both of two sides."""
    rows = df.select(entity, side).distinct()
    x, y = rows.select(entity, F.col(side).alias("a")), rows.select(entity, F.col(side).alias("b"))
    return x.join(y, entity).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def blend(links: DataFrame, narrow: DataFrame, wide: DataFrame, narrow_key: str, wide_key: str, value: str, weight: str = "weight", target: str = "target") -> DataFrame:
    """Weighted mean of predecessors' values, from the narrow table else the wide; ``unresolved`` counts links in neither."""
    out = links.join(narrow.select(narrow_key, F.col(value).alias("_n")), narrow_key, "left").join(wide.select(wide_key, F.col(value).alias("_w")), wide_key, "left")
    v = F.coalesce("_n", "_w")
    return out.groupBy(target).agg((F.sum(F.col(weight) * v) / F.sum(F.when(v.isNotNull(), F.col(weight)))).alias(value), F.count_if(v.isNull()).alias("unresolved"))


def theta_candidates(new: DataFrame, old: DataFrame, block: str, score: Column, least: float = 0.60) -> DataFrame:
    """Pairs of rows whose names share a word (``block`` is an array of them), scored and filtered.

    The words block the comparison, so there is no all-with-all product.
    """
    x = new.withColumn("_w", F.explode(F.array_distinct(block)))
    y = old.withColumn("_w", F.explode(F.array_distinct(F.col(block)))).select("_w", *[F.col(c).alias(f"old_{c}") for c in old.columns if c != block])
    pairs = x.join(y, "_w").drop("_w", block).distinct()
    return pairs.withColumn("score", score).where(F.col("score") >= least)


def full_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """``side`` (both, left, right) and per column whether the two sides differ beyond a tolerance."""
    x = a.select(*keys, F.lit(1).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    y = b.select(*keys, F.lit(1).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    out = x.join(y, list(keys), "full_outer")

    def differs(c: str) -> Column:
        same = F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        if tolerance:
            same = same | F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance, F.lit(False))
        return (~same).cast("int")

    side = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return out.select(*keys, side.alias("side"), *[F.when(side == "both", differs(c)).alias(f"{c}_differs") for c in columns])
