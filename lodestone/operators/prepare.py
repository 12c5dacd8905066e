"""Preparing sources before they are joined: casting by a registry, cascades, scales, contracts between two inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean
from . import joins
from .expect import ExpectationError, require_columns, require_unique

# The range of marks and of points that a grade scale covers.
MARKS, POINTS = (0, 100), (0.0, 4.0)


def id_checks(df: DataFrame, registry: dict[str, str]) -> DataFrame:
    """``column_name, kind, suffixes, not_integral``, in one aggregation: what decides whether a column can be cast."""

    def one(c: str, kind: str) -> Column:
        return F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("kind"), F.array_sort(F.collect_set(clean.id_suffix(clean.clean_id(F.col(c))))).alias("suffixes"), F.count_if(clean.not_integral(F.col(c))).alias("not_integral"))

    return df.agg(F.array(*[one(c, k) for c, k in registry.items()]).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def normalize_ids(df: DataFrame, registry: dict[str, str], skip: Sequence[str] = ()) -> DataFrame:
    """Columns cast by a registry of name to kind: ``suffixed``, ``integer``, ``number``, ``text`` or ``code``.

    A suffixed column loses its suffix, if it is the same in all rows; an
    integer column must be integral.  One job checks; what breaks a rule raises.
    """
    known = {c: k for c, k in registry.items() if c in df.columns and c not in skip}
    asked = {c: k for c, k in known.items() if k in ("suffixed", "integer")}
    bad = []
    for r in id_checks(df, asked).collect() if asked else []:  # one row a column
        if r["kind"] == "suffixed" and len(r["suffixes"]) > 1:
            bad.append(f"{r['column_name']} has suffixes {r['suffixes'][:5]}")
        if r["kind"] == "integer" and r["not_integral"]:
            bad.append(f"{r['column_name']} isn't integral in {r['not_integral']} rows")
    if bad:
        raise ExpectationError("; ".join(bad))
    cast = {"suffixed": lambda c: F.substring_index(clean.clean_id(c), ".", 1), "integer": clean.strict_int, "number": clean.lenient_double, "text": clean.clean_text, "code": clean.clean_code}
    return df.withColumns({c: cast[k](F.col(c)) for c, k in known.items()})


def grade_rules(finish: str, low: str, high: str, points: str, critical: Sequence[str], ok_finish: Sequence[str] = ("P", "F", "FE", "FA")) -> list[tuple[str, Column]]:
    """The cascade of a grade table: finish status, missing values, bounds, points."""
    missing = F.lit(False)
    for c in critical:
        missing = missing | F.col(c).isNull()
    return [
        ("finish_status", ~F.coalesce(F.col(finish).isin(*ok_finish), F.lit(False))),
        ("missing", missing),
        ("bounds", ~F.coalesce(F.col(low).between(*MARKS) & F.col(high).between(*MARKS) & (F.col(low) <= F.col(high)), F.lit(False))),
        ("points", ~F.coalesce(F.col(points).between(*POINTS), F.lit(False))),
    ]


def population(df: DataFrame, denied: Sequence[str] = (), required: Sequence[str] = ()) -> DataFrame:
    """Rows whose required columns are known, without the denied columns."""
    return df.dropna(subset=list(required)).drop(*denied) if required else df.drop(*denied)


def strip_outcomes(df: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """What may be used to resolve identities: no outcome column."""
    return df.drop(*outcomes)


def target_report(df: DataFrame, target: str, low: float = 0, high: float = 100) -> DataFrame:
    """One row: rows, missing targets, and targets outside the range."""
    t = F.col(target)
    return df.agg(F.count("*").alias("rows"), F.count_if(t.isNull()).alias("missing"), F.count_if(~t.between(low, high)).alias("outside"))


def require_target(df: DataFrame, target: str, low: float = 0, high: float = 100) -> DataFrame:
    require_columns(df, [target], "target check")
    r = target_report(df, target, low, high).first()
    if r["missing"] or r["outside"]:
        raise ExpectationError(f"{target}: {r['missing']} missing, {r['outside']} outside {low}..{high} of {r['rows']} rows")
    return df


def scale_from_table(grades: DataFrame, version: str, low: str, high: str, points: str, wanted) -> DataFrame:
    """``low, high, points``: the intervals of one version of a grade table; rows of no width are administrative and go."""
    return grades.where((F.col(version) == wanted) & (F.col(high) > F.col(low))).select(F.col(low).alias("low"), F.col(high).alias("high"), F.col(points).alias("points"))


def scale_cover(scale: DataFrame, marks: tuple[int, int] = MARKS) -> DataFrame:
    """``mark, n``: how many intervals hold each whole mark."""
    every = scale.sparkSession.range(marks[0], marks[1] + 1).select(F.col("id").cast("int").alias("mark"))
    inside = scale.select(F.explode(F.sequence(F.col("low").cast("int"), F.col("high").cast("int"))).alias("mark")).groupBy("mark").agg(F.count("*").alias("n"))
    return every.join(inside, "mark", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def require_scale(scale: DataFrame, marks: tuple[int, int] = MARKS) -> DataFrame:
    """Every whole mark lies in exactly one interval, and points are in range."""
    bad = [r.asDict() for r in scale_cover(scale, marks).where("n <> 1").limit(5).collect()]
    bad += [r.asDict() for r in scale.where(~F.coalesce(F.col("points").between(*POINTS), F.lit(False))).limit(5).collect()]
    if bad:
        raise ExpectationError(f"the scale doesn't cover each mark once: {bad}")
    return scale


def suspicious_fallbacks(df: DataFrame, source: str, first: str, level: str) -> DataFrame:
    """Rows whose previous value fell back to zero though something should be known: ``suspicion``."""
    fell = F.col(source) == "zero_fallback"
    why = F.when(fell & (F.col(first) != 1), "returning_without_history").when(fell & (F.col(first) == 1) & (F.col(level) >= 2), "advanced_standing")
    return df.withColumn("suspicion", why).where(F.col("suspicion").isNotNull())


def prepare_roster(raw: DataFrame, registry: dict[str, str], row_id: str, identity: Sequence[str]) -> DataFrame:
    """Registrations with clean names, ids and codes; identities must be known and rows unique."""
    rows = normalize_ids(clean.normalize_names(raw), registry)
    require_columns(rows, [row_id, *identity], "roster")
    nulls = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in (row_id, *identity)]).first().asDict()
    if bad := {c: n for c, n in nulls.items() if n}:
        raise ExpectationError(f"roster lacks identities: {bad}")
    return require_unique(rows, [row_id], "roster")


def attach_references(rows: DataFrame, status: DataFrame, grades: DataFrame, status_key: str, grade_key: str, needed: Sequence[str], checked: bool = True) -> DataFrame:
    """``rows`` with their status and grade rows, each at most one; needed columns must be known afterwards."""
    out = joins.many_to_one(rows, status, [status_key], indicator="has_status", checked=checked)
    out = joins.many_to_one(out, grades, [grade_key], indicator="has_grade", checked=checked)
    if checked and needed:
        bad = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in needed]).first().asDict()
        if bad := {c: n for c, n in bad.items() if n}:
            raise ExpectationError(f"references are missing: {bad}")
    return out


def target_contract(targets: DataFrame, roster: DataFrame, row_id: str, keys: Sequence[str]) -> DataFrame:
    """Each target and how it stands in the roster: ``ok``, ``absent``, ``repeated`` or ``keys_differ``."""
    side = roster.groupBy(row_id).agg(F.count("*").alias("_n"), F.min(F.struct(*keys)).alias("_k"))
    out = targets.select(row_id, *keys).join(side, row_id, "left")
    same = F.struct(*keys).eqNullSafe(F.col("_k"))
    kind = F.when(F.col("_n").isNull(), "absent").when(F.col("_n") > 1, "repeated").when(~same, "keys_differ").otherwise("ok")
    return out.withColumn("contract", kind).drop("_n", "_k")


def require_target_contract(targets: DataFrame, roster: DataFrame, row_id: str, keys: Sequence[str]) -> DataFrame:
    bad = target_contract(targets, roster, row_id, keys).where("contract <> 'ok'").limit(5).collect()
    if bad:
        raise ExpectationError(f"targets don't match the roster: {[r.asDict() for r in bad]}")
    return targets


def lost_members(old: DataFrame, new: DataFrame, group: Sequence[str], member: str) -> DataFrame:
    """Members of old groups that the new groups lack: a superset gate wants none."""
    keys = [*group, member]
    return old.select(*keys).distinct().join(new.select(*keys).distinct(), keys, "left_anti")


def template_differences(template: DataFrame, built: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Rows of a template that a build lacks or gives other values: an equality gate wants none."""
    out = joins.full_diff(template, built, keys, columns, tolerance).where("side <> 'right'")
    changed = F.greatest(*[F.coalesce(F.col(f"{c}_differs"), F.lit(0)) for c in columns], F.lit(0)) == 1
    return out.where((F.col("side") == "left") | changed)


def require_empty(bad: DataFrame, label: str) -> None:
    rows = bad.limit(5).collect()
    if rows:
        raise ExpectationError(f"{label}: {[r.asDict() for r in rows]}")


def outcome_deltas(df: DataFrame, before: str, after: str, level_before: str, level_after: str) -> DataFrame:
    """Changes of the cumulative value and of the level, and whether they went up; NULL where a side is unknown."""
    delta, level = F.col(after) - F.col(before), F.col(level_after) - F.col(level_before)
    return df.withColumns({"cumulative_delta": delta, "cumulative_improved": clean.positive_flag(delta), "level_delta": level, "level_advanced": clean.positive_flag(level)})


def snapshot_outcomes(df: DataFrame, keys: Sequence[str], item: str, order: str, columns: Sequence[str]) -> DataFrame:
    """One row per period: the columns of its first row by ``order``, and the sorted list of its items."""
    first = [F.min_by(c, order).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*first, F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("n_items"))


def fully_new(targets: DataFrame, history: DataFrame, program: str, item: str) -> DataFrame:
    """``targets`` with ``novelty``: known, new in its program, or never seen anywhere."""
    pair = history.select(program, item).distinct().withColumn("_pair", F.lit(1))
    any_ = history.select(item).distinct().withColumn("_item", F.lit(1))
    kind = F.when(F.col("_pair") == 1, "known").when(F.col("_item") == 1, "new_in_program").otherwise("fully_new")
    return targets.join(pair, [program, item], "left").join(any_, item, "left").withColumn("novelty", kind).drop("_pair", "_item")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, value, n`` of several candidate columns, in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(cells.alias("x")).groupBy("x.column_name", "x.value").agg(F.count("*").alias("n"))


def group_sizes(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Per ``by``: groups, and their least, mean and greatest size."""
    n = df.groupBy(by, *keys).agg(F.count("*").alias("_n"))
    return n.groupBy(by).agg(F.count("*").alias("groups"), F.min("_n").alias("min_size"), F.avg("_n").alias("mean_size"), F.max("_n").alias("max_size"))


def top_counts(df: DataFrame, by: str, column: str, n: int = 20) -> DataFrame:
    """The most frequent values of each ``by``; of equals the smallest."""
    counts = df.groupBy(by, column).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.col("n").desc(), F.col(column))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def tagged_union(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """All rows of several frames, with the name of theirs; columns that a frame lacks are NULL."""
    out = None
    for name, df in frames.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def census(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``membership, n``: keys of both sides, of the left only and of the right only."""
    x, y = a.select(key).where(F.col(key).isNotNull()), b.select(key).where(F.col(key).isNotNull())
    parts = {"both": x.intersect(y), "left": x.subtract(y), "right": y.subtract(x)}
    return tagged_union(parts, "membership").groupBy("membership").agg(F.count("*").alias("n"))


def parity_report(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """``check, n``: rows of either side only, repeated keys, missing and differing values; parity wants zeros throughout."""
    diff = joins.full_diff(a, b, keys, columns, tolerance)
    cells = [("left_only", F.count_if(F.col("side") == "left")), ("right_only", F.count_if(F.col("side") == "right")), *[(f"{c}_differs", F.count_if(F.col(f"{c}_differs") == 1)) for c in columns]]
    sides = [("left", a), ("right", b)]
    out = diff.agg(F.array(*[F.struct(F.lit(n).alias("check"), c.alias("n")) for n, c in cells]).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    for name, df in sides:
        per = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("n"))
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).select(F.explode(F.array(*[F.struct(F.lit(f"{c}_nulls_{name}").alias("check"), F.col(c).alias("n")) for c in columns])).alias("x")).select("x.*")
        out = out.unionByName(per.select(F.lit(f"repeated_{name}").alias("check"), "n")).unionByName(nulls)
    return out


def replacement_signal(pairs: DataFrame, history: DataFrame, new: str, old: str, key: str, period: str) -> DataFrame:
    """For pairs of a new and an old id: calendar steps from the old one's last period to the new one's first, and what that says."""
    ranked = history.select(period).distinct().withColumn("_pos", F.dense_rank().over(Window.orderBy(period)))  # one row a period
    span = history.select(key, period).distinct().join(F.broadcast(ranked), period).groupBy(key).agg(F.min("_pos").alias("_first"), F.max("_pos").alias("_last"))
    out = pairs.join(span.select(F.col(key).alias(new), "_first"), new).join(span.select(F.col(key).alias(old), "_last"), old)
    steps = F.col("_first") - F.col("_last")
    return out.withColumn("steps", steps).withColumn("signal", F.when(steps == 1, "direct").when(steps > 1, "gap").otherwise("overlap")).drop("_first", "_last")


def gain_rank(df: DataFrame, gain: str, out: str = "rank") -> DataFrame:
    """Rank by gain, greatest first, equals sharing the least rank; for short tables of runs or features."""
    return df.withColumn(out, F.rank().over(Window.orderBy(F.col(gain).desc())))


def leaderboard(runs: DataFrame, metric: str, tie: str, n: int = 20, ascending: bool = False) -> DataFrame:
    """The best runs by a metric."""
    order = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return runs.orderBy(order, F.col(tie)).limit(n)
