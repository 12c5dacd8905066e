"""More registered queries: cleaning rules, preparation, contracts, audits, plans; same form as in ``queries``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import clean
from .operators import cascade, difficulty, expect, joins, matching, neighbors, parity, peers, prepare, profile, timeline
from .plans import binding, pipelines, planning
from .plans.binding import TERM, table
from .queries import _POINTS, _points, query, r6

_UNITS = "units AS (SELECT * REPLACE ((program + line * line) % 5 AS unit) FROM enrol)"


def _units(spark, sf):
    return binding.enrolment(spark, sf).withColumn("unit", (F.col("program") + F.col("line") * F.col("line")) % 5)


# Cleaning rules


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey END AS as_int, s_suppkey % 4 IN (1, 3) AS not_integral, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey::DOUBLE WHEN 1 THEN s_suppkey + 0.5::DOUBLE END AS as_double,
(s_suppkey // 4) || CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END AS numeric_id, CAST(s_suppkey AS VARCHAR) AS light, CASE WHEN s_suppkey % 2 = 0 THEN '111' ELSE CAST(112 + s_suppkey % 3 AS VARCHAR) END AS owner, s_suppkey % 2 = 0 AS conflict,
nullif(concat_ws(' | ', CASE WHEN s_suppkey % 2 = 0 THEN 'even' END, CASE WHEN s_suppkey % 3 = 0 THEN 'third' END), '') AS reasons, CAST(s_nationkey AS VARCHAR) AS last_part, '0' || lpad(CAST(s_suppkey AS VARCHAR), 20, '0') || '/1a' AS natural_order,
CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 2 <> s_suppkey % 3 END AS changed, s_suppkey % 3 = 0 AS is_allowed, 7.0::DOUBLE AS absent, CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal END AS known FROM supplier""",
    base=False,
)
def scalar_rules(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").withColumn("v", F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(".0"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".5"))).when(k % 4 == 2, F.lit("  ")).otherwise(F.concat(F.lit("x"), k.cast("string"))))
    ids = [F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".111"))).otherwise(k.cast("string")), F.concat(k.cast("string"), F.lit("."), (k % 3 + 112).cast("string"))]
    reasons = clean.append_reason(clean.append_reason(F.lit(None).cast("string"), k % 2 == 0, "even"), k % 3 == 0, "third")
    return s.select(
        "s_suppkey",
        clean.strict_int(F.col("v")).alias("as_int"),
        clean.not_integral(F.col("v")).alias("not_integral"),
        clean.lenient_double(F.col("v")).alias("as_double"),
        clean.clean_numeric_id(k / 4).alias("numeric_id"),
        clean.light_id(F.concat(k.cast("string"), F.lit(".00 "))).alias("light"),
        clean.owner_from_ids(ids).alias("owner"),
        clean.owner_conflict(ids).alias("conflict"),
        reasons.alias("reasons"),
        clean.last_of_key(clean.composite_key(k, F.col("s_nationkey"))).alias("last_part"),
        F.array_join(clean.natural_key(F.concat(k.cast("string"), F.lit(".a"))), "/").alias("natural_order"),
        clean.tri_state_changed(F.when(k % 5 != 0, k % 2), k % 3).alias("changed"),
        clean.allowed(F.when(k % 3 == 0, "Y").when(k % 3 == 1, "N")).alias("is_allowed"),
        clean.column_or(s, "absent", 7).alias("absent"),
        clean.nan_to_null(F.when(k % 6 != 0, F.col("s_acctbal")).otherwise(F.lit(float("nan")))).alias("known"),
    )


@query(
    """SELECT 'p_retailprice' AS column_name, count(*) AS n, CAST(0 AS BIGINT) AS nulls, count(*) FILTER (WHERE abs(p_retailprice - round(p_retailprice)) <= 1e-9) AS integral, count(*) FILTER (WHERE abs(p_retailprice - round(p_retailprice)) > 1e-9) AS fractional, CAST(0 AS BIGINT) AS not_numbers FROM part
UNION ALL SELECT 'p_name', count(*), 0, 0, 0, count(*) FROM part""",
    base=False,
)
def integer_likeness(spark, sf):
    p = table(spark, sf, "part")
    one = lambda c: profile.integer_like(p, c).select(F.lit(c).alias("column_name"), "*")
    return one("p_retailprice").unionByName(one("p_name"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", base=False)
def duplicate_rows(spark, sf):
    return profile.exact_duplicates(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query("SELECT flag, count(*) AS n, (SELECT count(*) FROM enrol WHERE flag = 'A' AND brand % 2 = 0) AS barred, (SELECT count(*) FROM enrol WHERE flag = 'A' AND brand % 2 = 0 AND mark <> 2) AS barred_with_mark, (SELECT count(*) FROM enrol WHERE NOT (flag = 'A' AND brand % 2 = 0) AND mark = 2) AS zero FROM enrol WHERE NOT (flag = 'A' AND brand % 2 = 0) AND mark <> 2 GROUP BY flag")
def barred_rows(spark, sf):
    e = binding.enrolment(spark, sf).withColumn("mark", F.col("mark") - 2)
    kept, gate = cascade.barred_at_zero(e, (F.col("flag") == "A") & (F.col("brand") % 2 == 0), "mark")
    return kept.groupBy("flag").agg(F.count("*").alias("n")).crossJoin(F.broadcast(gate))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS supplier, s_nationkey AS nation, upper(s_name) AS code, s_acctbal AS balance FROM supplier", base=False)
def registry_cast(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".7")).alias("supplier"), F.concat(F.col("s_nationkey").cast("string"), F.lit(".0")).alias("nation"), F.concat(F.lit(" "), F.col("s_name")).alias("code"), F.col("s_acctbal").cast("string").alias("balance"))
    out = prepare.normalize_ids(s, {"supplier": "suffixed", "nation": "integer", "code": "code", "balance": "number", "elsewhere": "text"})
    return out.withColumn("nation", F.col("nation").cast("int"))


_GRADES = """gr(grade, version, lo, hi, points, finish) AS (VALUES ('A', 'v1', 98, 100, 4.0, 'P'), ('A-', 'v1', 95, 97, 3.75, 'P'), ('B+', 'v1', 90, 94, 3.5, 'P'), ('B', 'v1', 85, 89, 3.25, 'P'), ('B-', 'v1', 80, 84, 3.0, 'P'), ('C+', 'v1', 75, 79, 2.75, 'P'), ('C', 'v1', 70, 74, 2.5, 'P'),
('C-', 'v1', 65, 69, 2.25, 'P'), ('D+', 'v1', 60, 64, 2.0, 'P'), ('D', 'v1', 55, 59, 1.75, 'P'), ('D-', 'v1', 50, 54, 1.5, 'P'), ('F', 'v1', 0, 49, 0.0, 'F'), ('W', 'v1', 0, 0, 0.0, 'FA'), ('I', 'v1', 0, 0, 0.0, 'X'), ('Z', 'v2', 0, 100, 4.0, 'P'), ('Y', 'v2', 0, 101, 4.0, 'P'), ('V', 'v2', 0, 10, 9.0, 'P'), (NULL, 'v2', 0, 10, 1.0, 'P'))"""


def _grades(spark):
    names = ["F", "D-", "D", "D+", "C-", "C", "C+", "B-", "B", "B+", "A-", "A"]
    highs = [g[0] - 1 for g in binding.GRADES[1:]] + [100]
    rows = [(n, "v1", low, high, p / 100, "F" if n == "F" else "P") for n, (low, p), high in zip(names, binding.GRADES, highs, strict=True)]
    rows += [("W", "v1", 0, 0, 0.0, "FA"), ("I", "v1", 0, 0, 0.0, "X"), ("Z", "v2", 0, 100, 4.0, "P"), ("Y", "v2", 0, 101, 4.0, "P"), ("V", "v2", 0, 10, 9.0, "P"), (None, "v2", 0, 10, 1.0, "P")]
    return spark.createDataFrame(rows, "grade string, version string, lo int, hi int, points double, finish string")


@query(
    f"WITH {_GRADES} SELECT grade, version, CASE WHEN finish NOT IN ('P', 'F', 'FE', 'FA') THEN 'finish_status' WHEN grade IS NULL THEN 'missing' WHEN hi > 100 THEN 'bounds' WHEN points > 4 THEN 'points' END AS reject_reason FROM gr",
    base=False,
)
def grade_cleaning(spark, sf):
    return cascade.cascade(_grades(spark), prepare.grade_rules("finish", "lo", "hi", "points", ["grade"])).select("grade", "version", "reject_reason")


@query(
    f"WITH {_GRADES}, s AS (SELECT * FROM gr WHERE version = 'v1' AND hi > lo) SELECT CAST(m.mark AS INTEGER) AS mark, count(s.lo) AS n, CAST(max(s.points) AS DOUBLE) AS points FROM (SELECT unnest(range(0, 101)) AS mark) m LEFT JOIN s ON m.mark BETWEEN s.lo AND s.hi GROUP BY m.mark",
    base=False,
)
def scale_from_grades(spark, sf):
    scale = prepare.require_scale(prepare.scale_from_table(_grades(spark), "version", "lo", "hi", "points", "v1"))
    return joins.range_lookup(prepare.scale_cover(scale), "mark", scale, "low", {"points": "points"}, prepare.MARKS)


@query("SELECT entity, program, period, n_items, gpa FROM terms WHERE gpa > 0")
def model_population(spark, sf):
    t = binding.terms(spark, sf).withColumn("known", F.when(F.col("gpa") > 0, F.col("gpa"))).select(*TERM, "n_items", "gpa", "known", "points")
    return prepare.population(t, ["known", "points"], ["known"])


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE brand = 13) AS missing, count(*) FILTER (WHERE brand <> 13 AND mark > 96) AS outside FROM enrol")
def target_checks(spark, sf):
    e = binding.enrolment(spark, sf).withColumn("target", F.when(F.col("brand") != 13, F.col("mark") + 4))
    return prepare.target_report(e, "target")


@query("SELECT entity, item, count(*) AS n FROM enrol GROUP BY ALL")
def stripped_identities(spark, sf):
    e = binding.enrolment(spark, sf)
    left = prepare.strip_outcomes(e, ["mark", "flag", "score100"])
    return left.groupBy("entity", "item").agg(F.count("*").alias("n")) if not {"mark", "flag", "score100"} & set(left.columns) else e.limit(0)


@query(
    """c AS (SELECT *, CASE WHEN period % 10 <> 4 THEN lag(gpa) OVER w END AS raw, CASE WHEN entity % 3 <> 0 THEN round(avg(gpa) OVER b, 4) END AS start FROM history
  WINDOW w AS (PARTITION BY entity, program ORDER BY period), b AS (PARTITION BY entity, program ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, coalesce(raw, 0) <= 0 AND coalesce(last_valid, 0) <= 0 AND coalesce(start, 0) <= 0 AS fell, entity % 4 AS level FROM c)
SELECT entity, program, period, CASE WHEN is_first_row <> 1 THEN 'returning_without_history' ELSE 'advanced_standing' END AS suspicion FROM f WHERE fell AND (is_first_row <> 1 OR level >= 2)"""
)
def zero_fallbacks(spark, sf):
    from .queries import _chained

    rows = _chained(spark, sf).withColumn("level", F.col("entity") % 4)
    return prepare.suspicious_fallbacks(rows, "prev_source", "is_first_row", "level").select(*TERM, "suspicion")


@query("SELECT row_id, CAST(entity AS VARCHAR) AS student, period AS term, flag AS status FROM enrol")
def roster_prepared(spark, sf):
    e = binding.enrolment(spark, sf).select(F.col("row_id").alias("Row ID"), F.concat(F.col("entity").cast("string"), F.lit(".111")).alias(" Student"), F.concat(F.col("period").cast("string"), F.lit(".0")).alias("TERM"), F.lower("flag").alias("status"))
    out = prepare.prepare_roster(e, {"row_id": "text", "student": "suffixed", "term": "integer", "status": "code"}, "row_id", ["student", "term"])
    return out.withColumn("term", F.col("term").cast("int"))


# Joins and contracts


@query(
    """s AS (SELECT entity, program, period, reg_credits, n_items, entity || '-' || program || '-' || period AS status_key FROM terms WHERE n_items > 1), g AS (SELECT DISTINCT mark, points FROM graded WHERE mark >= 20)
SELECT e.row_id, s.reg_credits, CAST(s.status_key IS NOT NULL AS INTEGER) AS has_status, g.points, CAST(g.mark IS NOT NULL AS INTEGER) AS has_grade FROM enrol e LEFT JOIN s ON s.status_key = e.entity || '-' || e.program || '-' || e.period LEFT JOIN g ON g.mark = e.mark"""
)
def reference_attach(spark, sf):
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in TERM]).alias("status_key")
    status = binding.terms(spark, sf).where("n_items > 1").select(key, "reg_credits")
    grades = binding.graded(spark, sf).where("mark >= 20").select("mark", "points").distinct()
    rows = binding.enrolment(spark, sf).select("row_id", "mark", key)
    return prepare.attach_references(rows, status, grades, "status_key", "mark", ["row_id"]).select("row_id", "reg_credits", "has_status", "points", "has_grade")


_ROSTER_COPY = "ro AS (SELECT row_id, entity, CASE WHEN brand = 3 THEN item || '?' ELSE item END AS item FROM enrol WHERE brand <> 5 UNION ALL SELECT row_id, entity, item FROM enrol WHERE brand = 7)"


def _roster_copy(e):
    return e.where("brand <> 5").select("row_id", "entity", F.when(F.col("brand") == 3, F.concat("item", F.lit("?"))).otherwise(F.col("item")).alias("item")).unionByName(e.where("brand = 7").select("row_id", "entity", "item"))


@query(f"{_ROSTER_COPY}, n AS (SELECT row_id, count(*) AS n, min(item) AS item FROM ro GROUP BY row_id) SELECT e.row_id, CASE WHEN n IS NULL THEN 'absent' WHEN n > 1 THEN 'repeated' WHEN n.item <> e.item THEN 'keys_differ' ELSE 'ok' END AS contract FROM enrol e LEFT JOIN n ON n.row_id = e.row_id")
def roster_contract(spark, sf):
    e = binding.enrolment(spark, sf)
    return prepare.target_contract(e, _roster_copy(e), "row_id", ["entity", "item"]).select("row_id", "contract")


@query(
    """t AS (SELECT 'superset' AS gate, entity, program, period, item FROM enrol WHERE brand % 9 = 0), b AS (SELECT entity, program, period, gpa FROM terms)
SELECT 'superset' AS gate, count(*) AS n FROM (SELECT DISTINCT entity, program, period, item FROM t) UNION ALL SELECT 'template', count(*) FROM b WHERE entity % 5 = 0 OR entity % 3 = 0 AND gpa > 0"""
)
def build_gates(spark, sf):
    e, t = binding.enrolment(spark, sf), binding.terms(spark, sf).select(*TERM, "gpa")
    lost = prepare.lost_members(e, e.where("brand % 9 <> 0 or brand is null"), [*TERM], "item")
    built = t.where("entity % 5 <> 0").withColumn("gpa", F.when(F.col("entity") % 3 == 0, F.col("gpa") * 2).otherwise(F.col("gpa")))
    differs = prepare.template_differences(t, built, TERM, ["gpa"])
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("gate"), "n")
    # a pair is lost only if no other row of its period has the item
    return one(lost, "superset").unionByName(one(differs, "template"))


@query("k AS (SELECT program, item, count(DISTINCT credits + line) AS n FROM enrol GROUP BY ALL) SELECT program, item, n FROM k WHERE n > 1")
def reuse_conflicts(spark, sf):
    e = binding.enrolment(spark, sf).withColumn("o", F.col("credits") + F.col("line"))
    return joins.tier_conflicts(e, ["program", "item"], ["o"])


@query(
    """SELECT 'unique row_id' AS gate, (SELECT count(*) = count(DISTINCT row_id) FROM enrol) AS passed UNION ALL SELECT 'unique entity and item', (SELECT count(*) = 0 FROM (SELECT 1 FROM enrol GROUP BY entity, item HAVING count(*) > 1))
UNION ALL SELECT 'marks in 0..100', (SELECT count(*) = 0 FROM enrol WHERE mark NOT BETWEEN 0 AND 100) UNION ALL SELECT 'marks in 0..90', (SELECT count(*) = 0 FROM enrol WHERE mark NOT BETWEEN 0 AND 90)
UNION ALL SELECT 'same rows', true UNION ALL SELECT 'fewer rows', false UNION ALL SELECT 'columns', false UNION ALL SELECT 'no outcome', false UNION ALL SELECT 'covered', true UNION ALL SELECT 'target', true
UNION ALL SELECT 'contract', (SELECT count(*) = 0 FROM enrol WHERE brand IN (3, 5, 7))"""
)
def gates(spark, sf):
    e = binding.enrolment(spark, sf)
    tries = {
        "unique row_id": lambda: expect.require_unique(e, ["row_id"]),
        "unique entity and item": lambda: expect.require_unique(e, ["entity", "item"]),
        "marks in 0..100": lambda: expect.expect(e, expect.in_range("mark", 0, 100) | expect.not_null("mark")),
        "marks in 0..90": lambda: expect.expect(e, expect.in_range("mark", 0, 90)),
        "same rows": lambda: expect.require_same_keys(e, binding.attempted(spark, sf), ["row_id"]),
        "fewer rows": lambda: expect.require_same_keys(e, e.where("brand <> 1"), ["row_id"]),
        "columns": lambda: expect.require_columns(e, ["row_id", "absent"]),
        "no outcome": lambda: expect.forbid_columns(e, ["mark"], ["^final_"]),
        "covered": lambda: joins.require_covered(e.select("item"), e, ["item"]),
        "target": lambda: prepare.require_target(e, "mark"),
        "contract": lambda: prepare.require_target_contract(e, _roster_copy(e), "row_id", ["entity", "item"]),
    }

    def passes(gate) -> bool:
        try:
            gate()
        except (expect.ExpectationError, ValueError):
            return False
        return True

    return spark.createDataFrame([(k, passes(g)) for k, g in tries.items()], "gate string, passed boolean")


@query(
    """SELECT e.row_id, h.last_valid, h.second_last_valid, round(h.last_valid - h.second_last_valid, 6) AS trend FROM enrol e JOIN history h USING (entity, program, period)"""
)
def trend_items(spark, sf):
    return pipelines.trend_dataset(binding.enrolment(spark, sf), binding.terms(spark, sf)).select("row_id", "last_valid", "second_last_valid", *r6("trend"))


@query(
    f"""{_POINTS}, d AS (SELECT q.program, q.entity, p.entity AS ne, p.period AS np, row_number() OVER (PARTITION BY q.program, q.entity ORDER BY abs(p.gpa - q.gpa), p.period, p.entity) AS rank FROM pts q JOIN pts p ON p.program = q.program AND p.entity <> q.entity)
SELECT d.program, d.entity, e.item, count(*) AS n FROM d JOIN enrol e ON e.program = d.program AND e.entity = d.ne AND e.period = d.np WHERE rank <= 5 GROUP BY ALL"""
)
def neighbor_item_counts(spark, sf):
    p = _points(spark, sf)
    near = neighbors.nearest_1d(p.withColumn("query", F.col("entity")), p, ["program"], "gpa", "query", "entity", "period", 5)
    items = binding.enrolment(spark, sf).select("program", F.col("entity").alias("neighbor_entity"), F.col("period").alias("neighbor_period"), "item")
    return neighbors.neighbor_items(near, items, ["program", "neighbor_entity", "neighbor_period"]).groupBy("program", F.col("query").alias("entity"), "item").agg(F.count("*").alias("n"))


# Aggregations and windows


@query("SELECT entity, program, period, max(credits) AS credits, max(brand) AS brand, count(*) AS n_rows FROM enrol GROUP BY ALL")
def period_maxima(spark, sf):
    return timeline.collapse_periods(binding.enrolment(spark, sf), TERM, ["credits", "brand"])


@query(f"{_UNITS} SELECT program, unit AS usual_unit FROM (SELECT program, unit, row_number() OVER (PARTITION BY program ORDER BY count(*) DESC, unit) AS k FROM units GROUP BY program, unit) WHERE k = 1")
def unit_modes(spark, sf):
    return difficulty.usual_unit(_units(spark, sf), difficulty.Roles())


@query(f"{_UNITS}, m AS (SELECT program, period, unit FROM (SELECT program, period, unit, row_number() OVER (PARTITION BY program, period ORDER BY count(*) DESC, unit) AS k FROM units GROUP BY program, period, unit) WHERE k = 1) SELECT program, string_agg(DISTINCT CAST(unit AS VARCHAR), ',' ORDER BY CAST(unit AS VARCHAR)) AS units FROM m GROUP BY program HAVING count(DISTINCT unit) > 1")
def unit_change_gate(spark, sf):
    return difficulty.unit_changes(_units(spark, sf)).withColumn("units", F.array_join("units", ","))


@query("SELECT entity, program, period, item, count(DISTINCT credits) AS credits, count(DISTINCT line) AS line, count(DISTINCT flag) AS flag FROM enrol GROUP BY entity, program, period, item HAVING count(DISTINCT line) > 1 OR count(DISTINCT flag) > 1 OR count(DISTINCT credits) > 1")
def member_disagreements(spark, sf):
    return peers.member_conflicts(binding.enrolment(spark, sf), TERM, "item", ["credits", "line", "flag"])


@query(
    """SELECT entity, program, period, round(gpa - last_valid, 6) AS cumulative_delta, CAST(round(gpa - last_valid, 6) > 0 AS INTEGER) AS cumulative_improved, is_interruption AS level_delta, CAST(is_interruption > 0 AS INTEGER) AS level_advanced FROM history"""
)
def period_deltas(spark, sf):
    h = binding.history(spark, sf).withColumn("level_after", F.col("prior_interruptions") + F.col("is_interruption")).withColumn("before", F.round("last_valid", 6))
    out = prepare.outcome_deltas(h, "before", "gpa", "prior_interruptions", "level_after").withColumn("cumulative_delta", F.round("cumulative_delta", 6))
    return out.select(*TERM, "cumulative_delta", clean.positive_flag(F.col("cumulative_delta")).alias("cumulative_improved"), F.col("level_delta").cast("int").alias("level_delta"), "level_advanced")


@query("SELECT entity, program, period, arg_min(credits, row_id) AS credits, arg_min(flag, row_id) AS flag, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n_items FROM enrol GROUP BY entity, program, period")
def period_snapshots(spark, sf):
    return prepare.snapshot_outcomes(binding.enrolment(spark, sf), TERM, "item", "row_id", ["credits", "flag"]).withColumn("items", F.array_join("items", ","))


_SPLIT = "sp AS (SELECT *, CASE WHEN period <= 20003 THEN 'train' ELSE 'later' END AS split FROM enrol)"


def _split(spark, sf):
    return binding.enrolment(spark, sf).withColumn("split", F.when(F.col("period") <= 20003, "train").otherwise("later"))


@query(f"{_SPLIT}, n AS (SELECT split, count(*) AS n FROM sp GROUP BY split, entity, program, period) SELECT split, count(*) AS groups, min(n) AS min_size, round(avg(n), 6) AS mean_size, max(n) AS max_size FROM n GROUP BY split")
def split_group_sizes(spark, sf):
    return prepare.group_sizes(_split(spark, sf), TERM, "split").withColumn("mean_size", F.round("mean_size", 6))


@query(f"{_SPLIT} SELECT split, item, n, CAST(k AS INTEGER) AS rank FROM (SELECT split, item, count(*) AS n, row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, item) AS k FROM sp GROUP BY split, item) WHERE k <= 20")
def split_top_items(spark, sf):
    return prepare.top_counts(_split(spark, sf), "split", "item")


@query(
    """a AS (SELECT entity, program, period, reg_credits, gpa FROM terms WHERE entity % 11 <> 0), b AS (SELECT entity, program, period, CASE WHEN entity % 7 <> 0 THEN reg_credits END AS reg_credits, gpa FROM terms WHERE entity % 13 <> 0), j AS (SELECT a.gpa AS ag, b.gpa AS bg, a.reg_credits AS ar, b.reg_credits AS br FROM a FULL JOIN b USING (entity, program, period))
SELECT 'left_only' AS "check", count(*) FILTER (WHERE bg IS NULL) AS n FROM j UNION ALL SELECT 'right_only', count(*) FILTER (WHERE ag IS NULL) FROM j UNION ALL SELECT 'reg_credits_differs', count(*) FILTER (WHERE ag IS NOT NULL AND bg IS NOT NULL AND ar IS DISTINCT FROM br) FROM j
UNION ALL SELECT 'gpa_differs', count(*) FILTER (WHERE ag <> bg) FROM j UNION ALL SELECT 'repeated_left', 0 UNION ALL SELECT 'repeated_right', 0 UNION ALL SELECT 'reg_credits_nulls_left', 0 UNION ALL SELECT 'gpa_nulls_left', 0
UNION ALL SELECT 'reg_credits_nulls_right', count(*) FILTER (WHERE reg_credits IS NULL) FROM b UNION ALL SELECT 'gpa_nulls_right', 0"""
)
def parity_audit(spark, sf):
    t = binding.terms(spark, sf).select(*TERM, "reg_credits", "gpa")
    b = t.where("entity % 13 <> 0").withColumn("reg_credits", F.when(F.col("entity") % 7 != 0, F.col("reg_credits")))
    return prepare.parity_report(t.where("entity % 11 <> 0"), b, TERM, ["reg_credits", "gpa"])


@query("SELECT category, count(*) FILTER (WHERE mark < 10) AS changed, count(*) FILTER (WHERE mark < 10) >= greatest(100, ceil(count(*) * 0.05)) AS is_material FROM enrol GROUP BY category")
def material_changes(spark, sf):
    per = binding.enrolment(spark, sf).groupBy("category").agg(F.count_if(F.col("mark") < 10).alias("changed"), F.count("*").alias("_n"))
    return per.select("category", "changed", parity.material(F.col("changed"), F.col("_n"), 100, 0.05).alias("is_material"))


@query(
    """h AS (SELECT program, item FROM enrol WHERE period < 19952 AND brand % 4 <> 0 AND (program + brand) % 3 <> 0)
SELECT novelty, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.program = t.program AND h.item = t.item) THEN 'known' WHEN EXISTS (SELECT 1 FROM h WHERE h.item = t.item) THEN 'new_in_program' ELSE 'fully_new' END AS novelty FROM (SELECT program, item FROM enrol WHERE period >= 20001) t) GROUP BY novelty"""
)
def novelty(spark, sf):
    e = binding.enrolment(spark, sf)
    old = e.where("period < 19952 and brand % 4 <> 0 and (program + brand) % 3 <> 0")
    return prepare.fully_new(e.where("period >= 20001").select("program", "item"), old, "program", "item").groupBy("novelty").agg(F.count("*").alias("n"))


@query("SELECT 'flag' AS column_name, flag AS value, count(*) AS n FROM enrol GROUP BY ALL UNION ALL SELECT 'category', category, count(*) FROM enrol GROUP BY ALL UNION ALL SELECT 'credits', CAST(credits AS VARCHAR), count(*) FROM enrol GROUP BY ALL")
def status_hunt(spark, sf):
    return prepare.value_counts(binding.enrolment(spark, sf), ["flag", "category", "credits"])


@query(
    """f AS (SELECT *, last_value(valid IGNORE NULLS) OVER (PARTITION BY entity, program ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled, last_value(CASE WHEN valid IS NOT NULL THEN period END IGNORE NULLS) OVER (PARTITION BY entity, program ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source_period FROM history)
SELECT entity, program, period, lag(filled, 2) OVER (PARTITION BY entity, program ORDER BY period) AS lagged, source_period, CAST(prior_interruptions = 0 AND prior_run = 0 AS INTEGER) AS starts_clean FROM f"""
)
def trend_variants(spark, sf):
    h = binding.history(spark, sf)
    valid = F.when((F.col("gpa") > 0) & (F.col("is_interruption") == 0), F.col("gpa"))
    line = ["entity", "program"]
    h = h.withColumn("source_period", timeline.source_period(line, "period", valid.isNotNull()))
    return h.select(*TERM, timeline.lagged_trend(h, line, "period", valid).alias("lagged"), "source_period", timeline.first_active(["prior_interruptions", "prior_run"]).alias("starts_clean"))


@query("SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY entity, category ORDER BY period, row_id) AS k FROM enrol) WHERE k <= 2")
def first_two(spark, sf):
    return timeline.first_rows(binding.enrolment(spark, sf), ["entity", "category"], [F.col("period"), F.col("row_id")], 2).select("row_id")


@query("SELECT category, gain, CAST(rank() OVER (ORDER BY gain DESC) AS INTEGER) AS rank FROM (SELECT category, CAST(sum(score100 // 20 - mark // 50) // count(*) AS BIGINT) AS gain FROM enrol GROUP BY category)")
def gain_ranks(spark, sf):
    whole = lambda c, n: F.floor(F.col(c) / n)
    per = binding.enrolment(spark, sf).groupBy("category").agg(F.floor(F.sum(whole("score100", 20) - whole("mark", 50)) / F.count("*")).alias("gain"))
    return prepare.gain_rank(per, "gain")


@query("SELECT item, n, round(mean, 6) AS mean FROM (SELECT item, count(*) AS n, avg(mark) AS mean FROM enrol GROUP BY item ORDER BY n DESC, item LIMIT 20)")
def best_items(spark, sf):
    per = binding.enrolment(spark, sf).groupBy("item").agg(F.count("*").alias("n"), F.round(F.avg("mark"), 6).alias("mean"))
    return prepare.leaderboard(per, "n", "item")


@query(
    """p AS (SELECT period, dense_rank() OVER (ORDER BY period) AS pos FROM (SELECT DISTINCT period FROM enrol)), s AS (SELECT entity, min(pos) AS f, max(pos) AS l, min(enrol.period) AS first_period, max(enrol.period) AS last_period FROM enrol JOIN p ON p.period = enrol.period GROUP BY entity)
SELECT c_custkey AS new, c_custkey - 1 AS old, CAST(n.f - o.l AS INTEGER) AS steps, CASE WHEN n.f - o.l = 1 THEN 'direct' WHEN n.f - o.l > 1 THEN 'gap' ELSE 'overlap' END AS signal FROM customer JOIN s n ON n.entity = c_custkey JOIN s o ON o.entity = c_custkey - 1"""
)
def id_replacement(spark, sf):
    pairs = table(spark, sf, "customer").select(F.col("c_custkey").alias("new"), (F.col("c_custkey") - 1).alias("old"))
    return prepare.replacement_signal(pairs, binding.enrolment(spark, sf), "new", "old", "entity", "period")


@query("p AS (SELECT period, dense_rank() OVER (ORDER BY period) AS pos FROM (SELECT DISTINCT period FROM enrol)), s AS (SELECT entity, min(period) AS a, max(period) AS b FROM enrol GROUP BY entity) SELECT entity, a, b, CAST(y.pos - x.pos AS INTEGER) AS steps FROM s JOIN p x ON x.period = a JOIN p y ON y.period = b")
def period_steps(spark, sf):
    e = binding.enrolment(spark, sf)
    span = e.groupBy("entity").agg(F.min("period").alias("a"), F.max("period").alias("b"))
    return timeline.period_distance(span, "a", "b", e, "period").select("entity", "a", "b", "steps")


@query("SELECT row_id, mark, NULL AS flag, 'early' AS split FROM enrol WHERE period < 19961 UNION ALL SELECT row_id, NULL, flag, 'late' FROM enrol WHERE period >= 20011")
def tagged_rows(spark, sf):
    e = binding.enrolment(spark, sf)
    return prepare.tagged_union({"early": e.where("period < 19961").select("row_id", "mark"), "late": e.where("period >= 20011").select("row_id", "flag")}, "split")


@query("a AS (SELECT DISTINCT entity FROM enrol WHERE period < 19961), b AS (SELECT DISTINCT entity FROM enrol WHERE period >= 20011) SELECT membership, count(*) AS n FROM (SELECT 'both' AS membership FROM a JOIN b USING (entity) UNION ALL SELECT 'left' FROM a WHERE entity NOT IN (SELECT entity FROM b) UNION ALL SELECT 'right' FROM b WHERE entity NOT IN (SELECT entity FROM a)) GROUP BY membership")
def id_census(spark, sf):
    e = binding.enrolment(spark, sf)
    return prepare.census(e.where("period < 19961"), e.where("period >= 20011"), "entity")


# Entity matching

_PROFILES = "p AS (SELECT item, category, brand, credits, list_sort(list(DISTINCT program)) AS programs, list_sort(list(DISTINCT line)) AS lines FROM enrol WHERE (program + line + brand) % 4 = 0 GROUP BY item, category, brand, credits), c AS (SELECT n.item AS new, o.item AS old, n.credits AS nc, o.credits AS oc, n.programs AS np, o.programs AS op, n.lines AS nl, o.lines AS ol, n.brand AS nb FROM p n JOIN p o ON n.category = o.category AND n.brand = o.brand + 1)"


def _profiles(spark, sf):
    e = binding.enrolment(spark, sf).where("(program + line + brand) % 4 = 0")
    p = e.groupBy("item", "category", "brand", "credits").agg(F.array_sort(F.collect_set("program")).alias("programs"), F.array_sort(F.collect_set("line")).alias("lines"))
    a, b = (p.select(*[F.col(c).alias(f"{x}_{c}") for c in p.columns]) for x in ("a", "b"))
    on = (F.col("a_category") == F.col("b_category")) & (F.col("a_brand") == F.col("b_brand") + 1)
    return matching.profile_overlaps(a, b, on, ["programs", "lines"])


@query(f"{_PROFILES} SELECT new, old, CAST(list_has_any(np, op) AS INTEGER) AS programs_meets, CAST(list_has_any(nl, ol) AS INTEGER) AS lines_meets FROM c")
def profile_meets(spark, sf):
    return _profiles(spark, sf).select(F.col("a_item").alias("new"), F.col("b_item").alias("old"), "programs_meets", "lines_meets")


def _signals():
    return {"credits": (F.col("a_credits") == F.col("b_credits"), 0.5), "programs": (F.col("programs_meets") == 1, 0.25), "lines": (F.col("lines_meets") == 1, 0.125)}


_SCORES = f"{_PROFILES}, s AS (SELECT new, old, nb, CASE WHEN nc = oc THEN 0.5 ELSE 0 END::DOUBLE AS credits, CASE WHEN list_has_any(np, op) THEN 0.25 ELSE 0 END::DOUBLE AS programs, CASE WHEN list_has_any(nl, ol) THEN 0.125 ELSE 0 END::DOUBLE AS lines FROM c)"


@query(f"{_SCORES} SELECT new, old, credits, programs, lines, credits + programs + lines AS score FROM s")
def evidence_shares(spark, sf):
    rows = _profiles(spark, sf).withColumn("parts", matching.evidence_parts(_signals()))
    return rows.select(F.col("a_item").alias("new"), F.col("b_item").alias("old"), "parts.*", matching.evidence_score(_signals()).alias("score"))


@query(f"{_SCORES} SELECT new, old, credits + programs + lines AS score, CASE WHEN nb % 3 = 0 THEN 'open' WHEN credits + programs + lines >= 0.75 THEN 'confirmed' WHEN credits + programs + lines >= 0.3 THEN 'probable' ELSE 'unlikely' END AS bucket FROM s")
def censored_classes(spark, sf):
    rows = _profiles(spark, sf).select(F.col("a_item").alias("new"), F.col("b_item").alias("old"), F.col("a_brand").alias("brand"), matching.evidence_score(_signals()).alias("score"))
    return matching.classify_candidates(rows, "new", "score", 0.75, 0.3, censored=F.col("brand") % 3 == 0).select("new", "old", "score", "bucket")


# Neighbours, plans, parity


@query(
    """SELECT entity, program, period, CASE WHEN entity % 4 <> 0 AND last_valid > 0 THEN last_valid WHEN gpa > 0 THEN gpa END AS value, CASE WHEN entity % 4 <> 0 AND last_valid > 0 THEN 'cumulative' WHEN gpa > 0 THEN 'period' END AS source FROM history"""
)
def query_values(spark, sf):
    h = binding.history(spark, sf)
    value, source = neighbors.query_value([("cumulative", F.when(F.col("entity") % 4 != 0, F.col("last_valid")).otherwise(F.lit(float("nan")))), ("period", F.col("gpa"))])
    return h.select(*TERM, value.alias("value"), source.alias("source"))


@query(
    """i AS (SELECT entity, item, max(credits) AS credits, max(category) AS kind, CAST(max(brand) % 4 = 0 AS INTEGER) AS weak, sum(CASE WHEN mark >= 50 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS rate, period AS plan_id FROM enrol GROUP BY entity, item, period),
p AS (SELECT x.entity, x.plan_id, x.item, x.credits, count(y.item) AS n, avg(1 - y.rate) AS m, max(1 - y.rate) AS mx, coalesce(sum(y.weak), 0) AS w FROM i x LEFT JOIN i y ON x.entity = y.entity AND x.plan_id = y.plan_id AND x.item <> y.item GROUP BY ALL)
SELECT entity, plan_id, item, CAST(sum(credits) OVER (PARTITION BY entity, plan_id) AS DOUBLE) AS plan_credits, round(m, 6) AS peer_mean, round(mx, 6) AS peer_max, n AS peer_count, CASE WHEN n > 0 THEN round(w / n::DOUBLE, 6) ELSE 0 END AS peer_weak_ratio FROM p"""
)
def plan_rescoring(spark, sf):
    e = binding.enrolment(spark, sf)
    rate = F.avg((F.col("mark") >= 50).cast("int")).alias("rate")
    items = e.groupBy("entity", F.col("period").alias("plan_id"), "item").agg(F.max("credits").alias("credits"), F.max("category").alias("kind"), (F.max("brand") % 4 == 0).cast("int").alias("weak"), rate)
    out = planning.rescored(items, ["entity", "plan_id"], "rate", "weak", "kind", "credits")
    return out.select("entity", "plan_id", "item", "plan_credits", *r6("peer_mean", "peer_max"), "peer_count", *r6("peer_weak_ratio"))


@query("SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', category, entity, item, mark, period, program)), 1, 15) AS BIGINT)) AS VARCHAR) AS total FROM enrol")
def content_fingerprint(spark, sf):
    return parity.portable_fingerprint(binding.enrolment(spark, sf), ["category", "entity", "item", "mark", "period", "program"])
