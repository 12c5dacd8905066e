"""Operators on hand-worked frames, against brute force, and by what must not change."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.functions import clean, text
from lodestone.operators import buckets, cascade, difficulty, expect, joins, matching, metrics, neighbors, parity, peers, profile, timeline
from lodestone.plans import binding, pipelines, planning
from lodestone.sources import tables
from lodestone.streaming import running


def test_trend_walks_the_valid_subsequence(spark):
    rng = random.Random(7)
    rows = [(e, 1, p, rng.choice([None, 0.0, 2.0, 2.5, 3.5]), rng.choice([0, 0, 1])) for e in range(40) for p in rng.sample(range(20101, 20140), rng.randint(1, 12))]
    df = spark.createDataFrame(rows, "entity long, program long, period long, gpa double, is_interruption int")
    got = {(r.entity, r.period): r for r in timeline.add_history(df, ["entity", "program"], "period").collect()}
    by = defaultdict(list)
    for e, _, p, g, i in rows:
        by[e].append((p, g, i))
    for e, seq in by.items():
        valid, run, count = [], 0, 0
        for k, (p, g, i) in enumerate(sorted(seq)):
            r = got[e, p]
            assert r.last_valid == (valid[-1] if valid else None)
            assert r.second_last_valid == (valid[-2] if len(valid) > 1 else None)
            assert (r.prior_run, r.prior_interruptions, r.is_first_row) == (run, count, int(k == 0))
            run, count = (run + 1 if i else 0), count + i
            if g and g > 0 and not i:
                valid.append(g)


def _accumulated(history, queries, k=20.0):
    """Statistics of each query by a plain pass over earlier periods."""

    def keys(r):
        c = round(r["credits"])
        return {1: f"{r['program']}__{r['item']}", 2: r["item"], 3: f"{r['program']}__{r['category']}__{c}", 4: f"{r['unit']}__{r['category']}__{c}", 5: f"{r['category']}__{c}"}

    out = []
    for q in queries:
        usual = defaultdict(lambda: defaultdict(int))
        for r in history:
            if r["period"] < q["period"]:
                usual[r["program"]][r["unit"]] += 1
        usual = {p: min(u, key=lambda x: (-u[x], x)) for p, u in usual.items()}
        tabs, whole = {i: defaultdict(lambda: [0, 0, 0]) for i in range(1, 6)}, [0, 0, 0]
        for r in history:
            if r["period"] < q["period"]:
                marks = [1, int(r["mark"] >= 50), r["mark"]] if r["mark"] is not None else [0, 0, 0]
                for i, key in keys(r).items():
                    tabs[i][key] = [a + b for a, b in zip(tabs[i][key], marks, strict=True)]
                whole = [a + b for a, b in zip(whole, marks, strict=True)]
        if not whole[0]:
            out.append((6, None, None))
            continue
        rate = lambda t, p: (t[1] + k * p) / (t[0] + k)
        top = whole[1] / whole[0]

        def shrunk(level, key):
            if key not in tabs[level]:
                return top
            parent = top
            if level == 4:
                parent = shrunk(5, key.split("__", 1)[1])
            elif level == 3:
                program, rest = key.split("__", 1)
                parent = shrunk(4, f"{usual.get(int(program))}__{rest}")
            elif level == 1:
                parent = shrunk(2, key.split("__", 1)[1])
            return rate(tabs[level][key], parent)

        level = next((i for i, key in keys(q).items() if key in tabs[i]), 6)
        out.append((level, top if level == 6 else shrunk(level, keys(q)[level]), tabs[level][keys(q)[level]][0] if level < 6 else whole[0]))
    return out


def test_temporal_statistics_equal_an_accumulator_and_ignore_the_future(spark):
    rng = random.Random(3)
    names = ["row", "program", "item", "unit", "category", "credits", "mark", "attempt", "period"]
    rows = [(i, rng.randint(1, 4), f"i{rng.randint(1, 12)}", rng.randint(1, 3), rng.choice("ab"), float(rng.randint(1, 3)), rng.choice([None, *range(0, 101, 5)]), rng.randint(1, 3), rng.randint(1, 8)) for i in range(160)]
    schema = "row long, program long, item string, unit long, category string, credits double, mark int, attempt int, period long"
    df = spark.createDataFrame(rows, schema)
    dicts = [dict(zip(names, r, strict=True)) for r in rows]
    want = _accumulated(dicts, dicts)
    got = {r["row"]: r for r in difficulty.temporal(df, df).collect()}
    for d, (level, rate, support) in zip(dicts, want, strict=True):
        r = got[d["row"]]
        assert r["level"] == level
        assert rate is None and r["pass_rate"] is None or r["pass_rate"] == pytest.approx(rate, abs=1e-12)
        assert (support or 0) == r["group_support"]
    future = df.withColumns({c: F.when(F.col("period") > 5, x).otherwise(F.col(c)) for c, x in (("mark", 100 - F.col("mark")), ("unit", F.lit(3)), ("program", F.col("program") % 2 + 1))})
    again = {r["row"]: r for r in difficulty.temporal(future, future).where("period <= 6").collect()}
    assert all(again[k]["pass_rate"] == got[k]["pass_rate"] for k in again if again[k]["period"] <= 5)
    units = df.groupBy("program").agg(F.count_distinct("unit").alias("n")).where("n > 1").count()
    assert 0 < difficulty.unit_changes(df).count() <= units
    with pytest.raises(expect.ExpectationError):
        difficulty.temporal(df, df, checked=True)
    difficulty.require_stable_units(df.withColumn("unit", F.col("program")))


def test_frozen_state_is_saved_and_applied(spark, tmp_path):
    rows = [(1, "a", 1, "x", 2.0, 40, 1), (1, "a", 1, "x", 2.0, 60, 2), (1, "b", 2, "x", 2.0, 80, 1), (2, "a", 1, "y", 3.0, None, 1)]
    df = spark.createDataFrame(rows, "program long, item string, unit long, category string, credits double, mark int, attempt int")
    state = difficulty.fit(df)
    tables.save_state(state, str(tmp_path / "s"), "1", {"k": 20})
    back, params = tables.load_state(spark, str(tmp_path / "s"), "1")
    assert params == {"k": 20} and parity.same_rows(state, back.select(state.columns))
    with pytest.raises(ValueError):
        tables.load_state(spark, str(tmp_path / "s"), "2")
    asked = spark.createDataFrame([(2, "a", 1, "y", 3.0), (9, "b", 9, "z", 2.0), (9, "c", 9, "x", 2.0), (9, "c", 9, "q", 9.0), (1, "c", 1, "x", 2.0), (None, None, None, None, None)], "program long, item string, unit long, category string, credits double")
    got = difficulty.apply_state(asked, back).collect()
    assert sorted(r["level"] for r in got) == [1, 2, 3, 5, 6, 6]


def test_leave_one_out(spark):
    rows = [(1, "a", 0.9, 0, "x"), (1, "b", 0.5, 1, "x"), (1, "c", 0.7, 0, None), (2, "d", 0.4, 0, "x"), (3, "e", None, 0, "x"), (3, "f", 0.2, 0, "y"), (4, "g", 0.3, 0, "x"), (4, "h", 0.3, 0, "x")]
    df = spark.createDataFrame(rows, "g long, item string, rate double, weak int, kind string")
    got = {r["item"]: r for r in peers.leave_one_out(df, ["g"], "rate", "weak", "kind").collect()}
    near = lambda x: pytest.approx(x, abs=1e-12)
    assert (got["a"].peer_mean, got["a"].peer_max, got["a"].peer_weak_ratio, got["a"].peer_same_kind_ratio) == (near(0.4), near(0.5), 0.5, 0.5)
    assert got["b"].peer_max == near(0.3) and got["c"].peer_same_kind_ratio is None
    assert (got["d"].peer_missing, got["d"].peer_mean, got["d"].peer_same_kind_ratio) == (1, None, 0.0)
    assert (got["f"].peer_values_missing, got["f"].peer_mean, got["e"].peer_mean) == (1, None, near(0.8))
    assert got["g"].peer_max == near(0.7)


def test_reference_resolution_and_gates(spark):
    cat = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c"), (2, "c")], "program long, item string")
    rows = spark.createDataFrame([(1, "a"), (9, "a"), (9, "c"), (9, "z"), (1, "b")], "program long, item string")
    got = {(r.program, r["item"]): (r.match_type, r.resolved_program) for r in joins.resolve_reference(rows, cat, "item", "program").collect()}
    assert got == {(1, "a"): ("exact", 1), (9, "a"): ("fallback", 1), (9, "c"): ("ambiguous", None), (9, "z"): ("absent", None), (1, "b"): ("fallback", 2)}
    with pytest.raises(expect.ExpectationError):
        joins.require_covered(rows, cat, ["program", "item"])
    with pytest.raises(expect.ExpectationError):
        joins.many_to_one(rows, cat.unionByName(cat), ["item"], checked=True)
    with pytest.raises(expect.ExpectationError):
        expect.expect(rows, expect.in_domain("item", ["a"]))
    with pytest.raises(ValueError):
        expect.forbid_columns(rows, ["item"])
    expect.require_same_keys(rows, rows, ["item"])
    trusted = spark.createDataFrame([(1, None)], "program long, item string")
    assert {r["item"] for r in joins.override(rows.where("program = 1"), trusted, "program", ["item"]).collect()} == {None}


def test_as_of_is_strictly_before(spark):
    h = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 2, 1)], "k string, t long, v long")
    q = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 3)], "k string, t long")
    assert {(r.k, r.t): r.v for r in joins.as_of(q, h, ["k"], "t", ["v"]).collect()} == {("a", 1): None, ("a", 2): 5, ("a", 3): 13, ("b", 3): None}


def test_grade_scale_edges(spark):
    marks = spark.createDataFrame([(m,) for m in (-5, 0, 49, 50, 54, 55, 97, 98, 100, 130, None)], "mark int")
    got = [(r.mark, r.points) for r in joins.range_lookup(marks, "mark", binding.grade_scale(spark), "low", {"points": "points"}, (0, 100)).collect()]
    assert dict(got) == {-5: 0, 0: 0, 49: 0, 50: 150, 54: 150, 55: 175, 97: 375, 98: 400, 100: 400, 130: 400, None: None}


def test_cleaning(spark):
    rows = [(" 123.0 ", "15.111"), ("nan", "7"), ("-4.00", "x.2"), (None, ""), ("1.5", "1.111")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(clean.clean_id(F.col("a")).alias("i"), clean.id_suffix(F.col("b")).alias("s"), clean.sentinel_key(F.col("b")).alias("k"), clean.strict_int(F.col("a")).alias("n"), clean.not_integral(F.col("a")).alias("bad")).collect()
    assert [r.i for r in got] == ["123", None, "-4", None, "1.5"]
    assert [r.s for r in got] == ["111", None, "2", None, "111"]
    assert got[3].k == clean.MISSING_KEY and [r.n for r in got] == [123, None, -4, None, None]
    assert [r.bad for r in got] == [False, True, False, None, True] or [bool(r.bad) for r in got] == [False, True, False, False, True]
    level = df.limit(1).select(clean.level_ordinal(F.lit("المستوى ٣")).alias("a"), clean.level_ordinal(F.lit("First"), {"first": 1}).alias("b"), clean.level_ordinal(F.lit("?"), numeric=F.lit(7)).alias("c")).first()
    assert (level.a, level.b, level.c) == (3, 1, 7)
    assert clean.normalize_names(spark.createDataFrame([(1, 2)], "` A-b ` int, `C d` int")).columns == ["a_b", "c_d"]
    names = spark.createDataFrame([("  Intro-To  Math 2 ",), ("المحاسبة ١",)], "n string").select(text.strict_name(F.col("n")).alias("s"), text.bare_name(F.col("n")).alias("b"), text.family_name(F.col("n")).alias("f")).collect()
    assert names[0].s == "intro to math 2" and names[0].f == "intro to math#2" and names[1].b == "محاسبه 1"
    sim = spark.createDataFrame([("abcd", "bcde"), ("x y", "y x")], "a string, b string").select(text.sequence_ratio(F.col("a"), F.col("b")).alias("r"), text.token_jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert sim[0].r == 0.75 and sim[1].j == 1.0


def test_cascade_keeps_what_it_rejects(spark):
    df = spark.createDataFrame([(1, "A", "R", "P", "x", 3, 90), (2, "I", "W", "P", "x", 3, 90), (3, "A", "W", "P", "x", 3, 90), (4, "A", "Q", "P", "x", 3, 90), (5, "A", "E", "Z", "x", 3, 90), (6, "A", "E", "F", None, 3, 90), (7, "A", "E", "F", "x", 0, 90), (8, "A", "E", "F", "x", 1, 101)], "id int, active string, register_status string, finish_status string, key string, credits int, mark int")
    ok, bad = pipelines.clean_enrolment(df, ["key"])
    assert [r.id for r in ok.collect()] == [1]
    assert {r.id: r.reject_reason for r in bad.collect()} == {2: "inactive", 3: "withdrawn", 4: "register_status", 5: "finish_status", 6: "missing", 7: "credits", 8: "mark"}
    assert cascade.rejected(cascade.cascade(df, cascade.enrolment_rules(critical=["key"])), "credits").count() == 1


def test_metrics(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), round(rng.random(), 1), rng.randint(0, 1)) for _ in range(120)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r.g: r for r in metrics.ranking(df, "s", "y", ["g"]).collect()}
    for g in "ab":
        pos, neg = [s for k, s, y in rows if k == g and y], [s for k, s, y in rows if k == g and not y]
        assert got[g].auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    assert metrics.ranking(df, "s", "y").first().auc is not None
    sweep = metrics.threshold_sweep(df, "s", "y", [0.3, 0.6])
    assert [r.tp for r in sweep.orderBy("threshold").collect()] == [sum(s < t and not y for _, s, y in rows) for t in (0.3, 0.6)]
    assert metrics.best_threshold(sweep, "recall_fail", F.lit(True)).first().threshold == 0.6
    rho = buckets.spearman(spark.createDataFrame([(1, 2), (2, 1), (3, 3), (3, 4)], "a int, b int"), "a", "b").first()[0]
    assert rho == pytest.approx(3.5 / 22.5**0.5)


def test_nearest_equals_brute_force_with_ties(spark):
    rng = random.Random(9)
    pts = [(rng.randint(1, 3), e, rng.randint(1, 4), rng.choice([1.0, 1.5, 2.0, 2.25, 3.0])) for e in range(80)]
    points = spark.createDataFrame(pts, "route long, entity long, period long, v double")
    q = points.withColumn("query", F.col("entity"))
    got = defaultdict(list)
    for r in neighbors.nearest_1d(q, points, ["route"], "v", "query", "entity", "period", 6).orderBy("rank").collect():
        got[r.query].append(r.neighbor_entity)
    for route, e, _, v in pts:
        want = sorted((abs(w - v), p, f) for r, f, p, w in pts if r == route and f != e)[:6]
        assert got[e] == [f for *_, f in want]


def test_plans(spark):
    items, credits = [f"c{i}" for i in range(6)], {f"c{i}": 6.0 for i in range(6)}
    plans = planning.enumerate_plans(items, credits, 1000)
    assert len(plans) == 6 + 15 + 20 + 15 and plans == planning.enumerate_plans(items, credits, 1000)
    many = [f"c{i}" for i in range(30)]
    some = planning.enumerate_plans(many, dict.fromkeys(many, 4.0), 50)
    assert len(some) == 50 and len({frozenset(p) for p in some}) == 50 and all(len(p) <= 6 for p in some)
    df = spark.createDataFrame([(1, 0, 4.0, 0.5, 3), (1, 0, 2.0, 1.0, None)], "entity long, plan_id int, pts double, p double, c int")
    r = planning.score_plans(df, ["entity", "plan_id"], "pts", "p", "c", F.lit(12.0), F.lit(0.0)).first()
    assert (r.expected_points, r.risk, r.workload, r.progress) == (3.0, pytest.approx(1 - 0.45 - 0.2), 0.24, 0.5)
    assert r.composite == pytest.approx(0.3 - 0.3 * 0.35 + 0.2 * 0.88 + 0.05)


def test_matching(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (60, 60)], "a long, b long")
    assert dict(matching.components(edges, "a", "b").collect()) == {i: 0 for i in range(31)} | {50: 50, 51: 50, 60: 60}
    sets = spark.createDataFrame([(["1.a"], ["1.a"]), (["1.a", "2.a"], ["2.a", "1.a"]), (["1.a"], ["1.a", "3.b"]), (["1.a"], ["2.a"]), (["1.a"], ["2.b"]), (None, ["1.a"])], "x array<string>, y array<string>")
    assert [r[0] for r in sets.select(matching.set_relation(F.col("x"), F.col("y"))).collect()] == ["SAME_SINGLE", "SAME_MULTIPLE", "PARTIAL_OVERLAP", "SAME_UNIVERSITY_DIFFERENT", "DIFFERENT_UNIVERSITY", "MISSING"]
    cand = spark.createDataFrame([("n", "o1", 0.9), ("n", "o2", 0.2), ("m", "o1", 0.9), ("m", "o2", 0.8)], "new string, old string, score double")
    assert {r.new: r.bucket for r in matching.classify_candidates(cand, "new", "score", 0.8, 0.5).collect()} == {"n": "confirmed", "m": "probable"}


def test_profiles_and_buckets(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "code string")
    top = buckets.fit_top(df, "code", 2)
    assert {r.code for r in top.collect()} == {"a", "b"}
    new = spark.createDataFrame([("a",), ("c",), ("z",), (None,)], "code string")
    assert sorted(str(r.bucket) for r in buckets.apply_top(new, top, df, "code", "bucket").collect()) == ["a", "missing", "missing", "other"]
    assert buckets.label_collisions(top, "code", ["b"]).count() == 1
    assert profile.lineage({"x": df, "y": new}, "code", "a").collect()[0].n == 2
    sig = profile.id_signature(spark.createDataFrame([("1",), ("1.0",), ("1.5",), ("",), ("q",), (None,)], "i string"), ["i"]).first()
    assert (sig.digits, sig.decimal_zero, sig.dotted, sig.blank, sig.other, sig.nulls) == (1, 1, 1, 1, 1, 1)


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    path = str(tmp_path / "t")
    tables.write_table(df, path, {"who": "test"})
    tables.verify_written(spark, path, df)
    assert tables.read_metadata(spark, path) == {"who": "test"}
    with pytest.raises(FileExistsError):
        tables.write_table(df, path)
    with pytest.raises(expect.ExpectationError):
        tables.verify_written(spark, path, df.withColumn("v", F.lit("z")))
    got = tables.read_table(spark, path, ["id"], ("id", [2]))
    assert [r.id for r in got.collect()] == [2]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*\bid\b", plan) and "ReadSchema: struct<id:bigint>" in plan
    tables.write_csv(df.where("id = 1"), str(tmp_path / "c.csv"))
    assert [(r.id, r.v) for r in tables.read_table(spark, str(tmp_path / "c.csv")).collect()] in ([("1", "a")], [(1, "a")])
    board = str(tmp_path / "board")
    for _ in range(2):
        tables.append_rows(df, board)
    assert spark.read.parquet(board).count() == 4
    with pytest.raises(expect.ExpectationError):
        tables.append_rows(df.withColumn("more", F.lit(1)), board)
    assert tables.params_digest({"a": 1, "b": 2}) == tables.params_digest({"b": 2, "a": 1}) != tables.params_digest({"a": 2})
    with pytest.raises(FileNotFoundError):
        tables.require_inputs(spark, str(tmp_path / "none"))
    wide = tables.add_columns(df, spark.createDataFrame([(1, "n", 5)], "id long, v string, w int"), ["id"])
    assert {tuple(r) for r in wide.collect()} == {(1, "n", 5), (2, None, None)}
    with pytest.raises(ValueError):
        tables.table_path("/r", "raw", "../x")
    assert tables.extraction_query("v", ["a", "b"], {"s": "it's"}, "a") == "SELECT a, b FROM v WHERE s = 'it''s' ORDER BY a"
    assert tables.file_digests(spark, path).count() >= 1


def test_pipelines(spark, tiny, tmp_path):
    rows = binding.attempted(spark, tiny)
    f = pipelines.engineer(binding.enrolment(spark, tiny), binding.terms(spark, tiny))
    assert f.primary.count() + f.excluded.count() == f.audit.count() == rows.count()
    out = pipelines.rebuild(spark, rows, str(tmp_path), train_to=20003, valid=(20004, 20012), test=(20013,))
    assert sum(d.count() for d in out.values()) == rows.count()
    courses, periods = pipelines.neighbor_history(rows)
    assert courses.count() == rows.count() and periods.count() == binding.terms(spark, tiny).count()


def test_streams_equal_batches(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = running.read_stream(spark, str(tmp_path / "in"), events.schema, 1)
    got = running.run_available(running.running_statistics(stream, ["event_type"], "value", 10), "stats", str(tmp_path / "c"))
    assert {tuple(r)[:2] + tuple(r)[3:] for r in got.collect()} == {tuple(r)[:2] + tuple(r)[3:] for r in running.running_statistics(events, ["event_type"], "value", 10).collect()}
    n = running.run_available(running.windowed_counts(stream, "ts", "1 day", "60 days"), "counts", str(tmp_path / "d"))
    assert n.agg(F.sum("n")).first()[0] == events.count()


def test_timeline_chain_sorts_once(spark, tiny):
    t = spark.createDataFrame([(1, 1, 1, 2.0, 0)], "entity long, program long, period long, gpa double, is_interruption int")
    plan = timeline.add_history(t, ["entity", "program"], "period")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "Python" not in plan


def test_no_products_or_python_where_not_meant(spark, tiny):
    from lodestone import queries

    for name in ("gpa_trend", "difficulty_temporal", "peer_loo", "roster", "two_tier_resolution"):
        plan = queries.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan, name
