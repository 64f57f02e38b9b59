"""Questionnaires, report history, scores, recourse, runtime rows."""

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from dayloom.functions.target_specs import COMPACT_TARGETS, TargetSpec, check_specs
from dayloom.operators import allocations as al
from dayloom.operators import constraints as cs
from dayloom.operators import recourse as rc
from dayloom.operators import scoring as sc
from dayloom.operators.history import self_report_history
from dayloom.operators.parse import EventTables
from dayloom.operators.questionnaires import composite_targets, validate_answers
from dayloom.plans import runtime as rt
from dayloom.functions.history_columns import HISTORY_COLUMNS, RUNTIME_COLUMNS, SETS, columns_of_set
from dayloom.vocab import (
    ACTION_COLUMNS,
    ACTION_NAMES,
    ANSWER_RANGES,
    TARGETS,
)
from tests.helpers import REQUEST, at, golden


def test_targets_and_answer_ranges(spark):
    rows = [(-3.0, 0.0, 6.0, 0.0, 0.0, 6.0, 0.0), (3.0, 6.0, 0.0, 6.0, 6.0, 0.0, 6.0), (0.0, 1.0, 2.0, None, 4.0, 5.0, 6.0), (4.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in ANSWER_RANGES)).coalesce(1)
    got = composite_targets(table).select(TARGETS).collect()
    assert list(got[0]) == [0.0] * 7 and list(got[1]) == [6.0] * 7
    assert got[2]["engagement"] is None and got[2]["overall_wellbeing"] is None and got[2]["restfulness"] == 4.0
    assert [r["answer_problem"] for r in validate_answers(table).collect()] == [None, None, None, "q1_feelings"]


def test_report_history_against_plain_python(spark):
    start = dt.datetime(2026, 1, 5, 8)
    times = [start + dt.timedelta(hours=h) for h in (0, 1, 5, 30, 31, 200, 900)]
    values = [2.0, 2.0, None, 4.0, 1.0, 3.0, 5.0]
    sources = ["streamdeck", "streamdeck", "streamdeck", "other", "streamdeck", "streamdeck", "prediction"]
    rows = [(u, t, s, *([v] * 7)) for u in ("a", "b") for t, v, s in zip(times, values, sources)]
    schema = "user_id string, timestamp timestamp_ntz, answer_source string, " + ", ".join(f"{t} double" for t in TARGETS)
    out = self_report_history(spark.createDataFrame(rows, schema)).orderBy("user_id", "timestamp").collect()
    assert len(out) == 14
    for i, row in enumerate(out[:7]):
        past = [(t, v) for t, v, s in list(zip(times, values, sources))[:i] if s == "streamdeck" and v is not None]
        get = lambda stat: row[f"history__arousal__{stat}"]
        assert get("log_count") == pytest.approx(math.log1p(len(past)))
        if not past:
            assert get("last") is None and get("mean") is None and get("log_gap_hours") is None and get("std") == 0.0
            continue
        v = [x for _, x in past]
        assert get("last") == v[-1] and get("mean") == pytest.approx(statistics.fmean(v))
        assert get("mean_3") == pytest.approx(statistics.fmean(v[-3:]))
        assert get("std") == pytest.approx(statistics.pstdev(v), abs=1e-12)
        assert get("log_gap_hours") == pytest.approx(math.log1p((times[i] - past[-1][0]).total_seconds() / 3600))
    assert out[2]["history__mood_valence__std"] == 0.0  # a constant history
    assert out[0]["history__dow_cos"] == pytest.approx(1.0)  # a Monday


def test_feature_sets_have_contract_sizes():
    sizes = {n: len(columns_of_set(n, "arousal")) for n in SETS}
    assert sizes == {"history_core_aw25": 36, "history_vector_aw25": 54, "history_core_direct16": 27}
    assert len(RUNTIME_COLUMNS) == 93 and len(HISTORY_COLUMNS) == 53
    check_specs(COMPACT_TARGETS)
    assert [len(s.features) for s in COMPACT_TARGETS] == [33, 18, 20, 18, 33, 24, 16]


def _allocation(spark, **minutes):
    table = spark.range(1).select(F.lit("u").alias("user_id"), *[F.lit(float(minutes.get(n, 0))).alias(c) for c, n in zip(ACTION_COLUMNS, ACTION_NAMES)])
    return table


def test_swaps_keep_the_total_in_canonical_order(spark):
    rows = al.swap_scenarios(_allocation(spark, development=10, media=4)).orderBy("swap_no").collect()
    assert len(rows) == 6 and [r["receiver"] for r in rows] == ACTION_COLUMNS[1:]
    assert all(sum(r[c] for c in ACTION_COLUMNS) == 14.0 and r["donor"] == ACTION_COLUMNS[0] for r in rows)


def test_allocation_problems(spark):
    bad = _allocation(spark, media=-1).unionByName(_allocation(spark, media=61)).unionByName(_allocation(spark, media=60)).coalesce(1)
    assert [r[0] for r in bad.select(al.allocation_problem()).collect()] == ["negative", "exceeds the window", None]


def test_constraints(spark):
    base = spark.range(1).select(F.lit("a").alias("id"), F.lit(20.0).alias("time_media"), F.lit(30.0).alias("time_writing"), F.lit(8.0).alias("sleep_hours"))
    ok = lambda t, **d: t.select(cs.time_budget_ok(t, {f"time_{k}": F.lit(float(v)) for k, v in d.items()})).collect()[0][0]
    assert ok(base, media=-5, writing=5) and not ok(base, media=-5, writing=6) and not ok(base, media=-25, writing=25)
    assert not ok(base.withColumn("minutes_afk", F.lit(15.0)), media=-5, writing=5)
    check = lambda m: cs.validate_counterfactual(base, m, ["id"]).collect()[0]["violation"]
    assert check(base) is None
    assert check(base.withColumn("sleep_hours", F.lit(7.0))) == "immutable feature modified: sleep_hours"
    assert check(base.withColumn("time_media", F.lit(25.0))) == "not zero-sum"


WEIGHTS = {"action_minutes_development": 0.015}


def test_recourse_greatly_improves(spark):
    table = _allocation(spark, personal_distraction=30)
    scorer = lambda c: F.least(F.greatest(sc.linear_scorer(WEIGHTS, 0.2)(c), F.lit(0.0)), F.lit(1.0))
    row = rc.recommend_changes(sc.add_score(table, scorer, "p"), "p", scorer, ACTION_COLUMNS, keep=["user_id"]).collect()[0]
    assert row["strength"] == "Greatly improve"
    assert row["projected_probability_high"] == pytest.approx(0.5)
    assert [(c["category"], c["delta_minutes"]) for c in row["changes"]] == [("development", 20.0), ("personal_distraction", -20.0)]


@pytest.mark.parametrize(("minutes", "start", "strength"), [(10, 0.2, "Improve slightly"), (4, 0.2, "Keep"), (30, 0.6, "Keep")])
def test_recourse_strengths(spark, minutes, start, strength):
    table = _allocation(spark, personal_distraction=minutes)
    scorer = sc.linear_scorer(WEIGHTS, start)
    row = rc.recommend_changes(sc.add_score(table, scorer, "p"), "p", scorer, ACTION_COLUMNS, keep=["user_id"]).collect()[0]
    assert row["strength"] == strength and bool(row["changes"]) == (strength != "Keep")


def test_model_and_column_search_agree(spark):
    weights = {c: w for c, w in zip(ACTION_COLUMNS, (0.011, 0.007, 0.009, -0.003, -0.006, -0.012, -0.001))}
    column = sc.linear_scorer(weights, 0.3)
    table = spark.range(6).select(
        "id", *[F.expr(f"(id * {i + 3} % 5) * 2.5D").alias(c) for i, c in enumerate(ACTION_COLUMNS)]
    )
    table = sc.add_score(table, column, "p", ACTION_COLUMNS)
    by_table = lambda t, name: t.withColumn(name, column({c: F.col(c) for c in ACTION_COLUMNS}))
    one = rc.recommend_changes(table, "p", column, ACTION_COLUMNS, keep=["id"]).orderBy("id").collect()
    two = rc.recommend_changes_model(table, "p", by_table, "id", keep=["id"]).orderBy("id").collect()
    assert one == two


def test_fitted_models_score_and_search(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = spark.range(60).select("id", *[F.expr(f"(id * {i + 2} % 7) * 1D").alias(c) for i, c in enumerate(ACTION_COLUMNS)])
    data = data.withColumn("label", (F.col(ACTION_COLUMNS[0]) > 2).cast("double"))
    ready = VectorAssembler(inputCols=ACTION_COLUMNS, outputCol="features").transform(data)
    model = LogisticRegression(maxIter=5, regParam=0.1).fit(ready)
    scorer = sc.ml_scorer(model, ACTION_COLUMNS, "probability")
    scored = sc.probability_high(data.drop("label"), scorer, "p")
    out = rc.recommend_changes_model(scored, "p", scorer, "id", max_steps=3, keep=["id"]).collect()
    assert len(out) == 60 and all(r["projected_probability_high"] >= r["baseline_probability_high"] for r in out)
    assert any(r["strength"] != "Keep" for r in out)


def test_desired_score_search(spark):
    raw = sc.linear_scorer({"time_development": 0.1, "time_personal_distraction": -0.05}, 1.0)
    scorer = lambda c: F.least(F.greatest(raw(c), F.lit(0.0)), F.lit(6.0))

    def run(dev, dis, goal):
        table = spark.range(1).select(F.lit("u1").alias("user_id"), F.lit(float(dev)).alias("time_development"), F.lit(float(dis)).alias("time_personal_distraction"), F.lit(goal).alias("goal"))
        table = sc.add_score(table, scorer, "s", ["time_development", "time_personal_distraction"])
        return rc.reach_desired_score(table, "s", "goal", scorer, features=[], keep=["user_id"]).collect()[0]

    up = run(5, 25, 3.0)
    assert up["success"] and up["projected_score"] == 3.25
    assert [(s["category"], s["delta_minutes"]) for s in up["shifts"]] == [("time_personal_distraction", -20.0), ("time_development", 20.0)]
    none = run(0, 0, 3.0)
    assert not none["success"] and none["shifts"] == []
    down = run(20, 5, 2.0)
    assert down["success"] and down["projected_score"] <= 2.0
    same = run(5, 25, 0.25)
    assert same["success"] and same["shifts"] == []


def test_score_frames_and_blending(spark):
    table = spark.createDataFrame([(2.0, 4.0), (None, 4.0)], "history__arousal__mean double, x double").coalesce(1)
    scorer = lambda c: c["x"]
    got = lambda frame, gamma: [
        r["arousal"] for r in sc.score_target(table, TargetSpec("arousal", "m", frame, gamma, ("x",)), scorer).collect()
    ]
    assert got("absolute", 1.0) == [4.0, 4.0]
    assert got("absolute", 0.75) == [3.5, 3.75]
    assert got("personal_residual", 1.0) == [6.0, 6.0]
    with pytest.raises(ValueError):
        TargetSpec("arousal", "m", "other", 1.0, ("x",))


def test_per_user_statistics_fall_back(spark):
    table = spark.createDataFrame([("known", at("09:00"), 4.0), ("new", at("09:00"), 4.0)], "user_id string, timestamp timestamp_ntz, x double")
    stats = spark.createDataFrame([("known", 2.0, 2.0)], "user_id string, mean_x double, std_x double")
    out = {r["user_id"]: r["x"] for r in sc.per_user_standardize(table, ["x"], stats, {"x": 0.0}, {"x": 4.0}).collect()}
    assert out == {"known": 1.0, "new": 1.0}


def test_lookups_copy_rows_of_hot_keys_alone(spark):
    # a third of the rows has one key, a tenth has none; user 7 is not in the lookup
    key = F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 10 = 1 THEN NULL ELSE concat('u', id % 50) END")
    table = spark.range(6000).select(key.alias("user_id"), F.col("id").alias("at"), (F.col("id") * 2).alias("x"))
    lookup = spark.createDataFrame([("hot", 1.0)] + [(f"u{i}", float(i)) for i in range(50) if i != 7], "user_id string, v double")
    hot = sc.hot_keys(table, "user_id", rows=300)
    assert [tuple(r) for r in hot.collect()] == [("hot", 7)]
    assert sc._copied(lookup, hot, "user_id").count() == lookup.count() + 6
    out = sc.salted_lookup(table, lookup, "user_id", ["at"], hot_rows=300)
    plain = table.join(lookup, "user_id", "left")
    assert out.columns == plain.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
    # the bound on hot keys holds however low the threshold is, and without rows there are none
    assert sc.hot_keys(spark.range(5000).select((F.col("id") % 2500).alias("k")), "k", rows=1).count() < sc.MOST_HOT
    assert sc.hot_keys(table.filter("false"), "user_id").count() == 0
    assert sc.salted_lookup(table.filter("false"), lookup, "user_id", ["at"]).count() == 0


def test_runtime_rows_equal_one_request_at_a_time(spark):
    window, web, inputs, _ = golden(spark)
    times = [at("08:20"), at("09:00"), at("09:40"), at("10:00"), at("12:00")]
    requests = spark.createDataFrame([("user1", t) for t in times], REQUEST)
    asked = spark.createDataFrame([("user1", at("08:10")), ("user1", at("09:35"))], REQUEST)
    schema = "user_id string, timestamp timestamp_ntz, " + ", ".join(f"{t} double" for t in TARGETS)
    reports = spark.createDataFrame([("user1", at("08:05"), *([3.0] * 7)), ("user1", at("09:40"), *([5.0] * 7))], schema)
    events = EventTables(window, web, inputs)
    bulk = rt.runtime_features(events, requests, asked, reports)
    assert bulk.features.columns == RUNTIME_COLUMNS
    got = {r["timestamp"]: r for r in bulk.features.collect()}
    assert set(got) == set(times[:4])
    (rejected,) = bulk.rejected.collect()
    assert rejected["timestamp"] == at("12:00") and "no window or web activity" in rejected["reason"]
    one = rt.runtime_features(events, requests.filter(F.col("timestamp") == F.lit("2026-01-01 09:40:00").cast("timestamp_ntz")), asked, reports)
    assert one.features.collect()[0] == got[at("09:40")]
    # a report at the very time of the request is not yet history
    assert got[at("09:40")]["history__arousal__last"] == 3.0 and got[at("10:00")]["history__arousal__last"] == 5.0
    assert got[at("10:00")]["action_minutes_development"] == 20.0


def test_reports_and_snapshots(spark):
    window, web, inputs, requests = golden(spark)
    rows = rt.runtime_features(EventTables(window, web, inputs), requests).features
    models = {s.target: (s, sc.linear_scorer({f: 0.01 for f in s.features}, 2.0)) for s in COMPACT_TARGETS}
    report = rt.score_requests(rows, models).orderBy("prediction_timestamp").collect()[-1]
    assert [p["target"] for p in report["predictions"]] == TARGETS and report["window_minutes"] == 60
    chance = {t: (sc.linear_scorer({"action_minutes_development": 0.004}, 0.2), ["action_minutes_development"]) for t in TARGETS}
    out = rt.recommend(rows, chance, "arousal", "v1").collect()
    assert len({r["snapshot_id"] for r in out}) == 2 and all(r["target"] == "arousal" for r in out)


def test_derived_features_are_not_derived_again_by_filters(spark):
    derived = {c: F.expr(f"sqrt(seen) + {i}") for i, c in enumerate(RUNTIME_COLUMNS[2:])}
    rows = spark.range(3).selectExpr(
        "concat('u', id) AS user_id", "timestamp_ntz'2026-01-01 09:00:00' AS timestamp", "if(id = 2, double('infinity'), double(id)) AS seen"
    ).select("user_id", "timestamp", *[v.alias(c) for c, v in derived.items()])
    models = {s.target: (s, sc.linear_scorer({f: 0.01 for f in s.features}, 2.0)) for s in COMPACT_TARGETS}
    reports = rt.score_requests(rows, models)
    unfolded = reports.select("participant_id", F.inline("predictions"))
    for table in (reports, unfolded, rt.unscorable(rows, models)):
        lines = table._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not [line for line in lines if "Filter" in line and "SQRT(" in line]
    assert {r["participant_id"] for r in reports.collect()} == {"u0", "u1"} and unfolded.count() == 14
    (bad,) = rt.unscorable(rows, models).collect()
    assert bad["user_id"] == "u2" and bad["reason"].startswith("infinite feature: ")
