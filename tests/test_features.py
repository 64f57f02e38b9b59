"""Golden vectors and brute-force comparison of the activity features."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dayloom.operators import timeline
from dayloom.operators.history import prior_requests, rolling_history
from dayloom.operators.states import assign_state, behavior_states, hourly_behavior
from dayloom.operators.window_features import context_features, window_features
from dayloom.plans.production import production_features
from dayloom.vocab import ACTIVITY_FEATURES, PRODUCTION_FEATURES
from tests.helpers import EVENT, REQUEST, at, brute, golden, random_events

ORIGIN = dt.datetime(2026, 1, 1)


def test_production_golden_vector(spark):
    table = production_features(*golden(spark))
    assert table.columns == ["user_id", "timestamp", *ACTIVITY_FEATURES]
    row = table.orderBy("timestamp").collect()[-1]
    expected = [
        0, 1, 0, 0, 0, 1, 0, 60, 0, 0.5 / 60, 15, 0, 0, -15, 2.5693934776176652, 0, 0, 0, 1, 15,
        0, 0, 1 / 3, 1 / 30, 0,
    ]
    assert [row[c] for c in PRODUCTION_FEATURES] == pytest.approx(expected, rel=1e-12, abs=1e-12)


def test_context_uses_only_time_before_the_window(spark):
    window, web, _, requests = golden(spark)
    row = context_features(window, web, requests).orderBy("timestamp").collect()[-1]
    assert row["context_7d_ratio_development"] == 1.0
    assert row["context_24h_ratio_personal_distraction"] == 0.0


def test_web_overrides_window_and_ties_follow_input_order(spark):
    window = spark.createDataFrame(
        [
            ("u", at("09:00"), at("10:00"), "A", "other", 0),
            ("u", at("09:30"), at("09:40"), "B", "media", 1),
            ("u", at("09:30"), at("09:40"), "C", "writing", 2),
        ],
        EVENT,
    )
    web = spark.createDataFrame([("u", at("09:10"), at("09:20"), None, "research", 0)], EVENT).drop("app")
    rows = timeline.segments(window, web).orderBy("start").collect()
    assert [r["category"] for r in rows] == ["other", "research", "other", "media", "other"]


def _tables(spark, events, users):
    rows = {True: [], False: []}
    for e in events:
        for u in users:
            rows[e["web"]].append(
                (u, ORIGIN + dt.timedelta(seconds=e["s"]), ORIGIN + dt.timedelta(seconds=e["e"]), e["app"], e["category"], e["seq"])
            )
    return spark.createDataFrame(rows[False], EVENT), spark.createDataFrame(rows[True], EVENT).drop("app")


@pytest.mark.parametrize(("seed", "longest"), [(1, 5), (2, 40), (3, 200)])
def test_features_equal_brute_force(spark, seed, longest):
    events = random_events(seed, 60, 600, longest)
    window, web = _tables(spark, events, ["a", "b"])
    # requests at odd seconds, exactly on the hour, and at event edges
    times = sorted({*random.Random(seed).sample(range(600, 40000), 12), 3600, 7200, 36000, events[0]["s"], events[1]["e"]})
    requests = spark.createDataFrame(
        [(u, ORIGIN + dt.timedelta(seconds=t)) for t in times for u in ("a", "b")], REQUEST
    )
    got = window_features(window, web, None, requests).collect()
    assert len(got) == 2 * len(times)
    for row in got:
        t = int((row["timestamp"] - ORIGIN).total_seconds())
        for name, value in brute(events, t).items():
            assert row[name] == pytest.approx(value, abs=1e-9), (t, name)


def test_hot_user_and_copies_keep_results_whole(spark):
    """One user with most rows, many of them copies: same answer as the distinct events."""
    events = random_events(7, 40, 120, 20)
    window, web = _tables(spark, events, ["hot"])
    copied = window.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("copy")
    requests = spark.createDataFrame([("hot", ORIGIN + dt.timedelta(minutes=m)) for m in range(30, 150, 7)], REQUEST)
    columns = ["timestamp", "total_active_minutes", "mean_focus_block_minutes", "time_media"]
    one = window_features(window, web, None, requests).select(columns).orderBy("timestamp").collect()
    many = window_features(copied, web, None, requests).select(columns).orderBy("timestamp").collect()
    assert one == many


def test_longer_windows(spark):
    events = random_events(11, 50, 600, 30)
    window, web = _tables(spark, events, ["a"])
    requests = spark.createDataFrame([("a", ORIGIN + dt.timedelta(minutes=m)) for m in (95, 180, 311)], REQUEST)
    for row in window_features(window, web, None, requests, window_minutes=90).collect():
        t = int((row["timestamp"] - ORIGIN).total_seconds())
        want = brute(events, t, 5400)
        assert row["total_active_minutes"] == pytest.approx(want["total_active_minutes"])
        assert row["short_fragment_count_2m"] == want["short_fragment_count_2m"]


def test_hour_rows_and_states(spark):
    window, web, _, requests = golden(spark)
    hourly = hourly_behavior(window, web).orderBy("hour").collect()
    # overlaps are counted twice in the hourly table
    assert [r["development"] for r in hourly] == [30.0, 25.0]
    assert hourly[1]["event_count"] == 3.0
    labels = assign_state(hourly_behavior(window, web)).orderBy("hour").collect()
    assert labels[1]["state"] == 2
    row = behavior_states(window, web, requests).orderBy("timestamp").collect()[-1]
    assert row["current60_state_share_2"] == 1.0
    assert row["prior24h_state_active_hours"] == 1.0


def test_crossing_event_adds_a_second_row_for_its_earlier_hour(spark):
    window = spark.createDataFrame(
        [("u", at("09:50"), at("10:20"), "A", "media", 0), ("u", at("09:05"), at("09:40"), "B", "development", 1)], EVENT
    )
    request = spark.createDataFrame([("u", at("10:30"))], REQUEST)
    row = behavior_states(window, None, request).collect()[0]
    # 09:00 in full, 09:00 again from the crossing event, and the running 10:00
    assert row["current60_state_active_hours"] == 3.0


def test_rolling_uses_prior_rows_only(spark):
    table = spark.createDataFrame(
        [("u", at("10:00"), 10.0, 1.0), ("u", at("11:00"), 20.0, 2.0), ("u", at("12:30"), 40.0, 4.0),
         ("u", dt.datetime(2026, 1, 9, 12), None, float("inf")), ("u", dt.datetime(2026, 2, 9, 12), 5.0, 5.0)],
        "user_id string, timestamp timestamp_ntz, input_load double, switch_rate double",
    )
    rows = rolling_history(table, ["input_load", "switch_rate"]).orderBy("timestamp").collect()
    assert [r["minutes_since_prev1_window"] for r in rows[:3]] == [0.0, 60.0, 90.0]
    assert [r["rolling_mean_3_input_load"] for r in rows] == [0.0, 10.0, 15.0, 70 / 3, 30.0]
    assert rows[2]["current_minus_rolling_mean_3_switch_rate"] == 2.5
    assert rows[3]["current_minus_rolling_mean_3_switch_rate"] == pytest.approx(-7 / 3)
    assert rows[4]["rolling_mean_3_switch_rate"] == 3.0


def test_prior_requests_cross_days_and_are_strict(spark):
    days = [dt.datetime(2026, 1, d, 12) for d in (1, 2, 9, 9, 20)]
    prior = spark.createDataFrame([("u", d) for d in days], REQUEST)
    asked = spark.createDataFrame([("u", days[2]), ("u", dt.datetime(2026, 3, 1)), ("v", days[0])], REQUEST)
    rows = {(r["user_id"], r["timestamp"]): r["prior_times"] for r in prior_requests(asked, prior).collect()}
    assert rows["u", days[2]] == days[:2]
    assert rows["u", dt.datetime(2026, 3, 1)] == [days[1], days[2], days[4]]
    assert rows["v", days[0]] == []


def test_sweep_of_a_dense_bin_is_linear():
    import time

    import numpy as np
    import pandas as pd

    from dayloom.operators.timeline import _sweep

    n, hour = 200_000, 3_600_000_000
    rng = np.random.default_rng(1)
    start = np.sort(rng.integers(0, hour, n))
    rows = pd.DataFrame(
        {
            "user_id": "u", "bin": 0, "p_start": start, "p_end": np.minimum(start + rng.integers(1, hour // 6, n), hour),
            "s_us": start, "seq": np.arange(n), "priority": rng.integers(0, 2, n), "category": rng.choice(list("abcd"), n),
        }
    )
    began = time.process_time()
    out = _sweep("category")(rows)
    assert time.process_time() - began < 10  # a slice written once per event would take minutes
    assert (out["start_us"].to_numpy()[1:] >= out["end_us"].to_numpy()[:-1]).all()


def test_hours_are_derived_in_generated_code(spark):
    window, web, _, _ = golden(spark)
    plan = hourly_behavior(window, web)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_look_back_reaches_exactly_seven_days_over_day_edges(spark):
    schema = "user_id string, timestamp timestamp_ntz, event_end timestamp_ntz, source_type string, app string, category string"
    asked = dt.datetime(2026, 1, 9, 1)
    hours = [1, 2, 24, 25, 26, 168, 169, 170]
    begins = [asked - dt.timedelta(hours=h) for h in hours]
    window = spark.createDataFrame([("u", b, b + dt.timedelta(minutes=9), "window", "Code", "development") for b in begins], schema)
    (row,) = behavior_states(window, None, spark.createDataFrame([("u", asked)], "user_id string, timestamp timestamp_ntz")).collect()
    got = [row[f"{p}_state_active_hours"] for p in ("current60", "prior24h", "prior7d")]
    # the window begins at the hour 1 before: its 24 hours are 2 to 25 before, its seven days 2 to 169
    assert got == [1.0, 3.0, 6.0]
