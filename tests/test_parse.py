"""Raw buckets to event tables, categories, domains, table checks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from dayloom.functions.categories import Rule, categorize_web, categorize_window
from dayloom.functions.text import category_slug, normalize_domain, normalize_text
from dayloom.operators import contract
from dayloom.operators.parse import malformed_events, parse_events
from dayloom.sources.buckets import bucket_types, read_buckets, read_raw_events
from dayloom.sources.configs import load_rules, load_state_model
from dayloom.sources.sinks import write_features
from dayloom.vocab import INPUT_COLUMNS, WEB_COLUMNS, WINDOW_COLUMNS
from tests.helpers import EVENT, at


def _export(tmp_path, buckets, user=" p1 "):
    path = tmp_path / "export.json"
    path.write_text(json.dumps({"user_id": user, "buckets": buckets}) + "\n")
    return str(path)


def _event(timestamp, duration, **data):
    return {"timestamp": timestamp, "duration": duration, "data": data}


def test_three_streams(spark, tmp_path):
    buckets = {
        "w": {"type": "currentwindow", "hostname": "mac",
              "events": [_event("2026-01-01T09:00:00Z", 60, app="Code", title="main.py")]},
        "b": {"type": "web.tab.current", "data": {"hostname": "meta"},
              "events": [_event("2026-01-01T09:01:00Z", 30, url="https://github.com/x", title="GitHub", audible=False, tabCount=2)]},
        "i": {"type": "os.hid.input",
              "events": [_event("2026-01-01T09:02:00Z", 5, presses=3, clicks=True, deltaX=3, deltaY=4, scrollX=0, scrollY=-2)]},
        "a": {"type": "afkstatus", "events": [_event("2026-01-01T09:02:00Z", 5)]},
    }
    path = _export(tmp_path, buckets)
    events = parse_events(read_buckets(spark, path))
    assert events.window.columns == [*WINDOW_COLUMNS, "seq"]
    assert events.web.columns == [*WEB_COLUMNS, "seq"]
    assert events.input.columns == [*INPUT_COLUMNS, "seq"]
    (window,), (web,), (inputs,) = (t.collect() for t in events)
    assert (window["user_id"], window["category"], window["hostname"]) == ("p1", "development", "mac")
    assert window["timestamp"] == dt.datetime(2026, 1, 1, 10) and window["date"] == "2026-01-01"
    assert (web["domain"], web["tab_count"], web["audible"], web["hostname"]) == ("github.com", 2, False, "meta")
    assert (inputs["mouse_distance"], inputs["scroll_abs"], inputs["presses"], inputs["clicks"]) == (5.0, 2.0, 3.0, 0.0)
    assert inputs["hostname"] == "unknown"
    types = {r["type"] for r in bucket_types(spark.read.schema("user_id string, buckets map<string,struct<type:string>>").json(path)).collect()}
    assert "afkstatus" in types


def test_longest_heartbeat_and_filters(spark, tmp_path):
    same = {"timestamp": "2026-01-01T09:00:00Z", "data": {"app": "Finder", "title": "Downloads"}}
    buckets = {
        "w": {"type": "currentwindow", "events": [
            {**same, "duration": 25}, {**same, "duration": 173}, {**same, "duration": 49},
            _event("2026-01-01T09:00:00Z", 0, app="Code"),
            _event("2026-01-01T09:01:00Z", 10, app="LoginWindow"),
            _event("", 10, app="Code"), _event("2026-01-01T09:01:00Z", 43200, app="Code"),
            _event("2026-01-01T09:03:00Z", 5, app="", title="1"), _event("2026-01-01T09:03:00Z", 7, app="", title=1),
        ]},
    }
    rows = parse_events(read_buckets(spark, _export(tmp_path, buckets))).window.orderBy("seq").collect()
    # the number 1 and the text "1" are different data
    assert [(r["app"], r["duration_seconds"]) for r in rows] == [("Finder", 173.0), ("unknown", 5.0), ("unknown", 7.0)]


def test_event_lines_and_malformed(spark, tmp_path):
    lines = [
        {"user_id": "u", "bucket": "w", "type": "currentwindow", "seq": 1, "timestamp": "2026-07-01T12:00:00+00:00", "duration": "9", "data": {"app": "x"}},
        {"user_id": "u", "bucket": "w", "type": "currentwindow", "seq": 2, "timestamp": "not a time", "duration": "9", "data": {"app": "x"}},
        {"user_id": " ", "bucket": "w", "type": "currentwindow", "seq": 3, "timestamp": "2026-07-01T12:00:00", "duration": "9", "data": {"app": "x"}},
        {"user_id": "u", "bucket": "w", "type": "currentwindow", "seq": 4, "timestamp": "2026-07-01T12:00:00", "duration": "9", "data": [1]},
    ]
    path = tmp_path / "events.json"
    path.write_text("\n".join(map(json.dumps, lines)))
    raw = read_raw_events(spark, str(path))
    assert [r["timestamp"] for r in parse_events(raw).window.collect()] == [dt.datetime(2026, 7, 1, 14)]
    problems = {r["seq"]: r["problem"] for r in malformed_events(raw).collect()}
    assert problems == {2: "invalid timestamp", 3: "blank user_id", 4: "data is not an object"}


@pytest.mark.parametrize(("url", "domain"), [
    ("https://www.example.com/path", "example.com"), ("docs.example.com/path", "docs.example.com"),
    ("about:blank", "about"), ("chrome://newtab", "chrome"), ("localhost:5600/dashboard", "localhost"),
    ("https://example.com:not-a-port", "example.com"), ("https://[broken", ""), ("http://user:pw@[::1]:80/x", "::1"),
    ("example.com/?u=http://other.org", ""), ("", ""), (None, ""), ("HTTPS://WWW.Ex.ORG./", "ex.org"),
])
def test_domains(spark, url, domain):
    row = spark.createDataFrame([(url,)], "u string").select(normalize_domain(F.col("u")).alias("d")).collect()
    assert row[0]["d"] == domain


def test_text_and_slug(spark):
    text = "‎ a  b\x1f\tc ﻿"
    row = spark.createDataFrame([(text,)], "t string").select(normalize_text(F.col("t")).alias("t")).collect()
    assert row[0]["t"] == "a b c"
    assert category_slug(["Work", "Research & reading"]) == "work_research_and_reading"


def test_rules_are_a_parameter_and_the_deepest_wins(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"categories": [
        {"name": ["Media"], "rule": {"type": "none"}},
        {"name": ["Work"], "rule": {"type": "regex", "regex": "tool", "ignore_case": True}},
        {"name": ["Media", "Video"], "rule": {"type": "regex", "regex": "Tool tube", "ignore_case": True}},
        {"name": ["AFK"], "rule": {"type": "regex", "regex": "Lock"}},
    ]}))
    rules = load_rules(path)
    assert rules[3] == Rule(("AFK",), "Lock", False)
    table = spark.createDataFrame([("TOOL  tube",), ("tool",), ("lock",), ("Lock",)], "t string")
    got = [r[0] for r in table.select(categorize_window(F.col("t"), F.lit(""), F.lit(None), rules)).collect()]
    assert got == ["media", "other", "other", "other"]
    assert spark.range(1).select(categorize_web(F.lit("https://github.com/a"), F.lit("GitHub"))).collect()[0][0] == "development"


def test_state_model_file_is_checked(tmp_path):
    from dayloom.functions.state_model import DEFAULT_STATE_MODEL as m

    body = {
        "feature_columns": list(m.features), "scaler": {"mean": m.mean, "scale": m.scale},
        "cluster_centers": m.centers, "state_names": m.names, "n_states": 6,
    }
    path = tmp_path / "model.json"
    path.write_text(json.dumps(body))
    assert load_state_model(path) == m
    for key, value in (("n_states", 5), ("feature_columns", list(m.features)[::-1]), ("state_names", ["one"])):
        path.write_text(json.dumps({**body, key: value}))
        with pytest.raises(ValueError):
            load_state_model(path)


def test_event_checks(spark):
    table = spark.createDataFrame(
        [(" u ", at("09:00"), at("09:10"), "A", " media ", 0), (None, at("09:00"), at("09:10"), "A", "media", 1),
         ("u", at("09:10"), at("09:00"), "A", "media", 2), ("u", at("09:00"), at("09:10"), "A", "gardening", 3)], EVENT,
    )
    problems = [r["problem"] for r in contract.check_events(table, "window").orderBy("seq").collect()]
    assert problems == [None, "missing user_id", "end before start", "unknown category"]
    (row,) = contract.prepare_events(table, "window").collect()
    assert (row["user_id"], row["category"], row["source_type"], row["category_confidence"]) == ("u", "media", "window", "unknown")
    with pytest.raises(Exception, match="missing user_id|end before start|unknown category"):
        contract.prepare_events(table, "window", strict=True).collect()
    with pytest.raises(ValueError, match="missing columns"):
        contract.check_events(table.drop("app"), "window")


def test_clip_cuts_durations_again(spark):
    table = spark.createDataFrame([("u", at("09:00"), at("09:10"), "A", "media", 0), ("u", at("09:05"), at("09:06"), "A", "media", 1)], EVENT)
    table = table.withColumn("duration_seconds", F.lit(999.0))
    end = F.lit("2026-01-01 09:05:00").cast("timestamp_ntz")
    (row,) = contract.clip_events_at(table, end).collect()
    assert (row["event_end"], row["duration_seconds"]) == (at("09:05"), 300.0)


def test_sink_partitions_by_date(spark, tmp_path):
    table = spark.createDataFrame([("u", at("09:00")), ("v", at("10:00"))], "user_id string, timestamp timestamp_ntz")
    write_features(table, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 2 and "date" in back.columns


def test_strings_of_zero_and_false_are_texts(spark):
    import json

    from dayloom.sources.buckets import RAW_SCHEMA

    titles = [{"title": "0"}, {"title": 0}, {"title": False}, {"title": "false"}, {}, {"title": None}, {"title": 1.5}]
    rows = [("u", "b", "currentwindow", "h", None, i, "2024-01-01T00:00:00+00:00", "60", json.dumps({"app": f"a{i}", **t})) for i, t in enumerate(titles)]
    out = parse_events(spark.createDataFrame(rows, RAW_SCHEMA)).window.orderBy("app").collect()
    assert [r["title"] for r in out] == ["0", "", "", "false", "", "", "1.5"]


def test_default_rules_are_the_whole_table():
    from dayloom.functions.categories import DEFAULT_RULES

    assert len(DEFAULT_RULES) == 24 and ("Work", "Programming", "ActivityWatch") in {r.path for r in DEFAULT_RULES}
    assert all(len(r.pattern) > 2 for r in DEFAULT_RULES if r.pattern)
