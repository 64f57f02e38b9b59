"""Runs over parts of the events against one run over all of them."""

import datetime as dt
import random

import pytest

from dayloom.operators.states import hourly_behavior
from dayloom.plans.incremental import ActivityStore
from dayloom.plans.production import production_features
from dayloom.sources.store import DayStore
from tests.helpers import REQUEST

WINDOW = "seq long, user_id string, timestamp timestamp_ntz, event_end timestamp_ntz, app string, category string"
INPUT = "seq long, user_id string, timestamp timestamp_ntz, event_end timestamp_ntz, duration_seconds double, presses double, clicks double, mouse_distance double, scroll_abs double"
ORIGIN = dt.datetime(2026, 3, 1)


def rows_of(seed, days=24, n=260):
    """Events and requests of three users; some events run over midnight."""
    rng = random.Random(seed)
    moment = lambda: ORIGIN + dt.timedelta(seconds=rng.randrange(days * 86400))
    out = {"window": [], "web": [], "input": [], "requests": []}
    for k in range(n):
        user, start = rng.choice(["a", "a", "b", "c"]), moment()
        end = start + dt.timedelta(seconds=rng.choice([0, 40, 600, 4000, 40_000]))
        category = rng.choice(["development", "media", "other", "research", "personal_distraction"])
        if k % 4 < 2:
            out["window"].append((k, user, start, end, rng.choice("xyz"), category))
        elif k % 4 == 2:
            out["web"].append((k, user, start, end, None, category))
        else:
            out["input"].append((k, user, start, end, (end - start).total_seconds(), 3.0, 1.0, 50.0, float(k % 7)))
        if k % 3 == 0:
            out["requests"].append((user, start + dt.timedelta(seconds=rng.randrange(7200))))
    return out


def frames(spark, rows):
    schema = {"window": WINDOW, "web": WINDOW, "input": INPUT, "requests": REQUEST}
    return {n: spark.createDataFrame(r, schema[n]).coalesce(1) for n, r in rows.items()}


def extend(store, tables):
    return store.extend(tables["window"], tables["web"].drop("app"), tables["input"], tables["requests"])


def values(table):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in table.collect())


def split(rows, keep):
    """Rows that ``keep(start, k)`` says come first, and the others."""
    at = lambda name, r: r[1] if name == "requests" else r[2]
    first = {n: [r for k, r in enumerate(rs) if keep(at(n, r), k)] for n, rs in rows.items()}
    return first, {n: [r for r in rs if r not in first[n]] for n, rs in rows.items()}


def test_two_runs_equal_one_and_scan_new_and_late_days_only(spark, tmp_path, monkeypatch):
    rows = rows_of(1)
    cut = ORIGIN + dt.timedelta(days=18)
    late = dt.date(2026, 3, 12)
    first, second = split(rows, lambda t, k: t < cut and not (t.date() == late and k % 2))
    store = ActivityStore(spark, str(tmp_path / "store"))
    assert store.mark is None
    done = extend(store, frames(spark, first))
    assert done.run == 1 and not done.late_days and store.mark == done.new_days[-1]

    scanned = []
    read = DayStore.read
    monkeypatch.setattr(DayStore, "read", lambda self, name, days=None, pending=None: scanned.append((name, set(days or ()))) or read(self, name, days, pending))
    done = extend(store, frames(spark, second))
    assert late in done.late_days and all(d <= dt.date(2026, 3, 18) for d in done.late_days)
    days = set().union(*(d for n, d in scanned if n in ("window", "web", "input")))
    assert days and min(days) >= late - dt.timedelta(days=1)  # nothing older is scanned for events
    files = store.store.read("window", {late}).inputFiles()
    assert files and all(f"date={late}" in f for f in files)

    every = frames(spark, rows)
    whole = production_features(every["window"], every["web"].drop("app"), every["input"], every["requests"])
    assert values(store.features()) == values(whole)
    assert values(store.hourly()) == values(hourly_behavior(every["window"], every["web"].drop("app")))
    some = store.features(dt.date(2026, 3, 5), dt.date(2026, 3, 9))
    assert values(some) == values(whole.filter("to_date(timestamp) BETWEEN '2026-03-05' AND '2026-03-09'"))


def test_runs_without_rows_and_of_one_stream(spark, tmp_path):
    store = ActivityStore(spark, str(tmp_path / "store"))
    assert store.features().count() == 0 and store.hourly().count() == 0
    rows = rows_of(2, days=3, n=40)
    tables = frames(spark, rows)
    store.extend(requests=tables["requests"])  # nothing is known of them yet
    store.extend(tables["window"])
    done = store.extend(inputs=tables["input"])
    assert done.read_days
    store.extend(web=tables["web"].drop("app").filter("false"))
    whole = production_features(tables["window"], tables["web"].drop("app").filter("false"), tables["input"], tables["requests"])
    assert values(store.features()) == values(whole)


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    store = ActivityStore(spark, str(tmp_path / "store"))
    tables = frames(spark, rows_of(3, days=2, n=30))
    extend(store, tables)
    before = values(store.features())
    long = spark.createDataFrame([(1, "a", ORIGIN, ORIGIN + dt.timedelta(hours=13), "x", "media")], WINDOW)
    with pytest.raises(Exception, match="longer than"):
        store.extend(web=tables["web"].drop("app"), window=long)
    again = ActivityStore(spark, str(tmp_path / "store"))
    assert again.store.last_run == 1 and values(again.features()) == before
