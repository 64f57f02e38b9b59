"""Live events against the same events in one batch, over restarts, repeated batches and late copies."""

import datetime as dt
import json
import random

from dayloom.operators.parse import parse_events
from dayloom.operators.states import hourly_behavior
from dayloom.plans.incremental import ActivityStore
from dayloom.sources.buckets import RAW_SCHEMA, read_raw_events
from dayloom.streaming.live import late_rows, live_store

ORIGIN = dt.datetime(2026, 3, 2, 20)
KINDS = ["currentwindow", "currentwindow", "web.tab.current", "os.hid.input", "afkstatus"]


def _copies(seed, n=120, hours=30):
    """Heartbeats in order of arrival: copies of an event grow while it lasts."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        start = ORIGIN + dt.timedelta(seconds=rng.randrange(hours * 3600))
        kind, user = rng.choice(KINDS), rng.choice(["a", "a", "b"])
        data = json.dumps({"app": rng.choice(["Code", "Chrome"]), "title": f"t{k}", "url": "https://github.com/x", "presses": k % 5})
        for seconds in sorted(rng.sample(range(5, 5000), rng.randrange(1, 5))):
            row = {"user_id": user, "bucket": kind, "type": kind, "hostname": "h", "seq": k, "data": data,
                   "timestamp": start.isoformat() + "+01:00", "duration": str(seconds)}
            rows.append((start + dt.timedelta(seconds=seconds), row))
    rows.sort(key=lambda r: r[0])
    return [r for _, r in rows]


def _file(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def _tick(hours):
    at = (ORIGIN + dt.timedelta(hours=hours)).isoformat()
    return {"user_id": "c", "bucket": "x", "type": "currentwindow", "seq": 0, "timestamp": at + "+01:00", "duration": "1", "data": "{}"}


def _values(table):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in table.collect())


def test_a_stream_gives_what_a_batch_gives_also_after_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = _copies(1)
    store = ActivityStore(spark, str(tmp_path / "store"))

    def run():
        raw = spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
        writer = live_store(raw, ActivityStore(spark, str(tmp_path / "store")), str(tmp_path / "checkpoint"), delay="3 hours")
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    third = len(rows) // 3
    for k, part in enumerate((rows[:third], rows[third : 2 * third], [*rows[2 * third :], _tick(40)])):
        _file(folder, f"{k}.json", part)
        run()
    batch = parse_events(read_raw_events(spark, str(folder)).filter("user_id <> 'c'"))  # which has not ended in the stream
    expected = _values(hourly_behavior(batch.window, batch.web))
    store.store.refresh()
    assert len(expected) > 20 and _values(store.hourly()) == expected
    # nothing new: nothing changes, and a copy far behind the watermark is counted, not added
    _file(folder, "late.json", [{**rows[0], "duration": "9000"}])
    assert late_rows(run()) == 1
    store.store.refresh()
    assert _values(store.hourly()) == expected


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    _file(tmp_path, "raw.json", _copies(2, n=30))
    tables = parse_events(read_raw_events(spark, str(tmp_path / "raw.json")))
    store = ActivityStore(spark, str(tmp_path / "store"))
    first = store.extend(tables.window, tables.web, tables.input, batch="live 0")
    once = _values(store.hourly())
    again = store.extend(tables.window, tables.web, tables.input, batch="live 0")
    assert first.new_days and not again.new_days and _values(store.hourly()) == once
    assert once == _values(hourly_behavior(tables.window, tables.web))
    # an empty batch is committed, too
    store.extend(tables.window.filter("false"), batch="live 1")
    assert store.store.holds("live 1") and not store.store.holds("live 2")
