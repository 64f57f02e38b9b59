"""Exports cut into byte ranges give the events that reading them whole gives."""

import json
import random

import pytest

from dayloom.sources.buckets import read_buckets
from dayloom.sources.exports import Range, marks_of, quotes_of, read_exports

NOTES = ['plain', 'a "quoted" one', 'back\\slash\\\\', '\\', '{"x": [1, 2], "events": [{"y": "}', "é 漢字 🙂", "", "x" * 300, "colon: , ]"]


def _export(rng, user, events):
    def event(k):
        data = {"n": k, "note": rng.choice(NOTES), rng.choice(NOTES) + "k": rng.choice([None, 1.5, True, {"events": [{"a": [{}]}]}, []])}
        return {"timestamp": f"2026-01-01T09:{k % 60:02d}:00Z", "duration": rng.choice([k, 1.5, "7", None]), "data": data, "id": k}

    sizes = [events, 0, 3, 1]
    buckets = {
        f"bucket {rng.choice(NOTES)} {b}": {
            **({"type": "currentwindow"} if b != 2 else {}), "data": {"hostname": "m", "deep": {"events": [{"no": 1}]}},
            "events": [event(k) for k in range(n)], **({"hostname": f"h{b}"} if b % 2 == 0 else {"hostname": None}),
        }
        for b, n in enumerate(sizes)
    }
    around = {"version": 2, "other": {"b": {"events": [{"timestamp": "no"}]}}}
    return {**around, "buckets": buckets, "user_id": user} if rng.random() < 0.5 else {"user_id": user, "buckets": buckets, **around}


def _rows(table):
    names = [c for c in table.columns if c != "seq"]
    rows = table.orderBy("seq").collect()
    value = lambda r, c: str(json.loads(r[c]) if c in ("data", "bucket_data") and r[c] else r[c])
    return sorted(tuple(value(r, c) for c in names) for r in rows), [value(r, "data") for r in rows if r["user_id"] == "u0"]


@pytest.mark.parametrize(("range_bytes", "indent"), [(37, None), (1000, None), (1000, 2), (1 << 20, 2)])
def test_ranges_of_any_size_give_the_same_events(spark, tmp_path, range_bytes, indent):
    rng = random.Random(7)
    few = range_bytes < 100
    exports = [_export(rng, f"u{k}", (12 if few else 150) if k == 0 else 2) for k in range(1 if few else 4)]
    lines, cut = tmp_path / "lines", tmp_path / "cut"
    lines.mkdir()
    cut.mkdir()
    (lines / "all.json").write_text("".join(json.dumps(e) + "\n" for e in exports))
    for part in (0, 1):
        text = "\n".join(json.dumps(e, indent=indent, ensure_ascii=bool(part)) for e in exports[part::2])
        (cut / f"part {part}.json").write_text(text, encoding="utf-8")
    (cut / "empty.json").write_text("")
    got = read_exports(spark, str(cut), range_bytes=range_bytes, ahead_bytes=64)
    expected = read_buckets(spark, str(lines))
    assert got.columns == expected.columns
    assert _rows(got) == _rows(expected)


def test_no_buckets_and_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"user_id": "u", "buckets": {}} {"user_id": 5, "buckets": {"b": {"events": []}}} {}')
    assert read_exports(spark, str(tmp_path / "a.json")).count() == 0
    (tmp_path / "b.json").write_text('{"buckets": {"b": {"events": [{"timestamp": "t"}, {"timestamp": ')
    with pytest.raises(Exception, match="ends inside a value"):
        read_exports(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "c.json").write_text('{"buckets": {"b": {"events": [{"timestamp": "t"}]}}}')
    (row,) = read_exports(spark, str(tmp_path / "c.json")).collect()
    assert (row["user_id"], row["bucket"], row["type"], row["timestamp"], row["data"]) == (None, "b", None, "t", None)


def test_marks_skip_strings_at_every_cut():
    text = json.dumps({"a\\": ['{"', "\\\"", {"b": "\\\\"}], "c": "]"}).encode()
    whole = marks_of(text, quotes_of(text, False), False, 0)
    assert whole.depth[-1] == 0 and bytes(whole.byte) == b"{:[,,{:}],:}"
    for cut in range(1, len(text)):
        head, tail = text[:cut], text[cut:]
        quotes = quotes_of(head, False)
        escaped = (len(head) - len(head.rstrip(b"\\"))) % 2 == 1
        depth = int(marks_of(head, quotes, False, 0).depth[-1])
        rest = marks_of(tail, quotes_of(tail, escaped), len(quotes) % 2 == 1, depth)
        assert (rest.at + cut).tolist() == whole.at[whole.at >= cut].tolist()


def test_a_large_export_is_read_by_many_tasks_in_little_memory(spark, tmp_path):
    event = '{"timestamp": "2026-01-01T09:00:00Z", "duration": 3, "data": {"app": "Code", "title": "%s"}}' % ("t" * 900)
    path = tmp_path / "large.json"
    with path.open("w") as f:
        f.write('{"user_id": "u", "buckets": {"w": {"type": "currentwindow", "events": [')
        for k in range(40):
            f.write(("," if k else "") + ",".join([event] * 1000))
        f.write("]}}}")
    size = path.stat().st_size
    table = read_exports(spark, str(path), range_bytes=2 << 20)
    assert table.count() == 40_000 and table.select("seq").distinct().count() == 40_000
    one = Range(str(path), 4 << 20, 6 << 20, size, False, 4)
    one.in_string = bool(len(quotes_of(path.read_bytes()[: 4 << 20], False)) % 2)
    one.depth = int(marks_of((head := path.read_bytes()[: 4 << 20]), quotes_of(head, False), False, 0).depth[-1])
    events = one.whole("events", 1 << 12)
    assert len(one.data) < (2 << 20) + (1 << 14) and all((4 << 20) <= e[0] < (6 << 20) for e in events)


def test_events_are_not_broadcast(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"user_id": "u", "buckets": {"b": {"events": [{"timestamp": "t"}]}}}')
    table = read_exports(spark, str(tmp_path / "a.json"))
    assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()
    assert table.count() == 1
