"""Small builders for event tables and an independent per-request brute force."""

from __future__ import annotations

import datetime as dt

import numpy as np

EVENT = "user_id string, timestamp timestamp_ntz, event_end timestamp_ntz, app string, category string, seq long"
INPUT = (
    "user_id string, timestamp timestamp_ntz, event_end timestamp_ntz, duration_seconds double, "
    "presses double, clicks double, mouse_distance double, scroll_abs double"
)
REQUEST = "user_id string, timestamp timestamp_ntz"


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(f"2026-01-01 {text}")


def golden(spark):
    """Events with an earlier context block; requests at 09:00 and 10:00."""
    window = spark.createDataFrame(
        [
            ("user1", at("09:30"), at("09:50"), "Code", "development", 0),
            ("user1", at("09:50"), at("10:00"), "Slack", "communication", 1),
            ("user1", at("08:00"), at("08:30"), "Code", "development", 2),
        ],
        EVENT,
    ).coalesce(1)
    web = spark.createDataFrame(
        [("user1", at("09:40"), at("09:45"), None, "development", 0)], EVENT
    ).drop("app").coalesce(1)
    inputs = spark.createDataFrame(
        [("user1", at("09:35"), at("09:35:30"), 30.0, 10.0, 2.0, 1000.0, 200.0)], INPUT
    ).coalesce(1)
    requests = spark.createDataFrame([("user1", at("09:00")), ("user1", at("10:00"))], REQUEST).coalesce(1)
    return window, web, inputs, requests


def random_events(seed: int, n: int, minutes: int, longest: int):
    """Overlapping events of one user in whole seconds from a common origin."""
    rng = np.random.default_rng(seed)
    start = rng.integers(0, minutes * 60, n)
    length = rng.integers(1, longest * 60, n)
    category = rng.choice(["development", "media", "other", "research"], n)
    app = rng.choice(["a", "b", "c"], n)
    web = rng.random(n) < 0.4
    return [
        {"s": int(s), "e": int(s + d), "category": str(c), "app": str(a), "web": bool(w), "seq": i}
        for i, (s, d, c, a, w) in enumerate(zip(start, length, category, app, web))
    ]


def brute(events, t: int, width: int = 3600):
    """Current-window features of one request, second by second."""
    lo = t - width
    active = [e for e in events if e["s"] < t and e["e"] > lo]
    owner = []
    for second in range(lo, t):
        on = [e for e in active if e["s"] <= second < e["e"]]
        best = max(on, key=lambda e: (e["web"], e["s"], -e["seq"]), default=None)
        owner.append(best["category"] if best else None)
    blocks, last = [], None
    for value in owner:
        if value is not None and value == last:
            blocks[-1] += 1
        elif value is not None:
            blocks.append(1)
        last = value
    apps = [e["app"] for e in sorted((e for e in active if not e["web"]), key=lambda e: (e["s"], e["seq"]))]
    return {
        "total_active_minutes": sum(v is not None for v in owner) / 60,
        "time_development": owner.count("development") / 60,
        "time_media": owner.count("media") / 60,
        "mean_focus_block_minutes": sum(blocks) / len(blocks) / 60 if blocks else 0.0,
        "short_fragment_count_2m": float(sum(b < 120 for b in blocks)),
        "app_switch_count": float(sum(a != b for a, b in zip(apps, apps[1:]))),
    }
