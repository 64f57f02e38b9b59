"""Bins that are crowded: cut into parts, with the same runs."""

import random

import pytest

from dayloom.operators.bins import crowded_bins, quantile_cuts
from dayloom.operators import timeline

HOUR = 3_600_000_000
ACTIVITY = "user_id string, s_us long, e_us long, priority int, seq long, category string"


def rows_of(seed, n, longest, grid):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        start = rng.randrange(0, 3 * HOUR, grid)
        out.append((rng.choice("aab"), start, start + rng.randrange(0, longest, grid), rng.choice([0, 0, 1]), k % 50, rng.choice(["x", "y", "z"])))
    return out


@pytest.mark.parametrize("merge", ["winner", "category"])
@pytest.mark.parametrize(("longest", "grid"), [(20_000_000, 1_000_000), (2 * HOUR, 60_000_000), (300_000_000, 17_000_000)])
def test_parts_give_the_runs_of_whole_bins(spark, merge, longest, grid):
    table = spark.createDataFrame(rows_of(longest, 900, longest, grid), ACTIVITY).repartition(3)
    whole = sorted(map(tuple, timeline.resolve_bins(table, HOUR, merge).collect()))
    parts = sorted(map(tuple, timeline.resolve_bins(table, HOUR, merge, crowded=40).collect()))
    key = (lambda r: r) if merge == "winner" else (lambda r: (*r[:4], r[6]))
    assert [key(r) for r in parts] == [key(r) for r in whole] and len(whole) > 50


def test_a_dense_hour_spreads_over_tasks(spark):
    n, limit = 200_000, 10_000
    table = spark.range(n).selectExpr(
        "'u' AS user_id", f"(id * 7919) % {HOUR} AS s_us", f"(id * 7919) % {HOUR} + 2000000 + id % 900 * 1000000 AS e_us",
        "cast(id % 2 AS int) AS priority", "id AS seq", "concat('c', id % 5) AS category",
    )
    pieces = timeline.explode_bins(table, "s_us", "e_us", HOUR).select("user_id", "bin", "p_start", "p_end", "s_us", "priority", "category", "seq")
    dense = crowded_bins(pieces, limit)
    parts = timeline._parts(pieces, quantile_cuts(pieces, dense, ["p_start", "p_end"]))
    sizes = [r["count"] for r in parts.groupBy("user_id", "bin", "part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 2 * limit
    total = sum(r["end_us"] - r["start_us"] for r in timeline.resolve_bins(table, HOUR, crowded=limit).select("start_us", "end_us").collect())
    edges = table.selectExpr("min(s_us)", "max(e_us)").first()
    assert total == edges[1] - edges[0]  # someone is active all the time, and no instant counts twice
