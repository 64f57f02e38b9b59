"""Interval joins that are asked for as pairs.

The feature operators never use these; they exist for users who want the pairs
themselves. Both sides are cut into time bins, so the join is an equi-join on
(user, bin) and each pair is emitted once, in the first bin both sides share.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.times import HOUR_US, floor_div, to_us
from dayloom.vocab import WINDOW_MINUTES

MINUTE = 60_000_000


def overlap_join(
    requests: DataFrame,
    events: DataFrame,
    from_minutes: float = WINDOW_MINUTES,
    to_minutes: float = 0.0,
    bin_minutes: float = 15.0,
) -> DataFrame:
    """Request x event pairs overlapping ``[t - from, t - to)``.

    ``requests``: user_id, timestamp. ``events``: user_id, timestamp, event_end, ...
    The event's own columns come prefixed with ``event_`` where names collide.
    """
    width = int(bin_minutes * MINUTE)
    asked = requests.select("user_id", F.col("timestamp").alias("request_time")).distinct()
    t = to_us("request_time")
    asked = (
        asked.withColumn("lo", t - int(from_minutes * MINUTE))
        .withColumn("hi", t - int(to_minutes * MINUTE))
        .withColumn("lo_bin", floor_div(F.col("lo"), width))
        .withColumn("bin", F.explode(F.sequence(F.col("lo_bin"), floor_div(F.col("hi") - 1, width))))
    )
    have = (
        events.withColumn("s_us", to_us("timestamp")).withColumn("e_us", to_us("event_end"))
        .filter("e_us > s_us")
        .withColumn("s_bin", floor_div(F.col("s_us"), width))
        .withColumn("bin", F.explode(F.sequence(F.col("s_bin"), floor_div(F.col("e_us") - 1, width))))
    )
    pairs = asked.join(have, ["user_id", "bin"]).filter(
        (F.col("s_us") < F.col("hi")) & (F.col("e_us") > F.col("lo"))
        & (F.col("bin") == F.greatest("lo_bin", "s_bin"))
    )
    return pairs.select(
        "user_id", "request_time", *[c for c in events.columns if c != "user_id"],
        F.greatest("s_us", "lo").alias("clip_start_us"), F.least("e_us", "hi").alias("clip_end_us"),
    )


def stream_pairs(
    requests: DataFrame, streams: Mapping[str, DataFrame], from_minutes: float, to_minutes: float = 0.0,
    bin_minutes: float = 15.0,
) -> DataFrame:
    """C1 / C2 over several event streams: the pairs of all, with the stream's name as ``source``.

    Columns that a stream lacks are null. Long ranges want wide bins: a request is copied once a bin.
    """
    parts = [
        overlap_join(requests, t, from_minutes, to_minutes, bin_minutes).withColumn("source", F.lit(n))
        for n, t in streams.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def state_range_join(
    requests: DataFrame, hourly: DataFrame, from_minutes: float, to_minutes: float
) -> DataFrame:
    """Request x hourly state pairs with ``floor_hour(t - from) <= hour < t - to``.

    At most one pair per hour of the range (about 170 for a week): each request names
    its hours and the join is an equi-join on (user, hour).
    """
    asked = requests.select("user_id", F.col("timestamp").alias("request_time")).distinct()
    t = to_us("request_time")
    first = floor_div(t - int(from_minutes * MINUTE), HOUR_US)
    last = floor_div(t - int(to_minutes * MINUTE) - 1, HOUR_US)
    asked = asked.withColumn("hour_no", F.explode(F.sequence(first, last)))
    states = hourly.withColumn("hour_no", floor_div(to_us("hour"), HOUR_US))
    return asked.join(states, ["user_id", "hour_no"]).drop("hour_no")


def unique_left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a right side that must be unique on ``keys``.

    The uniqueness check rides in the same shuffle: a duplicate fails the job.
    """
    value = [c for c in right.columns if c not in keys]
    checked = right.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in value]
    )
    joined = left.join(checked, keys, "left")
    unique = F.when(F.coalesce("_n", F.lit(1)) == 1, F.lit(True)).otherwise(
        F.raise_error(F.lit("history merge needs unique keys")).cast("boolean")
    )
    return joined.filter(unique).select(*left.columns, *value)


def distinct_times(*tables: DataFrame) -> DataFrame:
    """G1 + G2: the distinct (user_id, timestamp) of several tables."""
    out = tables[0].select("user_id", "timestamp")
    for extra in tables[1:]:
        out = out.unionByName(extra.select("user_id", "timestamp"))
    return out.distinct()


def replace_hour(full: DataFrame, partial: DataFrame, keys: list[str], hour: Column) -> DataFrame:
    """Drop each key's row of ``hour`` and append the partial rows."""
    return full.filter(F.col("hour") != hour).unionByName(partial, allowMissingColumns=True)
