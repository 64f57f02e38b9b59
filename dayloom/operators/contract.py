"""Validation and normalisation of event and request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions.numbers import is_finite
from dayloom.functions.text import strip
from dayloom.functions.times import (
    SECOND_US,
    floor_div,
    normalize_instant,
    normalize_timestamp,
    to_us,
)
from dayloom.operators.bins import bin_width, explode_bins
from dayloom.vocab import CATEGORIES, INPUT_NUMBERS, REQUIRED_COLUMNS, WINDOW_MINUTES


def as_local(table: DataFrame, name: str) -> Column:
    """B1 on one column, whatever its type (instant, naive or text)."""
    kind = table.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return normalize_instant(name)
    if isinstance(kind, T.TimestampNTZType):
        return F.col(name)
    return normalize_timestamp(name)


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Request times as naive local time, user ids trimmed; an unreadable time is NULL."""
    if "timestamp" not in requests.columns:
        raise ValueError("requests need a timestamp column")
    out = requests.withColumn("timestamp", as_local(requests, "timestamp"))
    if "user_id" in requests.columns:
        out = out.withColumn("user_id", strip(F.col("user_id").cast("string")))
    return out


def request_problem() -> Column:
    """Why a normalised request cannot be answered, else NULL."""
    return F.coalesce(
        F.when(F.col("user_id").isNull(), F.lit("missing user_id")),
        F.when(F.col("user_id") == "", F.lit("blank user_id")),
        F.when(F.col("timestamp").isNull(), F.lit("invalid timestamp")),
    )


def check_events(table: DataFrame, stream: str) -> DataFrame:
    """B2: normalised rows plus ``problem`` (NULL when the row is valid).

    One projection; a caller can count, quarantine or raise on the result.
    """
    missing = sorted(set(REQUIRED_COLUMNS[stream]) - set(table.columns))
    if missing:
        raise ValueError(f"{stream} events are missing columns: {missing}")
    out = table.withColumns(
        {c: as_local(table, c) for c in ("timestamp", "event_end")}
        | {"user_id": strip(F.col("user_id").cast("string"))}
    )
    rules = [
        F.when(F.col("timestamp").isNull() | F.col("event_end").isNull(), F.lit("invalid timestamp")),
        F.when(F.col("event_end") < F.col("timestamp"), F.lit("end before start")),
        F.when(F.col("user_id").isNull(), F.lit("missing user_id")),
        F.when(F.col("user_id") == "", F.lit("blank user_id")),
    ]
    if stream in ("window", "web"):
        out = out.withColumn("category", strip(F.col("category").cast("string")))
        out = out.withColumn("source_type", F.lit(stream))
        if "category_confidence" not in table.columns:
            out = out.withColumn("category_confidence", F.lit("unknown"))
        rules += [
            F.when(F.col("category").isNull(), F.lit("missing category")),
            F.when(~F.col("category").isin(CATEGORIES), F.lit("unknown category")),
        ]
    else:
        given = {c: F.col(c).cast("string") for c in INPUT_NUMBERS}
        out = out.withColumns({f"_raw_{c}": v for c, v in given.items()})
        out = out.withColumns(
            {c: F.coalesce(F.col(f"_raw_{c}").try_cast("double"), F.lit(0.0)) for c in INPUT_NUMBERS}
        )
        for c in INPUT_NUMBERS:
            raw = F.col(f"_raw_{c}")
            rules += [
                F.when(raw.isNotNull() & raw.try_cast("double").isNull(), F.lit(f"not a number: {c}")),
                F.when(~is_finite(F.col(c)), F.lit(f"not finite: {c}")),
                F.when(F.col(c) < 0, F.lit(f"negative: {c}")),
            ]
        out = out.withColumn("problem", F.coalesce(*rules))
        return out.drop(*[f"_raw_{c}" for c in INPUT_NUMBERS])
    return out.withColumn("problem", F.coalesce(*rules))


def violations(table: DataFrame, stream: str) -> DataFrame:
    """Rows of B2 that break a rule, with the reason."""
    return check_events(table, stream).filter(F.col("problem").isNotNull())


def prepare_events(table: DataFrame, stream: str, strict: bool = False) -> DataFrame:
    """B2: the normalised table. ``strict`` fails the job on the first invalid row."""
    checked = check_events(table, stream)
    if strict:
        message = F.concat(F.lit(f"{stream} events: "), F.col("problem"))
        checked = checked.filter(
            F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
        )
    else:
        checked = checked.filter(F.col("problem").isNull())
    return checked.drop("problem")


def clip_events_at(table: DataFrame, end: Column) -> DataFrame:
    """Nothing after ``end`` stays visible; durations are cut again for all rows."""
    out = (
        table.filter(F.col("timestamp") < end)
        .withColumn("event_end", F.least(F.col("event_end"), end))
        .filter(F.col("event_end") > F.col("timestamp"))
    )
    if "duration_seconds" in table.columns:
        out = out.withColumn(
            "duration_seconds", (to_us("event_end") - to_us("timestamp")) / float(SECOND_US)
        )
    return out


def select_window(table: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events overlapping the half-open range."""
    return table.filter((F.col("timestamp") < end) & (F.col("event_end") > start))


def requests_with_activity(
    requests: DataFrame,
    window: DataFrame | None,
    web: DataFrame | None,
    window_minutes: float = WINDOW_MINUTES,
) -> DataFrame:
    """Add ``has_activity``: some window or web event overlaps the request's window.

    ``[t - w, t)`` is the end of one bin and the start of the next, so a per-bin
    latest end and earliest start decide it: two equi-joins with one row per bin.
    """
    width = bin_width(window_minutes)
    parts = [
        t.select(F.col("user_id").cast("string").alias("user_id"), to_us("timestamp").alias("s_us"), to_us("event_end").alias("e_us"))
        for t in (window, web) if t is not None
    ]
    events = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    edges = explode_bins(events, "s_us", "e_us", width).groupBy("user_id", "bin").agg(
        F.min("p_start").alias("first_start"), F.max("p_end").alias("last_end")
    )
    asked = requests.withColumn("_us", to_us("timestamp")).withColumn("_bin", floor_div(F.col("_us"), width))
    head = edges.select("user_id", F.col("bin").alias("_bin"), "first_start")
    tail = edges.select("user_id", (F.col("bin") + 1).alias("_bin"), "last_end")
    return (
        asked.join(head, ["user_id", "_bin"], "left").join(tail, ["user_id", "_bin"], "left")
        .withColumn("has_activity", F.coalesce(F.col("first_start") < F.col("_us"), F.lit(False))
                    | F.coalesce(F.col("last_end") > F.col("_us") - width, F.lit(False)))
        .select(*requests.columns, "has_activity")
    )


def users_without_activity_source(buckets: DataFrame) -> DataFrame:
    """Users with buckets but no window or web bucket."""
    return (
        buckets.groupBy("user_id")
        .agg(F.bool_or(F.col("type").isin("currentwindow", "web.tab.current")).alias("ok"))
        .filter("NOT coalesce(ok, false)")
        .select("user_id")
    )


def feature_problem(table: DataFrame, columns: list[str], allow_missing: bool) -> Column:
    """NULL when usable, else the first bad feature.

    ``allow_missing`` keeps NULL (and NaN) for history features and rejects only infinities.
    """
    absent = [c for c in columns if c not in table.columns]
    if absent:
        raise ValueError(f"missing model features: {absent}")
    rules = []
    for c in columns:
        v = F.col(c).cast("double")
        bad = F.coalesce(F.abs(v) == float("inf"), F.lit(False)) if allow_missing else ~is_finite(v)
        rules.append(F.when(bad, F.lit(c)))
    return F.coalesce(*rules)


def project_contract(table: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order."""
    absent = [c for c in columns if c not in table.columns]
    if absent:
        raise ValueError(f"feature table is missing required columns: {absent}")
    return table.select(*columns)
