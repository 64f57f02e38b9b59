"""Raw events to the window, web and input tables.

Everything is one projection, one filter and one map-side combined aggregate
(heartbeats); no window function and no row-wise Python.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.categories import DEFAULT_RULES, Rule, categorize_web, categorize_window
from dayloom.functions.numbers import coerce_number
from dayloom.functions.text import normalize_domain, strip
from dayloom.functions.times import SECOND_US, from_us, normalize_timestamp, to_us
from dayloom.vocab import (
    BUCKET_STREAMS,
    LOCK_SCREEN_APPS,
    MAX_EVENT_SECONDS,
    STREAM_COLUMNS,
)


class EventTables(NamedTuple):
    """The three parsed streams; each also carries ``seq`` for ties."""

    window: DataFrame
    web: DataFrame
    input: DataFrame


def stream_of(bucket_type: Column) -> Column:
    """A2: stream of a bucket type, NULL for unsupported ones."""
    out = F.lit(None).cast("string")
    for name, stream in BUCKET_STREAMS.items():
        out = F.when(bucket_type == name, F.lit(stream)).otherwise(out)
    return out


def valid_duration(seconds: Column) -> Column:
    """A3: strictly between zero and twelve hours."""
    return (seconds > 0) & (seconds < MAX_EVENT_SECONDS)


def hostname_of(hostname: Column, bucket_data: Column) -> Column:
    """A10: own hostname, else the one in the bucket metadata, else ``unknown``."""
    return F.coalesce(
        F.nullif(hostname, F.lit("")),
        F.nullif(F.get_json_object(bucket_data, "$.hostname"), F.lit("")),
        F.lit("unknown"),
    )


def data_key(data: Column) -> Column:
    """H9: JSON text with sorted keys; keeps ``1`` and ``"1"`` apart."""
    return F.to_json(F.try_parse_json(F.coalesce(data, F.lit("{}"))))


def malformed_events(raw: DataFrame) -> DataFrame:
    """Raw events of supported buckets that cannot be parsed, with the reason."""
    blank = strip(F.coalesce("user_id", F.lit(""))) == ""
    key = data_key(F.col("data"))
    problem = F.coalesce(
        F.when(blank, F.lit("blank user_id")),
        F.when(key.isNull() | ~F.ltrim("data").startswith("{"), F.lit("data is not an object")),
        F.when(normalize_timestamp("timestamp").isNull(), F.lit("invalid timestamp")),
    )
    kept = raw.filter(stream_of(F.col("type")).isNotNull()).filter(
        valid_duration(coerce_number(F.col("duration")))
        & F.col("timestamp").isNotNull() & (F.col("timestamp") != "")
    )
    return kept.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def dedupe_heartbeats(raw: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """A3 + A5: valid events, one per (bucket, timestamp text, data), the longest kept.

    ``carried`` are columns that depend on those three alone and are kept.

    A plain aggregate: copies combine before the shuffle, and the shuffle key is the
    event itself, so neither a hot bucket nor a group of copies meets in one task.
    """
    return (
        raw.withColumn("source_type", stream_of(F.col("type")))
        .withColumn("duration_seconds", coerce_number(F.col("duration")))
        .withColumn("data_key", data_key(F.col("data")))
        .withColumn("user_id", strip(F.col("user_id")))
        .withColumn("hostname", hostname_of(F.col("hostname"), F.col("bucket_data")))
        .filter(F.col("source_type").isNotNull() & valid_duration(F.col("duration_seconds")))
        .filter((F.col("timestamp") != "") & (F.col("user_id") != ""))
        .filter(F.col("data").isNull() | F.ltrim("data").startswith("{"))
        .groupBy("user_id", "bucket", "hostname", "source_type", "timestamp", "data_key", *carried)
        .agg(
            F.max("duration_seconds").alias("duration_seconds"), F.min("seq").alias("seq"),
            F.count("data_key").alias("_parsed"),
        )
        # checked on the aggregate: a filter on the key would parse every text twice
        .filter("_parsed > 0").drop("_parsed")
    )


def base_rows(snapshots: DataFrame) -> DataFrame:
    """Local timestamp, end on the wall clock, date; ``m`` holds the event data."""
    return (
        snapshots.withColumn("timestamp", normalize_timestamp("timestamp"))
        .filter(F.col("timestamp").isNotNull())
        .withColumn(
            "event_end",
            from_us(to_us("timestamp") + F.round(F.col("duration_seconds") * SECOND_US).cast("bigint")),
        )
        .withColumn("date", F.date_format("timestamp", "yyyy-MM-dd"))
        .withColumn("m", F.from_json("data_key", "map<string,string>"))
        .withColumn("v", F.try_parse_json("data_key"))
    )


def _value(name: str) -> Column:
    return F.try_element_at("m", F.lit(name))


def _text(name: str, default: str = "") -> Column:
    """The text of a field; absent, null, empty, zero and false fall to the default.

    Only JSON values count as zero or false: the strings ``"0"`` and ``"false"`` are texts.
    """
    value = _value(name)
    is_text = F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")) == "STRING"
    falsy = value.isin("0", "0.0", "-0.0", "false") & ~F.coalesce(is_text, F.lit(False))
    return F.when(value.isNull() | (value == "") | falsy, F.lit(default)).otherwise(value)


def window_rows(base: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Application windows without lock screens."""
    rows = base.filter(F.col("source_type") == "window").withColumns(
        {"app": _text("app", "unknown"), "title": _text("title"), "url": _text("url")}
    ).filter(~F.lower("app").isin(*LOCK_SCREEN_APPS))
    return rows.withColumns(
        {
            "category": categorize_window(F.col("app"), F.col("title"), F.col("url"), rules),
            "category_confidence": F.lit("high"),
            "category_rule": F.lit(""),
        }
    )


def web_rows(base: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Browser tabs; ``tab_count`` is read only when the key ``tabCount`` is absent."""
    rows = base.filter(F.col("source_type") == "web").withColumns(
        {"title": _text("title"), "url": _text("url")}
    )
    tabs = F.when(F.map_contains_key("m", "tabCount"), _value("tabCount")).otherwise(_value("tab_count"))
    return rows.withColumns(
        {
            "domain": normalize_domain(F.col("url")),
            "category": categorize_web(F.col("url"), F.col("title"), rules),
            "category_confidence": F.lit("high"),
            "category_rule": F.lit(""),
            "audible": _value("audible").try_cast("boolean"),
            "tab_count": tabs.try_cast("int"),
        }
    )


def input_rows(base: DataFrame) -> DataFrame:
    """Key presses, clicks, pointer distance and scroll amount."""
    number = lambda name: coerce_number(_value(name))
    return base.filter(F.col("source_type") == "input").withColumns(
        {
            "presses": number("presses"),
            "clicks": number("clicks"),
            "mouse_distance": F.hypot(number("deltaX"), number("deltaY")),
            "scroll_abs": F.abs(number("scrollX")) + F.abs(number("scrollY")),
        }
    )


def finalize(rows: DataFrame, stream: str) -> DataFrame:
    """Contract columns in order, then ``seq``. Sorting is left to presentation."""
    return rows.select(*STREAM_COLUMNS[stream], "seq")


def parse_events(raw: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> EventTables:
    """A1: the three event tables of every user in ``raw``."""
    return tables_of(dedupe_heartbeats(raw), rules)


def tables_of(snapshots: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> EventTables:
    """The three event tables of events whose heartbeats are joined (:func:`dedupe_heartbeats`)."""
    base = base_rows(snapshots)
    return EventTables(
        finalize(window_rows(base, rules), "window"),
        finalize(web_rows(base, rules), "web"),
        finalize(input_rows(base), "input"),
    )
