"""The driver's tables seen as tracker events, requests, reports and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.session import prepare_session
from dayloom.vocab import CATEGORIES, TARGETS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as intervals; ten users are folded into one so that they overlap."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    stream = (
        F.when(F.col("event_type") == "view", "web")
        .when(F.col("event_type").isin("click", "signup"), "window")
        .when(F.col("event_type") == "purchase", "input")
        .otherwise("request")
    )
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("event_id").alias("seq"),
            F.concat(F.lit("u"), F.expr("cast(user_id div 10 as string)")).alias("user_id"),
            F.col("ts").alias("timestamp"),
            F.when(F.col("event_id") % 17 == 0, 0)
            .otherwise(F.round(F.least("value", F.lit(700.0)) * 60).cast("bigint")).alias("seconds"),
            stream.alias("source_type"),
            k.alias("k"), "value",
        )
        .select(
            "seq", "user_id", "timestamp", "source_type", "k", "value",
            F.col("seconds").cast("double").alias("duration_seconds"),
            F.timestamp_micros(F.unix_micros(F.col("timestamp").cast("timestamp")) + F.col("seconds") * 1_000_000)
            .cast("timestamp_ntz").alias("event_end"),
            F.concat(F.lit("app"), (F.col("k") % 9).cast("string")).alias("app"),
            F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("k") % 14 + 1).alias("category"),
        )
    )


def window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_events(spark, sf_dir).filter("source_type = 'window'").select(
        "seq", "user_id", "timestamp", "event_end", "source_type", "app", "category"
    )


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_events(spark, sf_dir).filter("source_type = 'web'").select(
        "seq", "user_id", "timestamp", "event_end", "source_type", "category"
    )


def input_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_events(spark, sf_dir).filter("source_type = 'input'").select(
        "seq", "user_id", "timestamp", "event_end", "duration_seconds",
        F.col("k").cast("double").alias("presses"), (F.col("k") % 5).cast("double").alias("clicks"),
        (F.col("value") * 10).alias("mouse_distance"), F.col("value").alias("scroll_abs"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_events(spark, sf_dir).filter("source_type = 'request'").select("user_id", "timestamp")


def self_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as self-reports with seven scores; a seventh of each is missing."""
    orders = table(spark, sf_dir, "orders")
    base = F.col("o_totalprice") / 500000 * 6
    moment = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 86400) * 1_000_000
    return orders.select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.timestamp_micros(moment).cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("o_orderstatus") == "F", "streamdeck").otherwise("other").alias("answer_source"),
        *[
            F.when((F.col("o_orderkey") + i) % 7 != 0, F.round(base * (1.0 - i / 20.0), 3)).alias(t)
            for i, t in enumerate(TARGETS)
        ],
    )


def questionnaires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as raw answers."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    answers = {
        "q1_feelings": key % 7 - 3,
        "q2_intensity": key % 7,
        "q3_tiredness": cust % 7,
        "q4_enthusiasm": (key + 2) % 7,
        "q5_immersion": (cust + 3) % 7,
        "q8_stress": (key + cust) % 7,
        "q9_productivity": (key * 3) % 7,
    }
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"), *[v.cast("double").alias(n) for n, v in answers.items()]
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with the title taken from the markup."""
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title")
    )


def raw_tracker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as raw bucket events: three supported bucket types and two others,
    text timestamps with an offset, durations out of range, repeated heartbeats."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kind = (
        F.when(F.col("event_type") == "view", "web.tab.current")
        .when(F.col("event_type") == "click", "currentwindow")
        .when(F.col("event_type") == "purchase", "os.hid.input")
        .when(F.col("event_type") == "signup", "afkstatus")
        .otherwise("app.editor.activity")
    )
    data = F.to_json(
        F.struct(
            F.when(k % 11 == 0, "loginwindow").when(k % 7 == 0, "").otherwise(
                F.concat(F.lit("app"), (k % 9).cast("string"))).alias("app"),
            F.concat(F.lit("note "), (k % 13).cast("string")).alias("title"),
            F.concat(F.lit("https://www.site"), (k % 10).cast("string"), F.lit(".example.com/p")).alias("url"),
            k.cast("string").alias("presses"), (k % 5).alias("clicks"),
            (k % 3 * 3).alias("deltaX"), (k % 3 * 4).alias("deltaY"),
            (k % 4 - 2).alias("scrollX"), (-(k % 6)).alias("scrollY"),
            F.when(k % 2 == 0, k % 8).alias("tabCount"), (k % 5).alias("tab_count"), (k % 4 == 1).alias("audible"),
        )
    )
    base = e.select(
        F.concat(F.lit(" u"), F.expr("cast(user_id div 10 as string)"), F.lit(" ")).alias("user_id"),
        F.concat(F.lit("b-"), F.col("event_type")).alias("bucket"),
        kind.alias("type"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "host").alias("hostname"),
        F.when(k % 2 == 0, F.lit('{"hostname":"meta"}')).alias("bucket_data"),
        F.col("event_id").alias("event_id"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("timestamp"),
        F.round((F.col("value") - 5.0) * 600).cast("bigint").alias("seconds"), data.alias("data"),
    )
    copies = base.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("copy"))
    return copies.select(
        "user_id", "bucket", "type", "hostname", "bucket_data",
        (F.col("event_id") * 3 + F.col("copy")).alias("seq"), "timestamp",
        (F.col("seconds") + F.when(F.col("copy") == 1, 60).otherwise(0)).cast("string").alias("duration"),
        "data",
    )
