"""A1: raw tracker exports as one event table.

Raw events: user_id, bucket, type, hostname, seq, timestamp (text as written),
duration (text), data (JSON text). ``seq`` is the input order that decides ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "struct<timestamp:string,duration:string,data:string>"
_BUCKET = f"struct<type:string,hostname:string,data:string,events:array<{EVENT}>>"
BUCKET_SCHEMA = f"user_id string, buckets map<string,{_BUCKET}>"
RAW_SCHEMA = (
    "user_id string, bucket string, type string, hostname string, bucket_data string, "
    "seq bigint, timestamp string, duration string, data string"
)
_PER_BUCKET = 1 << 40


def read_raw_events(spark: SparkSession, path: str) -> DataFrame:
    """One event per JSON line: splittable, so a huge bucket spreads over many tasks."""
    return spark.read.schema(RAW_SCHEMA).json(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """One export per JSON line: ``{"user_id": ..., "buckets": {id: {..., "events": [...]}}}``."""
    return raw_events(spark.read.schema(BUCKET_SCHEMA).json(path))


def raw_events(exports: DataFrame) -> DataFrame:
    """Flatten exports (``BUCKET_SCHEMA``); exploded rows leave the export's task at the
    next shuffle, which is keyed by event and not by bucket."""
    buckets = exports.select(
        "user_id", F.posexplode(F.map_entries("buckets")).alias("bucket_no", "b")
    ).select("user_id", "bucket_no", F.col("b.key").alias("bucket"), "b.value.*")
    return buckets.select(
        "user_id", "bucket", "type", "hostname", F.col("data").alias("bucket_data"), "bucket_no",
        F.posexplode("events").alias("pos", "e"),
    ).select(
        "user_id", "bucket", "type", "hostname", "bucket_data",
        (F.col("bucket_no") * F.lit(_PER_BUCKET) + F.col("pos")).alias("seq"),
        "e.timestamp", "e.duration", "e.data",
    )


def bucket_types(exports: DataFrame) -> DataFrame:
    """(user_id, type) of every bucket, also empty ones, for the source check."""
    return exports.select("user_id", F.explode(F.map_values("buckets")).alias("b")).select(
        "user_id", F.coalesce("b.type", F.lit("")).alias("type")
    )
