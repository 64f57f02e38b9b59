"""K: live events, by Structured Streaming into the activity store.

Heartbeats of one event keep arriving while it lasts, so an event is known when the watermark has
passed its begin: until then the longest of its copies is state. Finished events go to the store a
micro-batch at a time, which derives the timeline, hourly totals and readings of the days they
touch. A micro-batch is one run of the store under the batch's number, so that one which is run
again after a failure or a restart counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from dayloom.functions.categories import DEFAULT_RULES, Rule
from dayloom.functions.times import normalize_timestamp
from dayloom.operators.parse import dedupe_heartbeats, tables_of
from dayloom.plans.incremental import ActivityStore


def finished_events(raw: DataFrame, delay: str = "12 hours") -> DataFrame:
    """A3 + A5 of a stream of raw events (``RAW_SCHEMA``): each event once, when ``delay`` has gone by.

    Time is that of the newest valid event of any user. The state is one row for each event younger than
    the delay, keyed by the event itself, so no bucket or user is a hot key. A copy that comes later
    than the delay is dropped and counted (:func:`late_rows`); in a stream's lifetime an event is
    never given out twice. Events without a readable time are left out, as in a batch.
    """
    timed = raw.withColumn("event_time", normalize_timestamp("timestamp").cast("timestamp"))
    return dedupe_heartbeats(timed.withWatermark("event_time", delay), carried=("event_time",))


def live_store(
    raw: DataFrame, store: ActivityStore, checkpoint: str, name: str = "live", delay: str = "12 hours",
    rules: tuple[Rule, ...] = DEFAULT_RULES,
) -> DataStreamWriter:
    """A writer that adds the finished events of a stream to a store; ``start()`` it with any trigger.

    ``name`` has to stay the same as long as ``checkpoint`` does. One stream writes to a store.
    """

    def add(batch: DataFrame, number: int) -> None:
        kept = batch.drop("event_time").persist()
        try:
            tables = tables_of(kept, rules)
            store.extend(tables.window, tables.web, tables.input, batch=f"{name} {number}")
        finally:
            kept.unpersist()

    out = finished_events(raw, delay)
    return out.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(add)


def late_rows(query: StreamingQuery) -> int:
    """Groups of copies that came after the watermark, in the micro-batches the query remembers."""
    return sum(
        int(operator["numRowsDroppedByWatermark"]) for p in query.recentProgress for operator in p["stateOperators"]
    )
