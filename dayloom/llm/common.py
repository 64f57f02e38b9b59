"""Helpers shared by the text operators: tables, the shared folder, names, words."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One separator of words: the space and the control characters tab to carriage return.
SPACE = r"\x20\x09-\x0D"
#: The same six characters, for trimming.
SPACE_CHARS = " \t\n\x0b\f\r"
#: Bits of the filter in front of a look-up: so many for each key, and at most (a word of 64 is a row).
KEY_BITS, MOST_BITS = 32, 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines see, as the cluster names it; on one machine, under the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor sees")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return folder


def new_folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores before it where the table has such a column already."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text in order; none for an empty text or null."""
    trimmed = F.coalesce(F.btrim(text, F.lit(SPACE_CHARS)), F.lit(""))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{SPACE}]+")
    )


def bounded_batches(spark: SparkSession) -> None:
    """Let batches that go to Python hold 4 MB at most, unless the session sets a size itself.

    The default counts rows only: 10,000 long texts would be a batch of gigabytes.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def tasks_for(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def thinned(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``; none of the others goes.

    A bit map of the wanted keys, of ``MOST_BITS`` at most, is broadcast in words of 64 bits, so that a
    join that follows shuffles few rows in vain.
    """
    bits = min(MOST_BITS, 1 << (KEY_BITS * wanted.count()).bit_length())
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    mask = F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(`{key}`), 64) AS INT))")
    words = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(mask).alias("held"))
    known = rows.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(words), "word")
    return known.filter(F.col("held").bitwiseAND(mask) != 0).drop("word", "held")


def worker_memo(key: str, make: Callable):
    """A value that a Python worker keeps from task to task; it must not affect results.

    A worker keeps one value: another key takes the place of the one before, so that neither a
    long session nor the stages of a pipeline fill their workers.
    """
    kept = sys.modules.setdefault("_task_memo", types.ModuleType("_task_memo")).__dict__
    if kept.get("key") != key:
        release()
        kept["value"], kept["key"] = make(), key
    return kept["value"]


def release() -> None:
    """Drop what this worker keeps, and give back memory that nothing uses."""
    import gc

    import pyarrow as pa

    kept = sys.modules.setdefault("_task_memo", types.ModuleType("_task_memo")).__dict__
    kept["key"] = kept["value"] = None
    gc.collect()
    pa.default_memory_pool().release_unused()
