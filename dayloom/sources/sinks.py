"""Results as date-partitioned parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(
    table: DataFrame, path: str, mode: str = "overwrite", writers: int | None = None, replace_all: bool = False,
) -> None:
    """Write rows partitioned by the date of ``timestamp``, clustered by user.

    Overwriting replaces the dates that ``table`` has and leaves all others, unless ``replace_all``.
    Users of a date are dealt to up to ``writers`` files by a hash and sorted in them, so reading one
    user prunes files by their statistics
    (default: as many writers as the session's shuffle partitions).
    """
    writers = writers or int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dated = table.withColumn("date", F.to_date("timestamp"))
    spread = F.pmod(F.xxhash64("user_id"), F.lit(writers))
    kept = "static" if replace_all else "dynamic"
    laid = dated.repartition("date", spread).sortWithinPartitions("date", "user_id", "timestamp")
    laid.write.mode(mode).option("partitionOverwriteMode", kept).partitionBy("date").parquet(path)
