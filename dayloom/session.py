"""Session settings the engine relies on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files go when the execution that wrote them has ended, not when the driver collects garbage.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare_session(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on; leave cluster sizing alone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def build_session(app: str = "dayloom", master: str | None = None, **conf) -> SparkSession:
    """Create a session; AQE handles coalescing and skewed joins at run time."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set on first use."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
            "spark.checkpoint.dir", None
        )
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder the cluster names in ``spark.checkpoint.dir``."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files; for plans that nothing runs again."""
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def written_once(df: DataFrame) -> DataFrame:
    """The rows as a parquet table in the shared folder, for what many scans read in part."""
    folder = f"{_shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    with shuffles_released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shares(df: DataFrame, count: int, key: str = "user_id") -> list[DataFrame]:
    """The rows in ``count`` parts by the hash of ``key``, for work whose disk is to hold one part at a time."""
    place = F.pmod(F.xxhash64(key), F.lit(count))
    return [df] if count < 2 else [df.filter(place == k) for k in range(count)]
