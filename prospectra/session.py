"""Session construction and lineage cutting."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Set only where the caller builds a session here; a cluster's own values win
# because getOrCreate() returns the running session.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "prospectra", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session with adaptive execution on.

    ``conf`` keys use ``__`` for dots: ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(_DEFAULTS)
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can write to, as the cluster names it.

    A local session without the setting, as in tests, gets one fresh folder
    per process.  A cluster without it is an error: a machine-local folder
    would not be seen by the executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="prospectra-")


def write_and_read_back(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage by writing a parquet table to the shared folder.

    Preferred over ``checkpoint()`` because readers keep column pruning,
    partition pruning and file statistics, and a lost executor costs a re-read
    instead of a recomputation of the joins above it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(_read_schema(df, partition_by)).parquet(path)


def _read_schema(df: DataFrame, partition_by: tuple[str, ...]) -> StructType:
    """Schema as read back: partition columns come last."""
    fields = [f for f in df.schema.fields if f.name not in partition_by]
    fields += [df.schema[c] for c in partition_by]
    return StructType(fields)
