"""Catalog tables: write, copy, read, preview."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from prospectra.functions.values import column, quoted

DEFAULT_FORMAT = "parquet"


def write_table(df: DataFrame, name: str, fmt: str = DEFAULT_FORMAT, bucket_by: tuple[int, str] | None = None,
                sort_by: str | None = None) -> None:
    """Replace a managed table, taking over the frame's schema.

    ``bucket_by=(n, key)`` stores the rows in n buckets so that later joins and
    groupings on the key need no shuffle.  Use it for keys known to be even: a
    bucket is one task, so a hot key would not be split.
    ``sort_by`` orders rows inside files, which makes file statistics useful
    without a global sort.
    """
    if sort_by and not bucket_by:
        df = df.sortWithinPartitions(column(sort_by))
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "delta":
        writer = writer.option("mergeSchema", "true")
    if bucket_by:
        writer = writer.bucketBy(bucket_by[0], bucket_by[1]).sortBy(sort_by or bucket_by[1])
    writer.saveAsTable(name)


# Between a versioned table's name and its versions' numbers.
_VERSION = "__v"


def _parts(name: str) -> tuple[str, str]:
    """(database prefix with its dot, table) without back-ticks; a plain name has no prefix."""
    pieces = [p.strip("`") for p in name.split(".")]
    return "".join(f"{quoted(p)}." for p in pieces[:-1]), pieces[-1]


def versions(spark: SparkSession, name: str) -> list[str]:
    """The stored versions of a versioned table, oldest first."""
    prefix, table = _parts(name)
    shown = spark.sql("SHOW TABLES" + (f" IN {prefix[:-1]}" if prefix else "")).collect()
    start = f"{table}{_VERSION}".lower()
    return sorted(r.tableName for r in shown if not r.isTemporary and r.tableName.lower().startswith(start))


def swap_table(df: DataFrame, name: str, fmt: str = DEFAULT_FORMAT, keep: int = 2) -> str:
    """Replace ``name`` in one step; returns the version that it shows from now on.

    The rows are written as a version of their own, and then a view of that name
    is pointed at it by one catalog change.  Readers see the old rows or the new
    ones, never a mixture; a write that fails changes nothing.  A query that
    began before the change reads the version before, which is why the version
    shown before and the last ``keep`` stay; older ones, left over from failed
    writes too, are dropped.  Versions newer than this one belong to other writers.
    """
    spark = df.sparkSession
    prefix, table = _parts(name)
    if keep < 1:
        raise ValueError("the version just written has to stay")
    before = _shown(spark, name)
    version = f"{table}{_VERSION}{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"
    write_table(df, f"{prefix}{quoted(version)}", fmt)
    spark.sql(f"CREATE OR REPLACE VIEW {prefix}{quoted(table)} AS SELECT * FROM {prefix}{quoted(version)}")
    older = [v for v in versions(spark, name) if v.lower() <= version.lower()]
    for v in older[:-keep]:
        if v != before:
            spark.sql(f"DROP TABLE IF EXISTS {prefix}{quoted(v)}")
    return version


def _shown(spark: SparkSession, name: str) -> str | None:
    """The version that a versioned table shows; None where there is no such table."""
    prefix, table = _parts(name)
    if not spark.catalog.tableExists(f"{prefix}{quoted(table)}"):
        return None
    text = spark.sql(f"SHOW CREATE TABLE {prefix}{quoted(table)}").first()[0].lower()
    return next((v for v in versions(spark, name) if v.lower() in text), None)


def swap_back(spark: SparkSession, name: str) -> str:
    """Show the version before the present one again; returns it."""
    prefix, table = _parts(name)
    stored, shown = versions(spark, name), _shown(spark, name)
    at = stored.index(shown) if shown in stored else 0
    if not at:
        raise ValueError(f"{name} has no version before the present one")
    spark.sql(f"CREATE OR REPLACE VIEW {prefix}{quoted(table)} AS SELECT * FROM {prefix}{quoted(stored[at - 1])}")
    return stored[at - 1]


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def copy_table(spark: SparkSession, source: str, target: str, fmt: str = DEFAULT_FORMAT) -> None:
    """All rows and columns of one table as another, replacing it."""
    write_table(read_table(spark, source), target, fmt)


def create_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    quoted_name = ".".join(quoted(part.strip("`")) for part in name.split("."))
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted_name}{place}")


def list_catalogs(spark: SparkSession) -> list[str]:
    return [c.name for c in spark.catalog.listCatalogs()]


def preview(df: DataFrame, order_by: str, n: int = 10) -> DataFrame:
    """The first n rows by a key, so that repeated previews agree."""
    return df.orderBy(column(order_by)).limit(n)
