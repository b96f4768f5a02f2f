"""A left join that stays balanced when one key holds much of either side."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.functions.values import quoted
from prospectra.session import write_and_read_back

HOT_SHARE = 0.001
SLICES = 256


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Every key that holds more than ``share`` of the rows.

    Two passes: the frequent-items summary names at most ``1 / share`` keys, also
    where no key is frequent, and those are counted.
    """
    keys = df.where(F.col(quoted(key)).isNotNull()).select(F.col(quoted(key)).alias("_key"))
    named = keys.stat.freqItems(["_key"], share).first()[0]
    if not named:
        return []
    counts = keys.groupBy(F.when(F.col("_key").isin(named), F.col("_key")).alias("_key")).count().collect()
    rows = sum(r["count"] for r in counts)
    return [r["_key"] for r in counts if r["_key"] is not None and r["count"] > share * rows]


def balanced_left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                       hot_share: float = HOT_SHARE, slices: int = SLICES, unique_right: bool = False) -> DataFrame:
    """``left LEFT JOIN right``, with hot keys of either side spread over ``slices`` tasks.

    Rows go one of three ways, and the results are put together:

    - NULL keys match nothing and never move;
    - keys that are hot on neither side join as they are;
    - rows of hot keys are written, so that their place in the stored table
      can number them: equal rows differ in it, and a retried task reads the
      same numbers again.  Left rows are dealt over one side of a grid of
      slices and repeated along the other, right rows the other way round.
      The grid's shape follows the measured counts, so the smaller side is
      the one that is repeated.

    Both sides should be stored tables, as their keys are looked at first;
    ``unique_right`` says that no right key repeats and spares that pass.  The
    two sides must not share column names; callers alias what could clash.
    """
    key, other = F.col(quoted(left_key)), F.col(quoted(right_key))
    hot = sorted({*hot_keys(left, left_key, hot_share), *([] if unique_right else hot_keys(right, right_key, hot_share))})
    cold_left, cold_right = left.where(key.isNotNull()), right.where(other.isNotNull())
    if hot:
        cold_left, cold_right = cold_left.where(~key.isin(hot)), cold_right.where(~other.isin(hot))
    parts = [cold_left.join(cold_right, key == other, "left"), _unmatched(left.where(key.isNull()), right)]
    if hot:
        parts += _hot_parts(left.where(key.isin(hot)), right.where(other.isin(hot)), left_key, right_key, slices)
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return joined


def _unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows with NULLs for the right columns."""
    return left.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields])


def _hot_parts(left: DataFrame, right: DataFrame, left_key: str, right_key: str, slices: int) -> list[DataFrame]:
    left, right = write_and_read_back(left, "hot-left"), write_and_read_back(right, "hot-right")
    key, other = F.col(quoted(left_key)), F.col(quoted(right_key))
    # No more rows than there are hot keys.
    matched = [r[0] for r in right.select(other).distinct().collect()]
    parts = [_unmatched(left.where(~key.isin(matched)), right)]
    if matched:
        rows, columns = _grid(left.count(), right.count(), slices)
        # Rows are numbered first and repeated afterwards: all copies of a row keep its number.
        at = F.monotonically_increasing_id()
        dealt_left = (left.where(key.isin(matched)).withColumn("_left_row", F.pmod(at, F.lit(rows)).cast("int"))
                      .select("*", _every(columns).alias("_left_column")))
        dealt_right = (right.withColumn("_right_column", F.pmod(at, F.lit(columns)).cast("int"))
                       .select("*", _every(rows).alias("_right_row")))
        met = ((key == other) & (F.col("_left_row") == F.col("_right_row"))
               & (F.col("_left_column") == F.col("_right_column")))
        parts.append(dealt_left.join(dealt_right, met).drop("_left_row", "_left_column", "_right_row", "_right_column"))
    return parts


def _grid(left_rows: int, right_rows: int, slices: int) -> tuple[int, int]:
    """Sides of the grid: left rows are repeated once per column, right rows once per row."""
    ratio = max(left_rows, 1) / max(right_rows, 1)
    rows = min(slices, max(1, round(math.sqrt(slices * ratio))))
    return rows, max(1, slices // rows)


def _every(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
