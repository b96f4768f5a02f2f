"""Exact order statistics and running totals without one big sort.

Input is a frame of value counts: one row per (group, value) with how often it
occurs.  Hot values are one row each by then.  Values are put into buckets by
cut points, the buckets are totalled, and the window that needs an order runs
inside one bucket only.  Cut points come from a bounded sketch; they decide how
even the buckets are and never change a result, because a bucket is a function
of the value alone, not of a partition number.

The counts are read several times (cut points, bucket totals, ordered pass), so
callers store them first with ``stored``: whatever they were counted from runs
once, and a lost executor costs a re-read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectra.functions.values import column
from prospectra.session import write_and_read_back

# Distinct values that a bucket should hold, and the fewest and most bits of buckets per group.
BUCKET_ROWS = 50_000
_LEAST_BITS, _MOST_BITS = 4, 14
# Sketches of a group that are merged side by side before the last merge.
PARTS = 16


def bucket_bits(rows: int, target: int) -> int:
    """As many buckets as the counts need, a power of two."""
    return min(_MOST_BITS, max(_LEAST_BITS, math.ceil(math.log2(max(rows / target, 1)))))


def stored(counts: DataFrame) -> DataFrame:
    return write_and_read_back(counts, "value-counts")


def bucketed(counts: DataFrame, value: str, by: Sequence[str], target: int | None = None) -> DataFrame:
    """Add ``_bucket``: the number of cut points at or below the value.

    The number of cut points follows the number of stored counts.  Sketches
    are merged per group and part first, then per group, and the cut points are
    stored, so that every reader of the buckets gets the same ones.
    """
    bits = bucket_bits(counts.count(), target or BUCKET_ROWS)
    probs = [i / 2 ** bits for i in range(1, 2 ** bits)]
    # Equal steps through each part's values, then through all parts' steps: close to even is enough.
    part = F.pmod(F.xxhash64(column(value)), F.lit(PARTS)).alias("_part")
    steps = (counts.select(*by, part, column(value).alias("_v")).groupBy(*by, "_part")
             .agg(F.percentile_approx("_v", probs, 10 * 2 ** bits).alias("_steps")))
    cuts = write_and_read_back(
        steps.select(*by, F.explode("_steps").alias("_v")).groupBy(*by)
        .agg(F.percentile_approx("_v", probs, 10 * 2 ** bits).alias("_cuts")), "cut-points")
    return (counts.join(cuts, list(by))
            .withColumn("_bucket", search("_cuts", column(value), bits)).drop("_cuts"))


def search(cuts: str, value: Column, bits: int) -> Column:
    """Binary search for the number of sorted cut points <= value."""
    def step(found: Column, width: Column) -> Column:
        probe = found + width
        return F.when(F.element_at(cuts, probe) <= value, probe).otherwise(found)

    return F.aggregate(F.array(*[F.lit(2 ** b) for b in reversed(range(bits))]), F.lit(0), step)


def _bucket_offsets(placed: DataFrame, sums: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per bucket, the totals of all lower buckets (at most ``2 ** 14`` rows per group)."""
    totals = placed.groupBy(*by, "_bucket").agg(*[F.sum(column(s)).alias(f"_total_{s}") for s in sums])
    lower = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, "_bucket", *[f"_total_{s}" for s in sums], *[
        F.coalesce(F.sum(f"_total_{s}").over(lower), F.lit(0)).alias(f"_before_{s}") for s in sums])


def running_totals(counts: DataFrame, value: str, sums: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Add ``upto_<s>``: the total of ``s`` over all rows of the group with a
    value up to and including this one.  Values must be unique per group."""
    placed = bucketed(counts, value, by)
    offsets = _bucket_offsets(placed, sums, by)
    within = (Window.partitionBy(*by, "_bucket").orderBy(column(value))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = placed.select("*", *[F.sum(column(s)).over(within).alias(f"_within_{s}") for s in sums])
    return (ranked.join(F.broadcast(offsets), [*by, "_bucket"])
            .select(*counts.columns, *[
                (F.col(f"_before_{s}") + F.col(f"_within_{s}")).alias(f"upto_{s}") for s in sums]))


def values_at_ranks(counts: DataFrame, value: str, n: str, ranks: DataFrame, by: Sequence[str],
                    tags: Sequence[str] = ("tag",)) -> DataFrame:
    """The values that stand at given 1-based ranks of each group.

    ``ranks`` has the group columns, the ``tags`` and ``rank``; it must be
    small.  Only buckets that hold a wanted rank are shuffled and sorted.
    Returns the group columns, the tags and the value.
    """
    placed = bucketed(counts, value, by)
    offsets = _bucket_offsets(placed, [n], by)
    inside = ((F.col("rank") > F.col(f"_before_{n}"))
              & (F.col("rank") <= F.col(f"_before_{n}") + F.col(f"_total_{n}")))
    wanted = (offsets.join(F.broadcast(ranks), list(by)).where(inside).groupBy(*by, "_bucket")
              .agg(F.collect_list(F.struct(*tags, (F.col("rank") - F.col(f"_before_{n}")).alias("at"))).alias("_wanted")))
    within = Window.partitionBy(*by, "_bucket").orderBy(column(value))
    upto = F.sum(column(n)).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = (placed.join(F.broadcast(wanted), [*by, "_bucket"])
            .withColumn("_upto", upto)
            .withColumn("_hit", F.filter("_wanted", lambda w: (w["at"] <= F.col("_upto"))
                                         & (w["at"] > F.col("_upto") - column(n)))))
    return hits.select(*by, F.explode("_hit").alias("_hit"), column(value)).select(
        *by, *[F.col("_hit")[t].alias(t) for t in tags], column(value))


def quantiles(counts: DataFrame, value: str, n: str, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Exact quantiles with linear interpolation: group columns and ``quantiles``,
    an array in the order of ``probs``.  ``counts`` should be stored."""
    position = (F.col("_n") - 1) * F.col("p")
    sized = (counts.groupBy(*by).agg(F.sum(column(n)).alias("_n"))
             .withColumn("p", F.explode(F.array(*[F.lit(p) for p in probs]))))
    ranks = (sized.select(*by, "p", F.explode(F.array(
                F.struct(F.lit("lo").alias("side"), F.floor(position).alias("r")),
                F.struct(F.lit("hi").alias("side"), F.ceil(position).alias("r")))).alias("_r"),
                (position - F.floor(position)).alias("fraction"))
             .select(*by, "p", "fraction", F.col("_r.side").alias("side"), (F.col("_r.r") + 1).alias("rank")))
    found = values_at_ranks(counts, value, n, ranks, by, ("p", "fraction", "side"))
    lo = F.max(F.when(F.col("side") == "lo", column(value)))
    hi = F.max(F.when(F.col("side") == "hi", column(value)))
    between = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.max("fraction"))
    return (found.groupBy(*by, "p").agg(between.alias("q"))
            .groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("p", "q"))).alias("_pq"))
            .select(*by, F.transform("_pq", lambda s: s["q"]).alias("quantiles")))
