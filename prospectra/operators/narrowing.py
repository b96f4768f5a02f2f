"""Exact quantiles by narrowing: only values near a wanted rank ever move.

A mergeable sketch gives each group up to ``FENCES`` cut points.  Rows are
counted between the cuts, and at each cut, map-side: a few hundred counts per
group.  The counts say exactly between which cuts a wanted rank lies.  What
lies there is narrowed again until it is one value or few enough rows to count
their values and order them.  The sketch decides how fast this goes, never the
result.  Each round divides the rows at hand by some hundreds, so a column of
10**12 different values takes four rounds, and no shuffle or file holds more
than the last round's rows.

The rows are read once per round, so they should come from a stored table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectra.functions.values import column
from prospectra.operators.ranks import search
from prospectra.session import write_and_read_back

FENCE_BITS = 8
# Rows around a wanted rank that are counted by value and ordered in one task.
MOST_ROWS = 200_000


def _is(by: Sequence[str], prefix: str) -> Column:
    """The group columns equal their prefixed copies; NULL is a group like others."""
    met = F.lit(True)
    for c in by:
        met = met & column(c).eqNullSafe(F.col(prefix + c))
    return met


def _prefixed(df: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[column(c).alias(prefix + c) for c in by], *[column(c) for c in df.columns if c not in by])


def _inside(rows: DataFrame, spans: DataFrame, value: Column, by: Sequence[str]) -> DataFrame:
    """Rows strictly inside one of the spans of their group, with the span's number; spans do not overlap."""
    met = _is(by, "_g_") & (F.col("_low").isNull() | (value > F.col("_low"))) & (F.col("_high").isNull() | (value < F.col("_high")))
    return rows.join(F.broadcast(_prefixed(spans, by, "_g_")), met).select(*[column(c) for c in by], "_span", value.alias("_v"))


def _counted(rows: DataFrame, by: Sequence[str], bits: int) -> DataFrame:
    """(by, _span, _place, _n, _min, _max, _low, _high): rows at and between the cuts of their span."""
    probs = [i / 2 ** bits for i in range(1, 2 ** bits)]
    keys = [*by, "_span"]
    cuts = write_and_read_back(rows.groupBy(*keys).agg(F.percentile_approx("_v", probs, 10 * 2 ** bits).alias("_cuts")), "fences")
    met = _is(by, "_c_") & (F.col("_span") == F.col("_at"))
    side = _prefixed(cuts.withColumnRenamed("_span", "_at"), by, "_c_")
    found = search("_cuts", F.col("_v"), bits)
    below = F.when(F.col("_found") > 0, F.element_at("_cuts", F.col("_found")))
    above = F.when(F.col("_found") < F.size("_cuts"), F.element_at("_cuts", F.col("_found") + 1))
    placed = rows.join(F.broadcast(side), met).withColumn("_found", found).select(
        *keys, (2 * F.col("_found") + F.coalesce((F.col("_v") > below).cast("int"), F.lit(1))).alias("_place"), "_v",
        below.alias("_below"), above.alias("_above"))
    return write_and_read_back(
        placed.groupBy(*keys, "_place").agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                            F.first("_below").alias("_below"), F.first("_above").alias("_above")), "fence-counts")


def exact_quantiles(rows: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], most_rows: int = MOST_ROWS,
                    fence_bits: int = FENCE_BITS) -> DataFrame:
    """Group columns and ``quantiles``, an array in the order of ``probs``, with linear interpolation.

    ``value`` is never NULL or NaN; a group without rows has no result row.
    """
    spark, at = rows.sparkSession, column(value)
    everything = rows.select(*[column(c) for c in by], F.lit(0).alias("_span"), at.alias("_v"))
    counts = _counted(everything, by, fence_bits)
    wanted = _ranks(counts, probs, by)
    done, spans = [], None
    while True:
        found = _located(wanted, counts, spans, by)
        done.append(found.where("_min = _max").select(*by, "_tag", F.col("_min").alias("_v")))
        left = found.where("_min < _max")
        widest = left.agg(F.max("_n")).first()[0]
        if widest is None:
            break
        # Wanted ranks that lie between the same two cuts share a span.
        numbered = left.select("*", F.dense_rank().over(Window.partitionBy(*by).orderBy("_from", "_place")).alias("_new"))
        wanted = write_and_read_back(numbered.select(*by, "_tag", F.col("_new").alias("_span"), "_rank"), "wanted-ranks")
        spans = write_and_read_back(numbered.groupBy(*by, F.col("_new").alias("_span")).agg(
            F.first("_low").alias("_low"), F.first("_high").alias("_high")), "spans")
        near = _inside(rows, spans, at, by)
        if widest <= most_rows:
            done.append(_ordered(near, wanted, by))
            break
        counts = _counted(near, by, fence_bits)
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return _interpolated(every, probs, by)


def _ranks(counts: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by, _tag, _span, _rank): the ranks below and above each quantile's position, from 1."""
    position = (F.col("_rows") - 1) * F.col("_p")
    sized = counts.groupBy(*by).agg(F.sum("_n").alias("_rows")).select(
        *by, "_rows", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"))
    tag = lambda side: F.struct(F.col("_i").alias("i"), F.lit(side).alias("side"), (position - F.floor(position)).alias("part"))
    return write_and_read_back(sized.select(*by, F.lit(0).alias("_span"), F.inline(F.array(
        F.struct(tag("lo").alias("_tag"), (F.floor(position) + 1).alias("_rank")),
        F.struct(tag("hi").alias("_tag"), (F.ceil(position) + 1).alias("_rank"))))), "wanted-ranks")


def _located(wanted: DataFrame, counts: DataFrame, spans: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Each wanted rank's place: its rows, range, the open span around it and the rank inside it.  A few rows per group."""
    lower = Window.partitionBy(*by, "_span").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    upto = counts.select("*", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
    if spans is None:
        bounded = upto.withColumns({"_low": F.col("_below"), "_high": F.col("_above")})
    else:
        outer = _prefixed(spans.select(*by, F.col("_span").alias("_at"), F.col("_low").alias("_lo"), F.col("_high").alias("_hi")), by, "_s_")
        bounded = (upto.join(F.broadcast(outer), _is(by, "_s_") & (F.col("_span") == F.col("_at")))
                   .withColumns({"_low": F.coalesce("_below", "_lo"), "_high": F.coalesce("_above", "_hi")}))
    places = bounded.select(*by, F.col("_span").alias("_from"), "_place", "_n", "_min", "_max", "_low", "_high", "_before")
    ranks = _prefixed(wanted, by, "_w_")
    met = _is(by, "_w_") & (F.col("_from") == F.col("_span")) & (F.col("_rank") > F.col("_before")) & (
        F.col("_rank") <= F.col("_before") + F.col("_n"))
    return write_and_read_back(
        places.join(F.broadcast(ranks), met).select(*by, "_tag", "_from", "_place", "_n", "_min", "_max", "_low", "_high",
                                                    (F.col("_rank") - F.col("_before")).alias("_rank")), "located-ranks")


def _ordered(near: DataFrame, wanted: DataFrame, by: Sequence[str]) -> DataFrame:
    """The values at the wanted ranks of each span, from the counts of the span's values in order."""
    counts = near.groupBy(*by, "_span", "_v").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_span").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = _prefixed(wanted.withColumnRenamed("_span", "_at"), by, "_w_")
    met = _is(by, "_w_") & (F.col("_span") == F.col("_at")) & (F.col("_rank") <= F.col("_upto")) & (
        F.col("_rank") > F.col("_upto") - F.col("_n"))
    return counts.withColumn("_upto", upto).join(F.broadcast(ranks), met).select(*by, "_tag", "_v")


def _interpolated(found: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    lo = F.max(F.when(F.col("_tag.side") == "lo", F.col("_v")))
    hi = F.max(F.when(F.col("_tag.side") == "hi", F.col("_v")))
    between = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.max("_tag.part"))
    return (found.groupBy(*by, F.col("_tag.i").alias("_i")).agg(between.alias("_q"))
            .groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "_q"))).alias("_iq"))
            .select(*by, F.transform("_iq", lambda s: s["_q"]).alias("quantiles")))
