"""Profiling of a wide table: one long relation of (column, value) feeds all of it.

Exploding happens inside the scan stage and every aggregate over it combines
map-side.  Numbers are described without their distinct values ever moving;
text is counted by value.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra import schema
from prospectra.functions.values import column, is_finite, is_missing, nan_to_null
from prospectra.operators.features import categorical_columns, numeric_columns
from prospectra.operators.narrowing import exact_quantiles
from prospectra.operators.ranks import stored

BINS = 30
TOP = 10

_POS, _NAME, _VALUE = "pos", "column_name", "value"


def _exploded(df: DataFrame, columns: Sequence[str], to: str, keep: Sequence[str]) -> DataFrame:
    """(keep..., pos, value): one row per cell.

    The position stands in for the column name until the results are small;
    exploding an array is about 1.6 times as fast as unpivot on 55 columns,
    whose projection list is too long to compile.
    """
    cells = F.array(*[column(c).cast(to) for c in columns])
    return df.select(*[column(k) for k in keep], F.posexplode(cells).alias(_POS, _VALUE))


def _named(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace the position by the column name, first in the row."""
    names = F.array(*[F.lit(c) for c in columns])
    return df.select(F.get(names, F.col(_POS)).alias(_NAME), *[column(c) for c in df.columns if c != _POS])


def long_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Cells as double, missing ones left out."""
    return _exploded(df, columns, "double", keep).where(nan_to_null(F.col(_VALUE)).isNotNull())


def long_text(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Cells as string, NULL left out."""
    return _exploded(df, columns, "string", keep).where(F.col(_VALUE).isNotNull())


def value_counts(long: DataFrame, by: Sequence[str] = (_POS,)) -> DataFrame:
    return long.groupBy(*by, _VALUE).agg(F.count("*").alias("n"))


def _missing_by_column(df: DataFrame) -> DataFrame:
    """(pos, rows, missing), one row per column."""
    # One plain aggregate, then one row to turn: half the time of counting exploded cells.
    counts = df.agg(F.count("*").alias("rows"), F.array(*[
        F.count_if(is_missing(column(f.name), f.dataType)) for f in df.schema.fields]).alias("all_missing"))
    return counts.select(F.posexplode("all_missing").alias(_POS, "missing"), "rows").select(_POS, "rows", "missing")


def class_distribution(df: DataFrame, label: str = schema.LABEL, digits: int = 2) -> DataFrame:
    """Rows and share in percent per label."""
    counts = df.groupBy(column(label).alias(label)).agg(F.count("*").alias("count"))
    share = F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy())
    return counts.select(column(label), "count", F.round(share, digits).alias("percentage"))


def imbalance_ratio(df: DataFrame, label: str = schema.LABEL) -> DataFrame:
    """One row: total, positives, negatives and negatives per positive."""
    counts = df.agg(F.count("*").alias("total"),
                    F.count_if(column(label) == 1).alias("positives"),
                    F.count_if(column(label) == 0).alias("negatives"))
    return counts.withColumn("ratio", F.when(
        F.col("positives") > 0, F.col("negatives") / F.col("positives")).otherwise(F.lit(float("inf"))))


def missing_counts(df: DataFrame) -> DataFrame:
    """Columns with missing values, most first."""
    found = _missing_by_column(df).where("missing > 0").select(_POS, "missing")
    return _named(found, df.columns).orderBy(F.desc("missing"), _NAME)


def column_info(df: DataFrame, exclude: Iterable[str] = (schema.ID, schema.LABEL)) -> DataFrame:
    """Type, kind and number of present values of every column."""
    numeric, text = set(numeric_columns(df, exclude)), set(categorical_columns(df, exclude))

    def kind(name: str) -> str:
        return "numeric" if name in numeric else "categorical" if name in text else "other"

    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    kinds = F.create_map(*[F.lit(x) for c in df.columns for x in (c, kind(c))])
    return _named(_missing_by_column(df), df.columns).select(
        _NAME, F.element_at(types, F.col(_NAME)).alias("dtype"), F.element_at(kinds, F.col(_NAME)).alias("kind"),
        (F.col("rows") - F.col("missing")).alias("non_null"))


def column_kinds(df: DataFrame, exclude: Iterable[str] = (schema.ID, schema.LABEL)) -> DataFrame:
    """How many columns, and present values in them, fall in each kind."""
    return (column_info(df, exclude).groupBy("kind")
            .agg(F.count("*").alias("columns"), F.sum("non_null").alias("non_null")))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column.

    Infinities are values: they show in min, max and mean, and make the
    standard deviation undefined, given as NULL.
    """
    columns = columns or numeric_columns(df)
    cells = long_numeric(df, columns)
    moments = cells.groupBy(_POS).agg(
        F.count("*").alias("count"), nan_to_null(F.avg(_VALUE)).alias("mean"), nan_to_null(F.stddev_samp(_VALUE)).alias("std"),
        F.min(_VALUE).alias("min"), F.max(_VALUE).alias("max"))
    # Only values near a quartile move: see ``narrowing``.
    quartiles = exact_quantiles(cells, _VALUE, (0.25, 0.5, 0.75), (_POS,))
    every = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias(_POS))
    found = every.join(moments, _POS, "left").join(quartiles, _POS, "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return _named(found, columns).select(
        _NAME, "count", "mean", "std", "min",
        *[F.get("quantiles", F.lit(i)).alias(q) for i, q in enumerate(("q25", "q50", "q75"))], "max")


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, distinct values, most frequent value and its frequency.

    By default covers text and date columns; of equally frequent values the
    smallest is named.
    """
    columns = columns or [f.name for f in df.schema.fields
                          if isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType))]
    found = (value_counts(long_text(df, columns)).groupBy(_POS)
             .agg(F.sum("n").alias("count"), F.count("*").alias("unique"),
                  F.min_by(_VALUE, F.struct(-F.col("n"), F.col(_VALUE))).alias("top"), F.max("n").alias("freq")))
    return _named(found, columns)


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """Equal-width bins per numeric column, empty bins included.

    The range is that of the finite values, since an infinite edge has no
    width; a constant column gets one unit around its value.
    """
    columns = columns or numeric_columns(df)
    long = long_numeric(df, columns).where(is_finite(F.col(_VALUE)))
    constant = F.col("_min") == F.col("_max")
    edges = (long.groupBy(_POS).agg(F.min(_VALUE).alias("_min"), F.max(_VALUE).alias("_max"))
             .select(_POS, F.when(constant, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
                     F.when(constant, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_hi")))
    place = F.least(F.floor((F.col(_VALUE) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))),
                    F.lit(bins - 1)).cast("int")
    # One row per column is broadcast, so binning happens in the scan stage.
    filled = long.join(F.broadcast(edges), _POS).groupBy(_POS, place.alias("bin")).agg(F.count("*").alias("_n"))
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return _named(grid.join(filled, [_POS, "bin"], "left"), columns).select(
        _NAME, "bin", (F.col("_lo") + width * F.col("bin")).alias("lower"),
        (F.col("_lo") + width * (F.col("bin") + 1)).alias("upper"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("count"))


def top_categories(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP) -> DataFrame:
    """The k most frequent values per text column; ties by value.

    The rank filter is pushed below the window's shuffle as a group limit, so
    each task sends at most k rows per column.
    """
    columns = columns or categorical_columns(df)
    order = Window.partitionBy(_POS).orderBy(F.desc("count"), _VALUE)
    top = (value_counts(long_text(df, columns)).withColumnRenamed("n", "count")
           .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return _named(top, columns)


_PAIR_SUMS = ("rows", "n", "mean_x", "mean_y", "c_xx", "c_yy", "c_xy", "min_x", "max_x", "min_y", "max_y")
_PAIR = ("column_a", "column_b")


def moment_state(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored summary of the finite numbers of a load, which can be merged with those of other loads.

    One row per column pair: ``rows`` of the load, ``n`` rows where both are
    finite, and over these the means, centred products and ranges.  A column
    paired with itself has its own count, moments and range.

    One aggregate per pair would be about a thousand for the customer table,
    too wide for compiled aggregation.  Instead each task adds up the pair sums
    of its rows by matrix products over Arrow batches and writes one row per
    pair; these are then merged in Spark.
    """
    columns = list(columns or numeric_columns(df))
    doubles = df.select(*[column(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    partials = doubles.mapInArrow(_pair_moments(len(columns)),
                                  "a int, b int, " + ", ".join(f"{s} double" for s in _PAIR_SUMS))
    names = F.array(*[F.lit(c) for c in columns])
    named = partials.select(F.get(names, F.col("a")).alias("column_a"), F.get(names, F.col("b")).alias("column_b"), *_PAIR_SUMS)
    return merge_moments(stored(named))


def merge_moments(states: DataFrame) -> DataFrame:
    """One stored state from the rows of several, by the rule for parts: products move to the common mean.

    ``states`` is a stored table or a union of such.  Both steps combine
    map-side; in between, one row per pair is broadcast, as many as the square
    of the columns.  A state of no rows changes nothing.
    """
    n = F.col("n")
    means = states.groupBy(*_PAIR).agg(*[
        (F.sum(n * F.col(m)) / F.nullif(F.sum("n"), F.lit(0.0))).alias(f"all_{m}") for m in ("mean_x", "mean_y")])
    off_x, off_y = (F.coalesce(F.col(m) - F.col(f"all_{m}"), F.lit(0.0)) for m in ("mean_x", "mean_y"))

    def moved(products: str, x: Column, y: Column) -> Column:
        return F.sum(F.col(products) + n * x * y).alias(products)

    merged = states.join(F.broadcast(means), list(_PAIR)).groupBy(*_PAIR).agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"),
        *[F.coalesce(F.first(f"all_{m}"), F.lit(0.0)).alias(m) for m in ("mean_x", "mean_y")],
        moved("c_xx", off_x, off_x), moved("c_yy", off_y, off_y), moved("c_xy", off_x, off_y),
        F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"))
    return stored(merged.select(*_PAIR, *_PAIR_SUMS))


def moments_of(state: DataFrame) -> DataFrame:
    """Per column: rows, finite values, the rest, mean, sample deviation and range of the finite ones."""
    own, n = state.where(F.col("column_a") == F.col("column_b")), F.col("n")
    value = lambda c: F.when(n > 0, F.col(c))
    return own.select(
        F.col("column_a").alias(_NAME), F.col("rows").cast("bigint").alias("rows"), n.cast("bigint").alias("count"),
        (F.col("rows") - n).cast("bigint").alias("missing"), value("mean_x").alias("mean"),
        F.when(n > 1, F.sqrt(F.col("c_xx") / (n - 1))).alias("std"), value("min_x").alias("min"), value("max_x").alias("max"))


def correlation_of(state: DataFrame) -> DataFrame:
    """Pearson correlation of every column pair of a state; NULL where a side is constant."""
    r = F.when(F.col("column_a") == F.col("column_b"), F.lit(1.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("c_xy", F.sqrt(F.col("c_xx") * F.col("c_yy"))))))
    varies = (F.col("min_x") < F.col("max_x")) & (F.col("min_y") < F.col("max_y"))
    return state.select(*_PAIR, F.when(varies, r).alias("correlation"))


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over rows where both are finite.

    NULL where a side is constant, that is where its smallest and largest value
    over the pair's rows are equal.  The matrix comes in long form, both
    triangles.
    """
    return correlation_of(moment_state(df, columns))


def _pair_moments(width: int):
    """The per-task function.  It is a closure, so it is sent by value and
    executors need not have this package."""
    names = ["a", "b", *_PAIR_SUMS]

    def ranges(raw, finite):
        """Smallest and largest finite value of column a over the rows where b is finite, as [a, b]."""
        low, high = np.where(finite, raw, np.inf), np.where(finite, raw, -np.inf)
        least = np.repeat(low.min(axis=0)[:, None], width, axis=1)
        most = np.repeat(high.max(axis=0)[:, None], width, axis=1)
        # Columns without a gap share the rows of all others, so only the rest are looked at one by one.
        for b in np.flatnonzero(~finite.all(axis=0)):
            rows = finite[:, b]
            least[:, b] = low[rows].min(axis=0, initial=np.inf)
            most[:, b] = high[rows].max(axis=0, initial=-np.inf)
        return least, most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, (n, mean, c_xx, c_xy) = 0, np.zeros((4, width, width))
        low, high = np.full((width, width), np.inf), np.full((width, width), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows += batch.num_rows
            raw = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
            finite = np.isfinite(raw)
            seen = finite.astype(float)
            # Each batch is centred on its own means, then merged by the rule for two parts.
            shift = np.where(finite, raw, 0.0).sum(axis=0) / np.maximum(finite.sum(axis=0), 1)
            x = np.where(finite, raw - shift, 0.0)
            more = seen.T @ seen
            s_x, some = x.T @ seen, np.maximum(more, 1)
            own_mean = np.where(more > 0, shift[:, None] + s_x / some, 0.0)
            total = n + more
            step = np.where((n > 0) & (more > 0), own_mean - mean, 0.0)
            weight = n * more / np.maximum(total, 1)
            c_xx += (x * x).T @ seen - s_x * s_x / some + step * step * weight
            c_xy += x.T @ x - s_x * s_x.T / some + step * step.T * weight
            mean = np.where(n > 0, mean + step * more / np.maximum(total, 1), own_mean)
            n = total
            least, most = ranges(raw, finite)
            low, high = np.minimum(low, least), np.maximum(high, most)
        if not rows:
            return
        a, b = np.indices((width, width)).reshape(2, -1).astype("int32")
        moments = [np.full((width, width), float(rows)), n, mean, mean.T, c_xx, c_xx.T, c_xy, low, high, low.T, high.T]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)] + [pa.array(t.ravel()) for t in moments],
                                         names=names)

    return run


def boxplot_stats(df: DataFrame, label: str = schema.LABEL, columns: Sequence[str] | None = None) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR and outliers, per numeric column and label.

    Whiskers end at the furthest value inside the fences, or at the quartile
    where no value lies between.
    """
    columns = columns or numeric_columns(df)
    by = (_POS, label)
    cells = long_numeric(df, columns, (label,))
    quartile = [F.get("quantiles", F.lit(i)) for i in range(3)]
    iqr = quartile[2] - quartile[0]
    fences = (exact_quantiles(cells, _VALUE, (0.25, 0.5, 0.75), by)
              .select(column(_POS).alias("_p"), column(label).alias("_l"),
                      *[q.alias(a) for q, a in zip(quartile, ("q1", "median", "q3"))],
                      (quartile[0] - 1.5 * iqr).alias("_lower"), (quartile[2] + 1.5 * iqr).alias("_upper")))
    value, inside = F.col(_VALUE), (F.col(_VALUE) >= F.col("_lower")) & (F.col(_VALUE) <= F.col("_upper"))
    met = (column(_POS) == F.col("_p")) & column(label).eqNullSafe(F.col("_l"))
    # One row per column and label is broadcast; whiskers and outliers are plain map-side aggregates.
    stats = (cells.join(F.broadcast(fences), met).groupBy(*map(column, by), "q1", "median", "q3")
             .agg(F.count("*").alias("count"),
                  F.min(F.when(inside, value)).alias("_lowest"), F.max(F.when(inside, value)).alias("_highest"),
                  F.count_if(~inside).alias("outliers"))
             .select(*map(column, by), "count", "q1", "median", "q3",
                     F.least("q1", "_lowest").alias("whisker_low"),
                     F.greatest("q3", "_highest").alias("whisker_high"), "outliers"))
    return _named(stats, columns)


def target_rate(df: DataFrame, label: str = schema.LABEL, columns: Sequence[str] | None = None,
                k: int = TOP) -> DataFrame:
    """Mean label per category, the k highest per column; ties by value."""
    columns = columns or categorical_columns(df)
    rates = (long_text(df, columns, (label,)).groupBy(_POS, _VALUE)
             .agg(F.avg(column(label)).alias("rate"), F.count("*").alias("count")))
    order = Window.partitionBy(_POS).orderBy(F.desc("rate"), _VALUE)
    return _named(rates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), columns)
