"""Preparation of features: imputation, scaling, one-hot levels, class weights.

The stages are ``pyspark.ml`` stages so that a fitted model carries them and
can be saved; inside they are built-in column expressions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra import schema
from prospectra.functions.values import column, missing_to_zero, text_or_zero
from prospectra.operators.features import categorical_columns, numeric_columns, reject_untyped
from prospectra.session import write_and_read_back

# Columns per aggregate: longer lists no longer compile to one fast method.
STATISTICS_PER_AGGREGATE = 15
# Levels that a text column may have; each is a slot of the vector and a value on the driver.
MOST_LEVELS = 10_000
FEATURES = "features"
WEIGHT = "class_weight"


class _NumericColumns(Params):
    """Shared parameter: the numeric columns a stage works on."""

    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)

    def numeric_columns(self) -> list[str]:
        return self.getOrDefault(self.numeric)


class MissingValueFiller(Transformer, _NumericColumns, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers: NULL and NaN to 0, as double.  Text: NULL to '0'."""

    categorical = Param(Params._dummy(), "categorical", "text columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, numeric: list[str] | None = None, categorical: list[str] | None = None):
        super().__init__()
        self._setDefault(numeric=[], categorical=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = {c: missing_to_zero(column(c)) for c in self.numeric_columns()}
        filled.update({c: text_or_zero(column(c)) for c in self.getOrDefault(self.categorical)})
        return dataset.select(*[filled[c].alias(c) if c in filled else column(c) for c in dataset.columns])


class PopulationScaler(Estimator, _NumericColumns, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / population deviation; a constant column becomes 0.

    ``pyspark.ml``'s own scaler divides by the sample deviation.
    """

    @keyword_only
    def __init__(self, *, numeric: list[str] | None = None):
        super().__init__()
        self._setDefault(numeric=[])
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        columns = self.numeric_columns()
        means, scales = [], []
        for start in range(0, len(columns), STATISTICS_PER_AGGREGATE):
            chunk = columns[start:start + STATISTICS_PER_AGGREGATE]
            row = dataset.agg(*[f(column(c)) for f in (F.avg, F.stddev_pop) for c in chunk]).first()
            means += [m if m is not None else 0.0 for m in row[:len(chunk)]]
            scales += [s or 1.0 for s in row[len(chunk):]]
        return PopulationScalerModel(numeric=columns, means=means, scales=scales)


class PopulationScalerModel(Model, _NumericColumns, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "means", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "divisors", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, numeric: list[str] | None = None, means: list[float] | None = None,
                 scales: list[float] | None = None):
        super().__init__()
        self._setDefault(numeric=[], means=[], scales=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scaled = {c: (column(c) - m) / s for c, m, s in zip(
            self.numeric_columns(), self.getOrDefault(self.means), self.getOrDefault(self.scales))}
        return dataset.select(*[scaled[c].alias(c) if c in scaled else column(c) for c in dataset.columns])


def standardize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill and scale the numeric columns of ``df`` by its own statistics."""
    columns = list(columns or numeric_columns(df))
    filled = MissingValueFiller(numeric=columns).transform(df)
    return PopulationScaler(numeric=columns).fit(filled).transform(filled)


def impute(df: DataFrame) -> DataFrame:
    return MissingValueFiller(numeric=numeric_columns(df), categorical=categorical_columns(df)).transform(df)


def one_hot_long(df: DataFrame, id_col: str = schema.ID, columns: Sequence[str] | None = None) -> DataFrame:
    """(id, feature, value): one row per set level, named ``column_level``; missing is level '0'."""
    columns = list(columns or categorical_columns(df))
    levels = F.array(*[F.concat(F.lit(f"{c}_"), text_or_zero(column(c))) for c in columns])
    return df.select(column(id_col), F.explode(levels).alias("feature"), F.lit(1.0).alias("value"))


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, levels): distinct values per text column, missing counted as one, found in one distributed pass."""
    names = F.array(*[F.lit(c) for c in columns])
    cells = df.select(F.posexplode(F.array(*[text_or_zero(column(c)) for c in columns])).alias("pos", "value"))
    return (cells.groupBy("pos", "value").agg(F.lit(1).alias("one")).groupBy("pos").agg(F.count("*").alias("levels"))
            .select(F.get(names, F.col("pos")).alias("column_name"), "levels"))


def check_levels(df: DataFrame, columns: Sequence[str], most: int = MOST_LEVELS) -> None:
    """Raise, naming the columns, where one has more than ``most`` levels."""
    wide = level_counts(df, columns).where(F.col("levels") > most).orderBy("column_name").collect() if columns else []
    if wide:
        raise ValueError(f"more than {most} levels: " + ", ".join(f"{r.column_name} ({r.levels})" for r in wide))


def preparation_stages(df: DataFrame, exclude: Sequence[str] = (schema.ID, schema.LABEL),
                       most_levels: int = MOST_LEVELS) -> list:
    """Stages from raw columns to the vector ``features``: numbers first, then levels.

    The level lists of the text columns are the only thing that reaches the
    driver; a column with more than ``most_levels`` is refused first.  A level not seen in training has all its slots at zero: indexing
    keeps it as an extra last level and encoding drops the last.
    """
    reject_untyped(df, exclude)
    numeric, text = numeric_columns(df, exclude), categorical_columns(df, exclude)
    check_levels(df, text, most_levels)
    stages = [MissingValueFiller(numeric=numeric, categorical=text), PopulationScaler(numeric=numeric)]
    indexed, encoded = [f"{c}__index" for c in text], [f"{c}__levels" for c in text]
    if text:
        stages += [StringIndexer(inputCols=text, outputCols=indexed, stringOrderType="alphabetAsc",
                                 handleInvalid="keep"),
                   OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True)]
    return stages + [VectorAssembler(inputCols=numeric + encoded, outputCol=FEATURES)]


def class_weights(df: DataFrame, label: str = schema.LABEL) -> DataFrame:
    """(label, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(column(label).alias(label)).agg(F.count("*").alias("count"))
    totals = counts.agg(F.struct(F.sum("count").alias("rows"), F.count("*").alias("classes")).alias("t")).scalar()
    return (counts.withColumn("_t", totals)
            .select(column(label), "count",
                    (F.col("_t.rows") / (F.col("_t.classes") * F.col("count"))).alias("weight")))


def with_class_weights(df: DataFrame, label: str = schema.LABEL) -> DataFrame:
    """Add the balanced weight of the row's class; one row per class is broadcast."""
    weights = class_weights(df, label).select(column(label), F.col("weight").alias(WEIGHT))
    return df.join(F.broadcast(weights), label)


class LeftOut(NamedTuple):
    """The preparation fitted on all folds but one, the weight of each class there and the rows that have one."""
    stages: PipelineModel
    weights: dict[object, float]
    rows: int


def leave_one_out(df: DataFrame, fold: str, folds: Sequence[int], label: str = schema.LABEL,
                  exclude: Sequence[str] = (schema.ID,), most_levels: int = MOST_LEVELS) -> list[LeftOut]:
    """For each fold, what ``preparation_stages`` and ``class_weights`` give when fitted on the others.

    All folds share their passes: moments, levels and classes are found once
    per fold and merged for every choice of the others.  One row per fold and
    chunk of columns reaches the driver, and the level lists.
    """
    exclude = (*exclude, label, fold)
    reject_untyped(df, exclude)
    numeric, text = numeric_columns(df, exclude), categorical_columns(df, exclude)
    classes = df.groupBy(column(fold).alias("fold"), column(label).alias("class")).agg(F.count("*").alias("n")).collect()
    filler = MissingValueFiller(numeric=numeric, categorical=text)
    filled = filler.transform(df)
    levels = _levels_without(filled, fold, folds, text, most_levels)
    moments = _moments_by_fold(filled, fold, numeric)
    indexed, encoded = [f"{c}__index" for c in text], [f"{c}__levels" for c in text]
    found = []
    for left_out in folds:
        counts: dict[object, int] = {}
        for r in classes:
            if r["fold"] is not None and r["fold"] != left_out:
                counts[r["class"]] = counts.get(r["class"], 0) + r["n"]
        weights = {c: sum(counts.values()) / (len(counts) * n) for c, n in counts.items() if c is not None}
        scaled = [merged_moments([m[c] for f, m in moments.items() if f != left_out]) for c in range(len(numeric))]
        stages = [filler, PopulationScalerModel(numeric=numeric, means=[m for m, _ in scaled],
                                                scales=[s or 1.0 for _, s in scaled])]
        if text:
            indexers = PipelineModel(stages=[
                StringIndexerModel.from_labels(own, inputCol=c, outputCol=i, handleInvalid="keep")
                for own, c, i in zip(levels[left_out], text, indexed)])
            # Sizes come from the indexers' metadata, so that no row is read.
            encoder = OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True)
            stages += [*indexers.stages, encoder.fit(indexers.transform(filled.limit(0)))]
        stages.append(VectorAssembler(inputCols=numeric + encoded, outputCol=FEATURES))
        found.append(LeftOut(PipelineModel(stages=stages), weights, sum(counts[c] for c in weights)))
    return found


def _moments_by_fold(filled: DataFrame, fold: str, columns: Sequence[str]) -> dict[int, list[tuple[int, float, float]]]:
    """Per fold and column (rows, mean, population deviation)."""
    found: dict[int, list[tuple[int, float, float]]] = {}
    for start in range(0, len(columns), STATISTICS_PER_AGGREGATE):
        chunk = columns[start:start + STATISTICS_PER_AGGREGATE]
        size = len(chunk)
        rows = (filled.where(column(fold).isNotNull()).groupBy(column(fold))
                .agg(F.count("*"), *[f(column(c)) for f in (F.sum, F.stddev_pop, F.max) for c in chunk]).collect())
        for key, n, *values in rows:
            sums, deviations, highest = values[:size], values[size:2 * size], values[2 * size:]
            # Where all values are equal the mean is that value, without the rounding of a sum.
            found.setdefault(key, []).extend(
                (n, top if not deviation else total / n, deviation)
                for total, deviation, top in zip(sums, deviations, highest))
    return found


def merged_moments(parts: Sequence[tuple[int, float, float]]) -> tuple[float, float]:
    """Mean and population deviation of all rows, from (rows, mean, population deviation) of each part.

    Equal means merge without rounding, so a constant column keeps the deviation 0.
    """
    n = sum(p[0] for p in parts)
    if not n:
        return 0.0, 0.0
    first = parts[0][1]
    mean = first + sum(rows * (m - first) for rows, m, _ in parts) / n
    return mean, math.sqrt(sum(rows * (d * d + (m - mean) ** 2) for rows, m, d in parts) / n)


def _levels_without(filled: DataFrame, fold: str, folds: Sequence[int], columns: Sequence[str],
                    most: int) -> dict[int, list[list[str]]]:
    """For each fold, the sorted levels of every column in the other folds; too many are refused before they are collected."""
    if not columns:
        return {k: [] for k in folds}
    cells = (filled.where(column(fold).isNotNull())
             .select(column(fold).alias("fold"), F.posexplode(F.array(*[column(c) for c in columns])).alias("pos", "value")))
    seen = write_and_read_back(cells.groupBy("pos", "value").agg(F.collect_set("fold").alias("folds")), "levels")

    def without(k: int):
        return F.exists("folds", lambda f: f != k)

    sizes = seen.groupBy("pos").agg(*[F.count_if(without(k)) for k in folds]).orderBy("pos").collect()
    for at in range(1, len(folds) + 1):
        wide = sorted((columns[r[0]], r[at]) for r in sizes if r[at] > most)
        if wide:
            raise ValueError(f"more than {most} levels: " + ", ".join(f"{c} ({n})" for c, n in wide))
    # In the order of the indexer, which compares UTF-16 units.
    rows = sorted(seen.collect(), key=lambda r: r["value"].encode("utf-16-be", "surrogatepass"))
    return {k: [[r["value"] for r in rows if r["pos"] == at and any(f != k for f in r["folds"])]
                for at in range(len(columns))] for k in folds}


def class_weight(label: str, weights: dict[object, float]):
    """The weight of the row's class as an expression; NULL for a label that has none."""
    return F.coalesce(*[F.when(column(label) == c, F.lit(w)) for c, w in weights.items()], F.lit(None).cast("double"))
