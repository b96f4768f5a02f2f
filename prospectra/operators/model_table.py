"""Fitted models as tables, and native expressions that score with them.

A logistic model is one row per slot: the column, the level (text) or mean and
scale (number), and the coefficient; a row without a column is the intercept.
A tree is its node table (see ``tree``).  Such a table can be read, joined,
compared and kept like any other, and scoring needs no pipeline: numbers are a
sum of scaled products, a text column adds the coefficient of its level.
Columns with many levels are looked up by a broadcast join, since their levels
are bounded by what training accepts.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra import schema
from prospectra.functions.values import column, flag_at, missing_to_zero, text_or_zero
from prospectra.operators import metrics, model, prep, tree
from prospectra.sources import tables

LOGISTIC, TREE = "logistic", "exact_tree"
FAMILIES = (LOGISTIC, TREE)
# Levels that are looked up in an expression; beyond, a small table is broadcast.
INLINE_LEVELS = 64

_SLOTS = "slot int, column_name string, level string, mean double, scale double, coefficient double"


class ModelTable(NamedTuple):
    family: str
    rows: DataFrame


def logistic_table(fitted: PipelineModel, train: DataFrame, label: str = schema.LABEL, exclude: Sequence[str] = (schema.ID,)) -> DataFrame:
    """(slot, column_name, level, mean, scale, coefficient) of a fitted logistic pipeline; slot -1 is the intercept."""
    filler, scaler, last = fitted.stages[0], fitted.stages[1], fitted.stages[-1]
    numeric, text = scaler.numeric_columns(), filler.getOrDefault(filler.categorical)
    rows = [(i, c, None, float(m), float(s)) for i, (c, m, s) in enumerate(zip(
        numeric, scaler.getOrDefault(scaler.means), scaler.getOrDefault(scaler.scales)))]
    if text:
        # Levels in the order of their slots, column by column.
        for c, labels in zip(text, fitted.stages[2].labelsArray):
            rows += [(len(rows) + i, c, level, None, None) for i, level in enumerate(labels)]
    found = last.coefficients.toArray().tolist()
    if len(found) != len(rows):
        raise ValueError(f"{len(found)} coefficients for {len(rows)} slots")
    slots = [(*row, value) for row, value in zip(rows, found)]
    return train.sparkSession.createDataFrame([(-1, None, None, None, None, float(last.intercept)), *slots], _SLOTS)


def _logistic_score(df: DataFrame, slots: DataFrame) -> DataFrame:
    """``df`` with ``score``; the table's rows are as few as the vector has slots."""
    rows = slots.orderBy("slot").collect()
    total = F.lit(next(r.coefficient for r in rows if r.column_name is None))
    levels: dict[str, dict[str, float]] = {}
    for r in rows:
        if r.column_name is None:
            continue
        if r.level is None:
            total = total + (missing_to_zero(column(r.column_name)) - r.mean) / r.scale * r.coefficient
        else:
            levels.setdefault(r.column_name, {})[r.level] = r.coefficient
    names = df.columns
    for number, (name, values) in enumerate(levels.items()):
        if len(values) <= INLINE_LEVELS:
            found = F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), text_or_zero(column(name)))
        else:
            side = (slots.where(F.col("column_name") == name)
                    .select(F.col("level").alias(f"_level{number}"), F.col("coefficient").alias(f"_add{number}")))
            df = df.join(F.broadcast(side), text_or_zero(column(name)) == F.col(f"_level{number}"), "left")
            found = F.col(f"_add{number}")
        total = total + F.coalesce(found, F.lit(0.0))
    return df.select(*[column(c) for c in names], (1 / (1 + F.exp(-total))).alias(schema.SCORE))


def with_score(given: ModelTable, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The kept columns and the score of every row; raw columns in, no Python and no shuffle."""
    if given.family == LOGISTIC:
        return _logistic_score(df, given.rows).select(*[column(c) for c in keep], schema.SCORE)
    return df.select(*[column(c) for c in keep], tree.probability(tree.from_table(given.rows)).alias(schema.SCORE))


def score(given: ModelTable, df: DataFrame, id_col: str = schema.ID, threshold: float = schema.FLAG_THRESHOLD) -> DataFrame:
    """(id, score, flag)."""
    return with_score(given, df, (id_col,)).withColumn(schema.FLAG, flag_at(F.col(schema.SCORE), threshold))


def fit_all(train: DataFrame, label: str = schema.LABEL, exclude: Sequence[str] = (schema.ID,)) -> dict[str, ModelTable]:
    """Both families on a stored training side."""
    logistic = model.fit_all(train, label, exclude, families=("logistic",))["logistic"]
    nodes = tree.fit(train, label, exclude)
    return {LOGISTIC: ModelTable(LOGISTIC, logistic_table(logistic, train, label, exclude)),
            TREE: ModelTable(TREE, tree.node_table(train.sparkSession, nodes))}


def evaluate(models: dict[str, ModelTable], test: DataFrame, label: str = schema.LABEL) -> DataFrame:
    """family, rows, positives, roc_auc, average_precision on the given rows."""
    scored = [with_score(m, test, (label,)).withColumn("family", F.lit(family)) for family, m in models.items()]
    every = scored[0]
    for part in scored[1:]:
        every = every.unionByName(part)
    return metrics.ranking_metrics(every, label, by=("family",))


def select(models: dict[str, ModelTable], measured: DataFrame) -> ModelTable:
    """The family with the higher average precision; a tie keeps the logistic model."""
    return models[metrics.select_best(measured, FAMILIES).first().family]


def coefficients(given: ModelTable) -> DataFrame:
    """(feature, coefficient) of every slot of a logistic model."""
    return given.rows.where(F.col("column_name").isNotNull()).select(
        F.concat_ws("_", "column_name", "level").alias("feature"), "coefficient")


def save(given: ModelTable, name: str) -> None:
    """Keep a model as a catalog table; its family is a column."""
    tables.write_table(given.rows.withColumn("family", F.lit(given.family)), name)


def load(spark, name: str) -> ModelTable:
    rows = tables.read_table(spark, name)
    return ModelTable(rows.select("family").first().family, rows.drop("family"))
