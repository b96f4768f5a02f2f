"""Split, train both families, compare and keep the better; cross-validation."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra import schema
from prospectra.functions.values import column
from prospectra.operators import features, metrics, model, prep, split
from prospectra.session import write_and_read_back
from prospectra.sources import model_store


# Tasks that write one fold of one side.
FILES_PER_FOLD = 64


class Trained(NamedTuple):
    model: PipelineModel
    family: str
    metrics: DataFrame
    inputs: DataFrame


def require_binary(table: DataFrame, label: str) -> None:
    """Raise unless every label is 0 or 1: other rows would shift the class weights and vanish."""
    odd = table.agg(F.count_if(F.coalesce(~column(label).isin(0, 1), F.lit(True)))).first()[0]
    if odd:
        raise ValueError(f"{odd} rows have a label in '{label}' that is neither 0 nor 1")


def split_table(table: DataFrame, label: str = schema.LABEL, id_col: str = schema.ID,
                exact: bool = True) -> DataFrame:
    """The cleaned table with ``is_test`` and ``fold``, stored by both.

    ``exact`` holds the class shares of both sides, and of the folds of each
    side, to one id; without it both are drawn by a hash of the id.  Labels
    must be 0 or 1.

    Storing cuts lineage for the many passes of training, and reading one side
    of the split or four of five folds skips the other directories.
    Infinities become 0 here: they have no mean to scale by.
    """
    features.require_columns(table, (label, id_col))
    require_binary(table, label)
    cleaned = features.clean_values(table, (id_col, label))
    if exact:
        marked = split.folds_exact(split.split_exact(cleaned, label, id_col), label, id_col, within="is_test")
    else:
        marked = split.assign_folds(split.split_by_hash(cleaned, id_col), id_col)
    # Rows of a directory come together first, so that each task does not write a file into every one.
    spread = F.pmod(split.order_key(id_col, split.SEED), F.lit(FILES_PER_FOLD))
    return write_and_read_back(marked.repartition("is_test", "fold", spread), "split", ("is_test", "fold"))


def side(stored: DataFrame, is_test: int) -> DataFrame:
    return stored.where(F.col("is_test") == is_test).drop("is_test", "fold")


def train_and_select(stored: DataFrame, label: str = schema.LABEL, id_col: str = schema.ID,
                     exclude: Sequence[str] | None = None) -> Trained:
    """Fit both families on the training side, measure on the test side, keep the better.

    By average precision; a tie or no value keeps the logistic model.  Each
    family is fitted once.
    """
    exclude = (id_col,) if exclude is None else tuple(exclude)
    train, test = side(stored, 0), side(stored, 1)
    models = model.fit_all(train, label, exclude)
    measured = write_and_read_back(model.evaluate(models, test, label), "metrics")
    best = metrics.select_best(measured, model.FAMILIES).first()
    return Trained(models[best.family], best.family, measured, train)


def cross_validate(stored: DataFrame, label: str = schema.LABEL, id_col: str = schema.ID,
                   exclude: Sequence[str] | None = None, families: Iterable[str] = model.FAMILIES,
                   parallelism: int = split.FOLDS) -> DataFrame:
    """(family, fold, rows, positives, roc_auc, average_precision) on the training side.

    Preparation and class weights are those of the other four folds, merged
    from one set of passes that all folds share (``prep.leave_one_out``).
    Folds do not depend on each other, so ``parallelism`` of them are fitted
    at the same time; lower it where their cached vectors crowd the executors.
    A held-out row is prepared once for all families, and the scores of all
    held-out folds are ranked in one pass at the end.
    """
    exclude = (id_col,) if exclude is None else tuple(exclude)
    families = tuple(families)
    training = stored.where(F.col("is_test") == 0).drop("is_test")

    prepared = prep.leave_one_out(training, "fold", range(split.FOLDS), label, exclude)

    def fit_fold(fold: int) -> dict[str, PipelineModel]:
        others = training.where(F.col("fold") != fold)
        return model.fit_prepared(model.prepare_left_out(others, prepared[fold], label), families)

    with ThreadPoolExecutor(parallelism) as pool:
        fitted = list(pool.map(inheritable_thread_target(stored.sparkSession)(fit_fold), range(split.FOLDS)))
    held_out = [model.with_scores(fitted[fold], training.where(F.col("fold") == fold), (label, "fold"))
                for fold in range(split.FOLDS)]
    return metrics.ranking_metrics(functools.reduce(DataFrame.unionByName, held_out), label, by=("family", "fold"))


def run_training_job(spark: SparkSession, feature_table: str, model_path: str, runs_table: str | None = None,
                     label: str = schema.LABEL, id_col: str = schema.ID, exact: bool = True) -> str:
    """Train on a stage 2 table, save the chosen model and note the run; returns the run id.

    How the rows were split is saved with the model.
    """
    table = spark.table(feature_table)
    features.require_columns(table, (label,))
    marked = split_table(table, label, id_col, exact)
    trained = train_and_select(marked, label, id_col)
    how = {"kind": "exact" if exact else "hash", "seed": split.SEED,
           "cuts": split.class_cuts(marked, label, id_col) if exact else {}}
    best = trained.metrics.where(F.col("family") == trained.family).first()
    values = {"test_roc_auc": best.roc_auc, "test_pr_auc": best.average_precision}
    return model_store.save_model(
        trained.model, model_path, trained.family, trained.inputs.drop(label),
        {k: v for k, v in values.items() if v is not None}, id_col, runs_table, how)


def report_on_test(trained: Trained, stored: DataFrame, label: str = schema.LABEL) -> tuple[DataFrame, DataFrame]:
    """Classification report and confusion matrix of the chosen model on the test side."""
    scored = model.with_score(trained.model, side(stored, 1), (label,))
    return metrics.classification_report(scored, label), metrics.confusion_matrix(scored, label)
