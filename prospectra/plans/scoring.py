"""Score every customer, flag, explain and publish."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra import schema
from prospectra.functions.values import column, flag_at, segment
from prospectra.operators import explain, features, model, publish, split
from prospectra.plans.tables import TableNames
from prospectra.sources import model_store, tables


def score_table(fitted: PipelineModel, table: DataFrame, threshold: float = schema.FLAG_THRESHOLD,
                id_col: str | None = None, label: str = schema.LABEL, how: dict | None = None) -> DataFrame:
    """(id, score, flag) of all rows, training rows included.

    With ``how``, the split that was saved with the model, ``is_train`` marks
    the rows that it put on the training side; an exact split needs the label.
    Without an id column the rows are numbered.
    """
    found = id_col or features.id_column(table)
    if found is None:
        table, found = features.with_row_ids(table), "row_id"
    marks = ["is_train"] if how else []
    if how:
        table = table.withColumn("is_train", split.in_training(how, label, found))
    cleaned = features.clean_values(table.drop(label), (found, *marks))
    scored = model.with_score(fitted, cleaned, (found, *marks))
    return scored.select(column(found), schema.SCORE, flag_at(F.col(schema.SCORE), threshold).alias(schema.FLAG), *marks)


def explain_requests(fitted: PipelineModel, requests: DataFrame,
                     threshold: float = schema.FLAG_THRESHOLD) -> DataFrame:
    """Conform, clean, score, segment and explain scoring requests of any column set.

    One lazy plan without a shuffle; works on streams as well.
    """
    ready = features.clean_values(features.conform_features(requests), (schema.ID,))
    scored = model.with_score(fitted, ready)
    return explain.with_explanations(
        scored.withColumn(schema.FLAG, flag_at(F.col(schema.SCORE), threshold))
        .withColumn("segment", segment(F.col(schema.SCORE), threshold)), threshold)


def run_scoring_job(spark: SparkSession, names: TableNames, model_path: str,
                    threshold: float = schema.FLAG_THRESHOLD) -> None:
    """Write the scored table and the prospects table."""
    saved = model_store.load_model(spark, model_path)
    table = spark.table(names.stage2)
    model_store.check_signature(table, saved.signature)
    scored = score_table(saved.model, table, threshold)
    tables.write_table(scored, names.scored)
    tables.write_table(publish.prospects(spark.table(names.scored), spark.table(names.customers)), names.prospects)
