"""Saved models with their input schema, and the table of training runs."""

from __future__ import annotations

import json
import uuid
from datetime import datetime
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra.functions.values import column


class SavedModel(NamedTuple):
    model: PipelineModel
    family: str
    signature: T.StructType
    how: dict | None = None


_META = "run_id string, family string, signature string, split string, saved_at timestamp"
_RUNS = "run_id string, family string, metric string, value double, signature string"


def save_model(model: PipelineModel, path: str, family: str, inputs: DataFrame, metrics: dict[str, float],
               id_col: str, runs_table: str | None = None, how: dict | None = None) -> str:
    """Save the pipeline, its input schema, five example rows and how the rows were split; note the run.

    Returns the run id.  ``inputs`` are the training rows as the model takes
    them, raw columns included.  Pipeline and example go to a folder of the
    run; a small file that names the run is added last, so readers see the
    model before or this one and never a mixture.
    """
    spark = inputs.sparkSession
    run_id = uuid.uuid4().hex
    signature = inputs.schema.json()
    model.write().save(f"{path}/{run_id}/pipeline")
    inputs.orderBy(column(id_col)).limit(5).write.parquet(f"{path}/{run_id}/example")
    meta = spark.createDataFrame([(run_id, family, signature, json.dumps(how), datetime.now())], _META)
    meta.coalesce(1).write.mode("append").parquet(f"{path}/meta")
    if runs_table:
        rows = [(run_id, family, name, float(value), signature) for name, value in metrics.items()]
        spark.createDataFrame(rows, _RUNS).write.mode("append").saveAsTable(runs_table)
    return run_id


def load_model(spark: SparkSession, path: str) -> SavedModel:
    meta = spark.read.schema(_META).parquet(f"{path}/meta").orderBy(F.desc("saved_at")).first()
    return SavedModel(PipelineModel.load(f"{path}/{meta.run_id}/pipeline"), meta.family,
                      T.StructType.fromJson(json.loads(meta.signature)), json.loads(meta.split))


def check_signature(df: DataFrame, signature: T.StructType) -> None:
    """Raise unless every expected column is there with its type."""
    present = {f.name: f.dataType for f in df.schema.fields}
    problems = [f"{f.name}: {present[f.name].simpleString() if f.name in present else 'absent'}, "
                f"expected {f.dataType.simpleString()}"
                for f in signature.fields if present.get(f.name) != f.dataType]
    if problems:
        raise ValueError("input does not fit the model: " + "; ".join(problems))


def runs(spark: SparkSession, table: str) -> DataFrame:
    """One row per run with its metrics as columns."""
    return (spark.table(table).groupBy("run_id", "family")
            .agg(F.max(F.when(F.col("metric") == "test_roc_auc", F.col("value"))).alias("test_roc_auc"),
                 F.max(F.when(F.col("metric") == "test_pr_auc", F.col("value"))).alias("test_pr_auc")))
