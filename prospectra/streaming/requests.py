"""Scoring requests as they arrive: the batch plan over a stream.

Scoring keeps no state, so nothing needs a watermark, and the sink's
checkpoint makes every request appear once in the output after a failure.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from prospectra import schema
from prospectra.plans.scoring import explain_requests


def read_requests(spark: SparkSession, folder: str, request_schema: StructType,
                  files_per_batch: int = 1000) -> DataFrame:
    """JSON files of one request per line."""
    return (spark.readStream.schema(request_schema).option("maxFilesPerTrigger", files_per_batch)
            .json(folder))


def score_requests(fitted: PipelineModel, requests: DataFrame, output: str, checkpoint: str,
                   threshold: float = schema.FLAG_THRESHOLD, **trigger) -> StreamingQuery:
    """Start scoring; ``trigger`` as for ``DataStreamWriter.trigger``."""
    scored = explain_requests(fitted, requests, threshold)
    return (scored.writeStream.format("parquet").option("path", output)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(**(trigger or {"availableNow": True})).start())
