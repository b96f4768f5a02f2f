"""The corpus pipeline: rules, classifier, near-duplicates, mix, tokens.

``run`` applies the stages to ``documents``; each one's result is written and
read back, so a stage starts from a stored table.  All but the last return the
columns of ``documents``; the last adds token ids and counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.functions.values import column
from prospectra.llm import bpe, mixing, ngram_join, quality_classifier, quality_rules
from prospectra.llm.common import free_name
from prospectra.session import write_and_read_back


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents it gets and their labels, then keeps what scores well."""
    features = quality_classifier.featurize(docs)
    model = quality_classifier.train(features, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_per_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.source_rates(docs))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix with its ids (little-endian 32-bit) and whether they decode to its text.

    A name that the documents have already gets underscores in front.
    """
    back = bpe.round_trip(docs)
    ids, decoded = (column(c) for c in back.columns[len(docs.columns):])
    added = {"ids": ids, "n_tokens": (F.octet_length(ids) / 4).cast("long"),
             "round_trip": decoded == F.coalesce(column("text"), F.lit("")).cast("binary")}
    return back.select(*[column(c) for c in docs.columns], *[v.alias(free_name(docs.columns, n)) for n, v in added.items()])


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

# A learnt classifier decides in the second stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_and_read_back(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
