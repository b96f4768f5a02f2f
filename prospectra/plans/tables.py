"""From landed files to the clean feature table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from prospectra import schema
from prospectra.operators import features, label
from prospectra.sources import landing, tables


class TableNames(NamedTuple):
    transactions: str
    customers: str
    stage1: str
    stage2: str
    scored: str
    prospects: str


def ingest(spark: SparkSession, transactions_csv: str, customers_csv: str, names: TableNames,
           customer_types=None, multi_line: bool = False) -> None:
    """Land both CSV files as tables: ';' separated transactions, ',' separated customers.

    ``multi_line`` is for files with line breaks inside quotes; it reads each file in one task.
    """
    tables.write_table(landing.read_csv(spark, transactions_csv, ";", schema.transaction_schema(), multi_line),
                       names.transactions)
    tables.write_table(landing.read_csv(spark, customers_csv, ",", customer_types or schema.customer_schema(), multi_line),
                       names.customers)


def build_features(transactions: DataFrame, customers: DataFrame, product: str) -> DataFrame:
    """Stage 1: the labelled wide table."""
    return features.feature_table(customers, label.target_accounts(transactions, product))


def build_stages(spark: SparkSession, names: TableNames, product: str) -> None:
    """Write stage 1 and stage 2; each stage is a table, which also cuts lineage."""
    stage1 = build_features(spark.table(names.transactions), spark.table(names.customers), product)
    tables.write_table(stage1, names.stage1)
    tables.write_table(features.clean_features(spark.table(names.stage1)), names.stage2)
