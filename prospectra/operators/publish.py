"""Flagged prospects joined back to the customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra import schema
from prospectra.functions.values import column
from prospectra.operators.joins import balanced_left_join


def prospects(scored: DataFrame, customers: DataFrame, id_col: str = schema.ID) -> DataFrame:
    """All customer columns, score and flag of the rows with flag 1.

    The scored side is preserved: an id without a customer row keeps its score
    with NULL attributes, an id with several customer rows appears once per
    row.  The flag is tested before the join, so only flagged rows move.
    """
    flagged = (scored.where(column(schema.FLAG) == 1)
               .select(column(id_col).alias("_scored_id"), column(schema.SCORE).alias("_score"),
                       column(schema.FLAG).alias("_flag")))
    joined = balanced_left_join(flagged, customers, "_scored_id", id_col)
    return joined.select(*[column(c) for c in customers.columns],
                         F.col("_score").alias(schema.SCORE), F.col("_flag").alias(schema.FLAG))


def unmatched_prospects(scored: DataFrame, customers: DataFrame, id_col: str = schema.ID) -> DataFrame:
    """Published rows whose id has no customer row: how many, and their score range."""
    published = prospects(scored, customers, id_col)
    return published.where(column(id_col).isNull()).agg(
        F.count("*").alias("rows"), F.min(schema.SCORE).alias("lowest"), F.max(schema.SCORE).alias("highest"))
