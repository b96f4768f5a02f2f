"""Label join, column selection and conformance of the customer table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra import schema
from prospectra.functions.values import column, finite_or_zero, is_floating, is_set, text_or_zero
from prospectra.operators.joins import balanced_left_join
from prospectra.session import write_and_read_back


def label_customers(customers: DataFrame, targets: DataFrame) -> DataFrame:
    """Add the label: 1 where the customer is among the target accounts.

    ``targets`` holds each account once, so no customer row is repeated.
    """
    joined = balanced_left_join(customers, targets.select(column(schema.ACCOUNT).alias("_account")),
                                schema.ID, "_account", unique_right=True)
    hit = F.when(F.col("_account").isNotNull(), 1).otherwise(0)
    return joined.select(*[column(c) for c in customers.columns], hit.alias(schema.LABEL))


def feature_table(customers: DataFrame, targets: DataFrame) -> DataFrame:
    """The named customer columns and the label.  Row order is not kept: a
    global sort before a write costs a shuffle and readers get no promise."""
    return label_customers(customers.select(*[column(c) for c in schema.CUSTOMER_COLUMNS]), targets)


def clean_features(table: DataFrame) -> DataFrame:
    """Everything but the columns found to be useless in profiling."""
    return table.drop(*schema.DROPPED_IN_CLEANING)


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {', '.join(absent)}")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = (schema.ID, schema.LABEL)) -> list[str]:
    """Numeric and boolean columns, in schema order."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if f.name not in skip and isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = (schema.ID, schema.LABEL)) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.StringType)]


def reject_untyped(df: DataFrame, exclude: Iterable[str] = (schema.ID, schema.LABEL)) -> None:
    """Raise on columns that are neither numeric nor text, such as dates."""
    known = set(numeric_columns(df, ())) | set(categorical_columns(df, ())) | set(exclude)
    other = [c for c in df.columns if c not in known]
    if other:
        raise TypeError(f"columns neither numeric nor text; cast or exclude them: {', '.join(other)}")


def id_column(df: DataFrame, candidates: Iterable[str] = schema.ID_CANDIDATES) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows 0 .. n-1 without sorting or a single task.

    The first pass stores the built-in partition-wise id with the rows in a
    table, so the ids are data and cannot change on a retry.  Its high bits
    are the partition, its low 33 bits the position; the second pass adds the
    number of rows in earlier partitions (one row per partition, broadcast).
    """
    stored = write_and_read_back(df.withColumn("_seq", F.monotonically_increasing_id()), "row-ids")
    part = F.shiftright("_seq", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    numbered = (stored.withColumn("_part", part)
                .join(F.broadcast(offsets), "_part")
                .withColumn(name, F.col("_offset") + F.col("_seq").bitwiseAND((1 << 33) - 1)))
    return numbered.select(*[column(c) for c in df.columns], name)


def conform_features(df: DataFrame, features: Iterable[schema.Feature] = schema.FEATURES) -> DataFrame:
    """The scoring columns in schema order, with defaults for what is missing.

    Flags come out as 1.0 or 0.0, numbers as double, text as string.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[_conformed(f, present).alias(f.name) for f in features])


def _conformed(feature: schema.Feature, present: Mapping[str, T.DataType]) -> Column:
    if feature.name not in present:
        return F.lit(feature.default).cast(_CONFORMED[feature.kind])
    value = column(feature.name)
    if is_floating(present[feature.name]):
        value = F.when(~F.isnan(value), value)
    filled = F.coalesce(value.cast(_CONFORMED[feature.kind]), F.lit(feature.default).cast(_CONFORMED[feature.kind]))
    if feature.kind == "flag":
        return is_set(filled).cast("double")
    return filled


_CONFORMED = {"id": "bigint", "num": "double", "flag": "double", "cat": "string"}


def clean_values(df: DataFrame, exclude: Iterable[str] = (schema.ID, schema.LABEL)) -> DataFrame:
    """NULL, NaN and infinities to 0 in numbers, NULL to '0' in text."""
    skip = set(exclude)
    out = []
    for f in df.schema.fields:
        value = column(f.name)
        if f.name in skip:
            out.append(value)
        elif is_floating(f.dataType):
            out.append(finite_or_zero(value).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            out.append(F.coalesce(value, F.lit(0).cast(f.dataType)).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(text_or_zero(value).alias(f.name))
        else:
            out.append(value)
    return df.select(*out)
