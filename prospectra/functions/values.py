"""Column expressions for cleaning, flags, segments and display text."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra.schema import FLAG_THRESHOLD, HIGH_THRESHOLD


def quoted(name: str) -> str:
    """Back-tick a column name so that dots and signs in it are literal."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_missing(value: Column, dtype: T.DataType) -> Column:
    """NULL for any type, NaN too for floating types; infinities are values."""
    if is_floating(dtype):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def is_finite(value: Column) -> Column:
    """False for NULL, NaN and both infinities (NaN orders above infinity)."""
    return F.coalesce((value > float("-inf")) & (value < float("inf")), F.lit(False))


def finite_or_zero(value: Column) -> Column:
    """NULL, NaN and infinities become 0."""
    return F.when(is_finite(value), value).otherwise(F.lit(0.0))


def missing_to_zero(value: Column) -> Column:
    """NULL and NaN become 0; infinities stay."""
    return F.coalesce(nan_to_null(value.cast("double")), F.lit(0.0))


def text_or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit("0"))


def is_set(value: Column) -> Column:
    """True where a number is present and above 0; NaN and NULL count as not set."""
    return missing_to_zero(value) > 0


def flag_at(score: Column, threshold: float = FLAG_THRESHOLD) -> Column:
    """1 where the score reaches the threshold, else 0; NaN and NULL give 0."""
    return F.coalesce(nan_to_null(score) >= threshold, F.lit(False)).cast("int")


def clamped(score: Column) -> Column:
    """The score held within [0, 1]; NaN becomes NULL."""
    return F.when(nan_to_null(score).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def segment(score: Column, medium: float = FLAG_THRESHOLD, high: float = HIGH_THRESHOLD) -> Column:
    """High, Medium or Low; scores that are not numbers are Low."""
    known = nan_to_null(score)
    return F.when(known >= high, "High").when(known >= medium, "Medium").otherwise("Low")


def whole_text(value: Column) -> Column:
    """No decimals and no separators; ties to even, on the exact binary value."""
    return F.translate(F.format_number(value, 0), ",", "")


def percent_text(score: Column) -> Column:
    """Two decimals.  format_number rounds the exact value half to even, where
    format_string would round its shortest text half up."""
    return F.concat(F.format_number(score * 100, 2), F.lit("%"))


def joined_labels(labels: dict[str, str]) -> Column:
    """Labels of the set columns in the given order, joined by ', '."""
    parts = [F.when(is_set(column(name)), F.lit(text)) for name, text in labels.items()]
    return F.array_join(F.array_compact(F.array(*parts)), ", ")


def any_set(names: tuple[str, ...]) -> Column:
    return functools.reduce(operator.or_, [is_set(column(name)) for name in names])


def display_label(name: Column) -> Column:
    """``go-pay`` -> ``Go-Pay``, ``home_expense`` -> ``Home Expense``.

    initcap only starts words at spaces, so each run of letters is cased on
    its own and put back between the separators.
    """
    spaced = F.translate(name, "_", " ")
    words = F.split(spaced, "-")
    return F.array_join(F.transform(words, F.initcap), "-")
