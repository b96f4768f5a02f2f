"""Cleaning, flags, segments and display text on inline frames."""

import math

import pytest
from pyspark.sql import functions as F

from prospectra.functions.values import (clamped, display_label, flag_at, is_missing, is_set, percent_text, segment,
                                         whole_text)
from prospectra.operators import features
from prospectra.schema import FEATURE_NAMES, FEATURES, Feature

INF = float("inf")
NAN = float("nan")


def column_of(spark, values, expression, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.out for r in df.select("i", expression(F.col("x")).alias("out")).orderBy("i").collect()]


def test_clean_values(spark):
    df = spark.createDataFrame(
        [(1, None, None, None), (2, NAN, "", 3), (3, INF, "0", 0), (4, -INF, "a", None), (5, 0.0, "b", 1)],
        "client_id long, x double, s string, n int")
    rows = features.clean_values(df).orderBy("client_id").collect()
    assert [r.x for r in rows] == [0.0, 0.0, 0.0, 0.0, 0.0]
    assert [r.s for r in rows] == ["0", "", "0", "a", "b"]
    assert [r.n for r in rows] == [0, 3, 0, 0, 1]


def test_missing_counts_infinity_as_a_value(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,), (INF,)], "x double")
    marks = df.select(is_missing(F.col("x"), df.schema["x"].dataType).alias("m"))
    assert sorted(r.m for r in marks.collect()) == [False, False, True, True]


SCORES = [0.1999, 0.2, 0.4999, 0.5, -0.1, 1.1, NAN, None]


def test_segments(spark):
    assert column_of(spark, SCORES, segment) == ["Low", "Medium", "Medium", "High", "Low", "High", "Low", "Low"]


def test_flags(spark):
    assert column_of(spark, SCORES, flag_at) == [0, 1, 1, 1, 0, 1, 0, 0]


def test_clamp(spark):
    assert column_of(spark, SCORES, clamped) == [0.1999, 0.2, 0.4999, 0.5, 0.0, 1.0, None, None]


def test_set_means_present_and_positive(spark):
    assert column_of(spark, [1.0, 0.0, -1.0, NAN, None], is_set) == [True, False, False, False, False]


def test_display_labels_equal_title_case(spark):
    names = list(FEATURE_NAMES)
    assert column_of(spark, names, display_label, "string") == [n.replace("_", " ").title() for n in names]


@pytest.mark.parametrize("values", [[0.0, 0.03125, 0.12345, 0.00125, 0.5, 1.0, 0.99995, 1 / 3]])
def test_percent_text_rounds_like_python(spark, values):
    assert column_of(spark, values, percent_text) == [f"{v:.2%}" for v in values]


def test_whole_text_rounds_like_python(spark):
    values = [0.5, 1.5, 2.5, 1234567.0, 3.49]
    assert column_of(spark, values, whole_text) == [f"{v:.0f}" for v in values]


def test_conform_fills_orders_and_encodes(spark):
    df = spark.createDataFrame([(7, NAN, True, None), (None, 2.0, False, "x")],
                               "client_id long, amount double, member boolean, extra string")
    spec = (Feature("member", "flag", 0), Feature("client_id", "id", 1), Feature("amount", "num", 5.0),
            Feature("town", "cat", "none"), Feature("vip", "flag", 1))
    out = features.conform_features(df, spec)
    assert out.columns == ["member", "client_id", "amount", "town", "vip"]
    assert sorted(out.collect()) == [(0.0, 1, 2.0, "none", 1.0), (1.0, 7, 5.0, "none", 1.0)]


def test_conform_covers_all_features(spark):
    out = features.conform_features(spark.range(1).select(F.col("id").alias("client_id")))
    assert out.columns == list(FEATURE_NAMES)
    row = out.first()
    assert all(row[f.name] == f.default for f in FEATURES if f.name != "client_id")


def test_required_columns(spark):
    with pytest.raises(ValueError, match="is_target_customer"):
        features.require_columns(spark.range(1), ("is_target_customer",))


def test_untyped_columns_are_rejected(spark):
    df = spark.sql("select 1L as client_id, 0 as is_target_customer, date'2020-01-01' as born, 1.5 as dec")
    with pytest.raises(TypeError, match="born"):
        features.reject_untyped(df)
    features.reject_untyped(df, ("client_id", "is_target_customer", "born"))
    assert features.numeric_columns(df) == ["dec"]


def test_id_column_takes_the_first_candidate(spark):
    assert features.id_column(spark.sql("select 1 as accountid, 2 as customer_id")) == "customer_id"
    assert features.id_column(spark.range(1)) is None


@pytest.mark.parametrize("partitions", [1, 7])
def test_row_ids_are_contiguous(spark, partitions):
    df = spark.range(1000).repartition(partitions)
    ids = [r.row_id for r in features.with_row_ids(df).collect()]
    assert sorted(ids) == list(range(1000))
    assert not math.isnan(ids[0])
