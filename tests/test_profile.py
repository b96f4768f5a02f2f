"""Profiling against numpy and pandas on a frame with every trap in it."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prospectra.operators import profile

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 600
    pdf = pd.DataFrame({
        "client_id": np.arange(n),
        "amount": rng.lognormal(8, 2, n),
        "rate": rng.normal(1e6, 1.0, n),
        "18-21": rng.integers(0, 2, n),
        "k": np.full(n, 5.0),
        "holes": np.where(rng.random(n) < 0.3, np.nan, rng.random(n)),
        "town": rng.choice(list("abcdefghijklmno"), n),
        "is_target_customer": rng.integers(0, 2, n),
    })
    pdf.loc[3, "amount"] = INF
    pdf.loc[[5, 6], "town"] = None
    return spark.createDataFrame(pdf).withColumn("none", F.lit(None).cast("double")), pdf


def by_name(df):
    return {r.column_name: r for r in df.collect()}


def test_describe(table):
    df, pdf = table
    got = by_name(profile.describe_numeric(df))
    assert set(got) == {"amount", "rate", "18-21", "k", "holes", "none"}
    for c in ("rate", "18-21", "k", "holes"):
        want = pdf[c].describe()
        row = got[c]
        assert row["count"] == want["count"]
        for mine, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"), ("q50", "50%"),
                             ("q75", "75%"), ("max", "max")):
            assert row[mine] == pytest.approx(want[theirs], rel=1e-9, abs=1e-9), (c, mine)
    assert got["amount"].mean == INF and got["amount"]["max"] == INF and got["amount"].std is None
    assert got["amount"].q50 == pytest.approx(pdf.amount.quantile(0.5))
    assert got["none"]["count"] == 0 and got["none"].mean is None and got["none"].q50 is None


def test_missing_counts_are_sorted(table):
    df, pdf = table
    rows = [(r.column_name, r.missing) for r in profile.missing_counts(df).collect()]
    assert rows == [("none", 600), ("holes", int(pdf.holes.isna().sum())), ("town", 2)]


def test_histogram_equals_numpy(table):
    df, pdf = table
    rows = profile.histogram(df).collect()
    for c in ("rate", "18-21", "k", "holes"):
        x = pdf[c].dropna().to_numpy(float)
        counts, edges = np.histogram(x, bins=30)
        mine = sorted((r.bin, r["count"], r.lower, r.upper) for r in rows if r.column_name == c)
        assert [m[1] for m in mine] == list(counts)
        assert [m[2] for m in mine] == pytest.approx(list(edges[:-1]), rel=1e-12)
    assert sum(r["count"] for r in rows if r.column_name == "amount") == 599
    assert not [r for r in rows if r.column_name == "none"]


def test_correlation_equals_pandas(table):
    df, pdf = table
    columns = ["amount", "rate", "18-21", "k", "holes"]
    want = pdf[columns].corr()
    rows = profile.correlation(df.repartition(5), [*columns, "none"]).collect()
    assert len(rows) == 36
    for r in rows:
        if "none" in (r.column_a, r.column_b) or math.isnan(want.loc[r.column_a, r.column_b]):
            assert r.correlation is None
        else:
            assert r.correlation == pytest.approx(want.loc[r.column_a, r.column_b], abs=1e-9)


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_constants_have_no_correlation_and_gaps_first_do(spark, parts):
    gap = F.when(F.col("id") >= 12_000, 1.7e9 + F.rand(3) * 100)
    df = spark.range(40_000).select(gap.alias("late"), (gap * 2 + 1).alias("twice"), F.rand(5).alias("noise"),
                                    F.lit(0.1).alias("tenth"), (F.lit(1.0) / 3).alias("third"), F.lit(1e-3).alias("small"),
                                    F.lit(1e9 + 0.1).alias("large"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        df = df.coalesce(1) if parts == 1 else df.repartition(parts)
        found = {(r.column_a, r.column_b): r.correlation for r in profile.correlation(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found["late", "twice"] == pytest.approx(1.0, abs=1e-6) and found["late", "late"] == 1.0
    assert abs(found["late", "noise"]) < 0.05
    constants = ("tenth", "third", "small", "large")
    assert all(v is None for k, v in found.items() if set(k) & set(constants))


def test_top_categories_and_describe(table):
    df, pdf = table
    counts = pdf.town.value_counts()
    want = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
    got = profile.top_categories(df).orderBy("rank").collect()
    assert [(r.value, r["count"]) for r in got] == want
    text = by_name(profile.describe_categorical(df))["town"]
    assert (text["count"], text.unique, text.top, text.freq) == (598, counts.size, want[0][0], want[0][1])


def test_target_rate(table):
    df, pdf = table
    rates = pdf.groupby("town").is_target_customer.mean()
    want = sorted(rates.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
    got = profile.target_rate(df).orderBy("rank").collect()
    assert [(r.value, r.rate) for r in got] == [(k, pytest.approx(v)) for k, v in want]


def test_top_k_is_limited_before_the_shuffle(table):
    df, _ = table
    plan = profile.top_categories(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_boxplot(table):
    df, pdf = table
    for r in profile.boxplot_stats(df, columns=["amount", "holes"]).collect():
        x = pdf.loc[pdf.is_target_customer == r.is_target_customer, r.column_name].dropna().to_numpy()
        q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, q2, q3))
        assert (r.whisker_low, r.whisker_high) == pytest.approx((inside.min(), inside.max()))
        assert (r["count"], r.outliers) == (x.size, x.size - inside.size)


def test_whisker_stops_at_the_quartile(spark):
    """Where no value lies between the quartile and the fence."""
    x = [0.0, 1.0, 1.0, 100.0]
    df = spark.createDataFrame([(v, 1) for v in x], "x double, is_target_customer int")
    row = profile.boxplot_stats(df, columns=["x"]).first()
    q1, _, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    assert row.whisker_high == q3 and row.whisker_low == min(q1, 0.0) and row.outliers == 1


def test_distribution_and_ratio(spark):
    df = spark.createDataFrame([(0,), (0,), (0,)], "is_target_customer int")
    assert profile.imbalance_ratio(df).first().ratio == INF
    assert profile.class_distribution(df).collect() == [(0, 3, 100.0)]


def test_kinds(table):
    df, _ = table
    info = by_name(profile.column_info(df))
    assert info["town"].kind == "categorical" and info["18-21"].kind == "numeric" and info["client_id"].kind == "other"
    assert info["none"].non_null == 0


def test_states_of_loads_merge_to_the_state_of_all(spark, table):
    df, pdf = table
    columns = ["amount", "rate", "18-21", "k", "holes", "none"]
    parts = [df.where("client_id < 7"), df.where("client_id >= 7 and client_id % 5 > 0"), df.where("client_id >= 7 and client_id % 5 = 0"),
             df.limit(0)]
    # A load may have its columns in another order.
    states = [profile.moment_state(p, columns if i % 2 else columns[::-1]) for i, p in enumerate(parts)]
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    merged, whole = profile.merge_moments(every), profile.moment_state(df, columns)
    for of in (profile.moments_of, profile.correlation_of):
        a, b = ({tuple(r)[:1 + (of is profile.correlation_of)]: r for r in of(s).collect()} for s in (merged, whole))
        assert set(a) == set(b) and len(a) == len(columns) ** (1 + (of is profile.correlation_of))
        for key in a:
            for x, y in zip(a[key], b[key]):
                assert x == y or x == pytest.approx(y, rel=1e-9, abs=1e-9), key
    found = {r.column_name: r for r in profile.moments_of(merged).collect()}
    finite = pdf.amount[np.isfinite(pdf.amount)]
    assert (found["amount"]["count"], found["amount"].missing) == (599, 1)
    assert found["amount"].std == pytest.approx(finite.std()) and found["amount"].mean == pytest.approx(finite.mean())
    assert found["none"]["count"] == 0 and found["none"].mean is None and found["none"].std is None and found["none"].missing == 600
