"""Distributed ranks and metrics against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prospectra.operators import metrics
from prospectra.operators.ranks import bucketed, quantiles, running_totals


def frame(spark, y, score, partitions=4):
    return spark.createDataFrame(list(zip(map(int, y), map(float, score))), "y int, score double").repartition(partitions)


def brute_roc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + 0.5 * (d == 0).sum()) / d.size


def brute_ap(y, s):
    out = 0.0
    for t in np.unique(s):
        reached = s >= t
        out += (y[s == t].sum() / y.sum()) * (y[reached].sum() / reached.sum())
    return out


def measured(spark, y, s):
    return metrics.ranking_metrics(frame(spark, y, s)).first()


@pytest.mark.parametrize("kind", ["continuous", "ties", "one hot score"])
def test_metrics_equal_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    n = 3000
    y = (rng.random(n) < 0.1).astype(int)
    s = rng.random(n) + 0.3 * y
    if kind == "ties":
        s = np.round(s, 2)
    if kind == "one hot score":
        s[rng.random(n) < 0.4] = 0.5
    row = measured(spark, y, s)
    assert row["rows"] == n and row.positives == y.sum()
    assert row.roc_auc == pytest.approx(brute_roc(y, s), abs=1e-12)
    assert row.average_precision == pytest.approx(brute_ap(y, s), abs=1e-12)
    assert measured(spark, y, -s).roc_auc == pytest.approx(1 - row.roc_auc, abs=1e-12)


def test_metrics_by_group_equal_single_runs(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(g), int(rng.random() < 0.3), float(rng.random())) for g in range(3)
                                for _ in range(400)], "g int, y int, score double")
    grouped = {r.g: r for r in metrics.ranking_metrics(df, by=("g",)).collect()}
    for g in range(3):
        alone = metrics.ranking_metrics(df.where(F.col("g") == g)).first()
        assert grouped[g].roc_auc == pytest.approx(alone.roc_auc)
        assert grouped[g].average_precision == pytest.approx(alone.average_precision)


def test_edge_cases(spark):
    ties = measured(spark, [1, 0, 0, 0], [0.5] * 4)
    assert (ties.roc_auc, ties.average_precision) == (0.5, 0.25)
    perfect = measured(spark, [1, 1, 0, 0], [0.9, 0.8, 0.2, 0.1])
    assert (perfect.roc_auc, perfect.average_precision) == (1.0, 1.0)
    none = measured(spark, [0, 0], [0.1, 0.2])
    assert none.roc_auc is None and none.average_precision is None
    one = measured(spark, [1], [0.3])
    assert one.roc_auc is None and one.average_precision == 1.0


def test_same_result_for_any_partitioning(spark):
    rng = np.random.default_rng(5)
    y, s = (rng.random(500) < 0.2).astype(int), rng.random(500)
    a, b = [metrics.ranking_metrics(frame(spark, y, s, p)).first() for p in (1, 8)]
    assert a.roc_auc == pytest.approx(b.roc_auc, abs=1e-12)


def test_confusion_cells_and_report(spark):
    df = frame(spark, [1, 1, 0, 0, 0], [0.9, 0.2, 0.6, 0.1, 0.4])
    cells = {(r.actual, r.predicted): r["count"] for r in metrics.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    empty = metrics.classification_report(frame(spark, [0, 0], [0.1, 0.2])).collect()
    line = {r["class"]: r for r in empty}
    assert (line["1"].precision, line["1"].recall, line["1"].f1, line["1"].support) == (0.0, 0.0, 0.0, 0)
    assert line["accuracy"].f1 == 1.0 and line["weighted avg"].f1 == 1.0 and line["macro avg"].f1 == 0.5


def test_tie_keeps_logistic_and_null_loses(spark):
    rows = [("tree", 0.5), ("logistic", 0.5)]
    df = spark.createDataFrame(rows, "family string, average_precision double")
    assert metrics.select_best(df).first().family == "logistic"
    df = spark.createDataFrame([("tree", 0.1), ("logistic", None)], df.schema)
    assert metrics.select_best(df).first().family == "tree"


@pytest.mark.parametrize("kind", ["continuous", "few values", "hot value", "single"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(6)
    x = {"continuous": rng.lognormal(0, 3, 5000), "few values": rng.integers(0, 5, 999).astype(float),
         "hot value": np.where(rng.random(4001) < 0.4, 1.5, rng.normal(0, 1, 4001)),
         "single": np.array([3.5])}[kind]
    counts = (spark.createDataFrame([(float(v),) for v in x], "value double").withColumn("g", F.lit("a"))
              .groupBy("g", "value").agg(F.count("*").alias("n")))
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = quantiles(counts, "value", "n", probs, ("g",)).first().quantiles
    assert got == pytest.approx(np.quantile(x, probs), rel=1e-12)


def test_running_totals_equal_a_cumulative_sum(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("v"), (F.col("id") % 5).alias("n"),
                                  F.when(F.col("id") >= 0, "all").alias("g"))
    rows = sorted(running_totals(df, "v", ("n",), ("g",)).collect())
    assert [r.upto_n for r in rows] == list(np.cumsum([r.n for r in rows]))


def test_order_is_taken_inside_buckets(spark):
    """Scores are windowed per bucket; only bucket totals are windowed per group."""
    df = spark.range(1000).select((F.col("id") % 2).cast("int").alias("y"), F.rand(1).alias("score"))
    plan = metrics.ranking_metrics(df)._jdf.queryExecution().optimizedPlan().toString()
    specs = [part.split(",")[:3] for part in plan.split("windowspecdefinition(")[1:]]
    assert specs
    for spec in specs:
        ordered_by_score = any("_score" in s for s in spec)
        assert not ordered_by_score or any("_bucket" in s for s in spec)


def test_buckets_split_a_skewed_frame(spark):
    """One value with most of the rows is one counted row; the rest spread over the buckets."""
    values = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 40_000.0).alias("v"))
    counts = values.groupBy("v").agg(F.count("*").alias("n")).withColumn("g", F.when(F.col("v") >= 0, "a"))
    few, many = (bucketed(counts, "v", ("g",), target).groupBy("_bucket").count().collect() for target in (10_000, 30))
    assert len(many) > 900 and max(r["count"] for r in many) < 5 * 26_700 / 1024
    assert len(few) <= 16 and max(r["count"] for r in few) > 4 * max(r["count"] for r in many)
