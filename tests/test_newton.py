import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, Vectors

from prospectra.operators import newton


def numbers(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 3, 0.2, 1]
    x[:, 3] = x[:, 3] > 0
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [1.5, -1, 4, 0.5] - 2)))).astype(float)
    return x, y, np.where(y > 0, 2.5, 0.7)


def table(spark, x, y, w):
    def vector(i, r):
        return SparseVector(len(r), {j: float(v) for j, v in enumerate(r) if v}) if i % 3 else Vectors.dense(r.tolist())
    return spark.createDataFrame([(float(b), float(c), vector(i, a)) for i, (a, b, c) in enumerate(zip(x, y, w))],
                                 ["y", "w", "features"])


def gradient(x, y, w, theta, penalty=1.0):
    full = np.c_[x, np.ones(len(x))]
    p = 1 / (1 + np.exp(-(full @ theta)))
    return full.T @ (w * (p - y)) + penalty * np.r_[theta[:-1], 0]


def test_the_gradient_is_zero_whatever_the_partitions(spark):
    x, y, w = numbers()
    df = table(spark, x, y, w)
    found = [newton.fit(df.repartition(n), "y", "w", "features") for n in (1, 7)]
    for f in found:
        assert np.abs(gradient(x, y, w, np.r_[f.weights, f.intercept])).max() < 1e-5
        assert all(a >= b - 1e-9 for a, b in zip(f.losses, f.losses[1:])) and len(f.losses) < 15
    assert np.allclose(found[0].weights, found[1].weights, rtol=0, atol=1e-8)
    assert abs(found[0].intercept - found[1].intercept) < 1e-8


def test_equals_the_first_order_fit_run_to_its_end(spark):
    x, y, w = numbers(300, 8)
    df = table(spark, x, y, w).cache()
    f = newton.fit(df, "y", "w", "features")
    slow = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", maxIter=1000, tol=1e-14,
                              regParam=1.0 / w.sum(), standardization=False).fit(df)
    df.unpersist()
    assert np.allclose(f.weights, slow.coefficients.toArray(), rtol=0, atol=1e-6)
    assert abs(f.intercept - slow.intercept) < 1e-6


def test_a_column_that_repeats_and_far_away_values(spark):
    x, y, w = numbers(200, 5)
    x = np.c_[x, x[:, 0], np.ones(len(x)), x[:, 1] * 40]
    f = newton.fit(table(spark, x, y, w), "y", "w", "features")
    assert np.abs(gradient(x, y, w, np.r_[f.weights, f.intercept])).max() < 1e-4
    assert abs(f.weights[0] - f.weights[4]) < 1e-6          # equal columns share their weight


def test_one_class_no_rows_and_too_many_slots_are_refused(monkeypatch, spark):
    x, y, w = numbers(20)
    df = table(spark, x, np.ones(20), w)
    with pytest.raises(ValueError, match="both classes"):
        newton.fit(df, "y", "w", "features")
    with pytest.raises(ValueError, match="both classes"):
        newton.fit(df.limit(0), "y", "w", "features")
    monkeypatch.setattr(newton, "MOST_SLOTS", 3)
    with pytest.raises(ValueError, match="slots"):
        newton.fit(df, "y", "w", "features")
