"""Quantiles by narrowing against numpy, however small the sketch and the last round are."""

import numpy as np
import pytest

from prospectra.operators import narrowing

INF = float("inf")
PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    return {
        "spread": rng.normal(0, 1e6, 700), "ties": rng.integers(0, 4, 500).astype(float), "one": np.array([7.0]),
        "two": np.array([1.0, 2.0]), "hot": np.concatenate([np.full(400, 3.0), rng.random(300)]),
        "close": 1e9 + rng.random(300) * 1e-6, None: rng.lognormal(3, 4, 300), "ends": np.array([-INF, -1.0, -0.0, 0.0, 5.0, INF])}


@pytest.fixture(scope="module")
def table(spark, groups):
    rows = [(k, i % 2, float(v)) for k, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "g string, h int, v double").repartition(5).cache()


@np.errstate(invalid="ignore")
def quantile(values, p):
    values = np.sort(values)
    at = (len(values) - 1) * p
    lo, hi = values[int(np.floor(at))], values[int(np.ceil(at))]
    return lo if lo == hi else lo + (hi - lo) * (at - np.floor(at))


@pytest.mark.parametrize("most, bits", [(200_000, 8), (20, 3), (1, 1)])
def test_equals_numpy(table, groups, most, bits):
    got = {r.g: r.quantiles for r in narrowing.exact_quantiles(table, "v", PROBS, ["g"], most, bits).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g] == pytest.approx([quantile(values, p) for p in PROBS], rel=1e-15, nan_ok=True), g


def test_two_group_columns_and_no_rows(table, groups):
    got = {(r.g, r.h): r.quantiles[0] for r in narrowing.exact_quantiles(table, "v", (0.5,), ["g", "h"], 10, 2).collect()}
    assert got[None, 1] == pytest.approx(quantile(groups[None][1::2], 0.5))
    assert len(got) == 15
    assert narrowing.exact_quantiles(table.limit(0), "v", (0.5,), ["g"]).collect() == []


def test_few_rows_are_written(spark, monkeypatch):
    """A column of 200,000 different values: what is stored stays in the hundreds."""
    seen = []
    write = narrowing.write_and_read_back

    def noted(df, name):
        out = write(df, name)
        seen.append(out.count())
        return out

    monkeypatch.setattr(narrowing, "write_and_read_back", noted)
    rows = spark.range(200_000).selectExpr("1 as g", "cast(id * 7919 % 200000 as double) / 3 as v")
    got = narrowing.exact_quantiles(rows, "v", (0.25, 0.5), ["g"], 3_000).first().quantiles
    assert got == pytest.approx([quantile(np.arange(200_000) / 3, p) for p in (0.25, 0.5)], rel=1e-15)
    assert max(seen) <= 520
