"""The exact-split tree against one grown with numpy, and models kept as tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prospectra import schema, standins
from prospectra.operators import model, model_table, tree
from prospectra.plans import training

LABEL = schema.LABEL


def gini(a, b):
    p, q = a / (a + b), b / (a + b)
    return 1.0 - p * p - q * q


def numpy_tree(pdf, depth, leaf_rows):
    """{node: (rows, positives, column, level, threshold)} by trying every cut of every column on sorted values."""
    y = pdf[LABEL].to_numpy()
    w0, w1 = len(y) / (2 * (y == 0).sum()), len(y) / (2 * (y == 1).sum())
    numeric = [c for c in pdf.columns if pdf[c].dtype.kind == "f"]
    text = [c for c in pdf.columns if pdf[c].dtype.kind == "O"]
    nodes = {}

    def gain(left):
        l1, l0 = y[left].sum(), (1 - y[left]).sum()
        return l0, l1

    def grow(number, rows, level):
        t1, t0 = int(y[rows].sum()), int((1 - y[rows]).sum())
        best = None
        if level < depth and t0 and t1:
            for pos, c in enumerate([*numeric, *text]):
                x = pdf[c].to_numpy()[rows]
                values = np.unique(np.nan_to_num(x) if c in numeric else x.astype(str))
                for i, v in enumerate(values if c in text else values[:-1]):
                    left = rows[(np.nan_to_num(x) <= v) if c in numeric else (x.astype(str) != v)]
                    l1 = int(y[left].sum())
                    l0 = len(left) - l1
                    if min(len(left), len(rows) - len(left)) < leaf_rows:
                        continue
                    a, b, ra, rb, ta, tb = w0 * l0, w1 * l1, w0 * (t0 - l0), w1 * (t1 - l1), w0 * t0, w1 * t1
                    loss = -(gini(ta, tb) - (a + b) / (ta + tb) * gini(a, b) - (ra + rb) / (ta + tb) * gini(ra, rb))
                    key = (loss, pos, v if c in numeric else 0.0, "" if c in numeric else v)
                    if best is None or key < best[0]:
                        best = (key, c, left, v, values[i + 1] if c in numeric else None)
        if best is None:
            nodes[number] = (t0 + t1, t1, None, None, None)
            return
        _, c, left, v, after = best
        nodes[number] = (t0 + t1, t1, c, None if after is not None else v, (v + after) / 2 if after is not None else None)
        grow(2 * number, left, level + 1)
        grow(2 * number + 1, np.setdiff1d(rows, left), level + 1)

    grow(1, np.arange(len(y)), 0)
    return nodes


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 400
    pdf = pd.DataFrame({
        "client_id": np.arange(n), "spread": rng.normal(0, 10, n), "few": rng.integers(0, 4, n).astype(float),
        "holes": np.where(rng.random(n) < 0.2, np.nan, rng.random(n)), "same": np.full(n, 3.0),
        "town": rng.choice(["a", "b", "c", "d"], n), "odd_one": rng.choice(["x", "y'z"], n)})
    pdf[LABEL] = ((pdf["few"] > 1) ^ (pdf.town == "b") ^ (rng.random(n) < 0.15)).astype(int)
    return spark.createDataFrame(pdf).repartition(3).cache(), pdf


@pytest.mark.parametrize("depth, leaf_rows", [(4, 10), (2, 1), (5, 60)])
def test_equals_numpy(spark, table, depth, leaf_rows):
    df, pdf = table
    nodes = tree.fit(df, depth=depth, leaf_rows=leaf_rows)
    want = numpy_tree(pdf.drop(columns="client_id"), depth, leaf_rows)
    got = {n.node: (n.rows, n.positives, n.column_name, n.level, n.threshold) for n in nodes}
    assert got == want


def test_partitions_make_no_difference(table):
    df, _ = table
    assert tree.fit(df, depth=3, leaf_rows=5) == tree.fit(df.orderBy(F.desc("spread")).coalesce(1), depth=3, leaf_rows=5)


def test_duckdb_counts_the_same_rows_by_the_cuts(spark, table):
    df, pdf = table
    nodes = tree.fit(df, depth=4, leaf_rows=10)
    stored = tree.node_table(spark, nodes)
    assert tree.from_table(stored) == nodes
    by_number = {n.node: n for n in nodes}

    def where(number):
        if number == 1:
            return "true"
        up = by_number[number // 2]
        right = (f"coalesce(\"{up.column_name}\", '0') = '" + up.level.replace("'", "''") + "'") if up.level is not None else (
            f"coalesce(nullif(\"{up.column_name}\", 'nan'::double), 0) > {up.threshold!r}")
        return f"{where(number // 2)} AND {'' if number % 2 else 'NOT '}({right})"

    con = duckdb.connect()
    con.register("pdf", pdf)
    for n in nodes:
        rows, positives = con.execute(f"SELECT count(*), sum({LABEL}) FROM pdf WHERE {where(n.node)}").fetchone()
        assert (rows, positives) == (n.rows, n.positives)
        share = n.positives * (len(pdf) / (2 * pdf[LABEL].sum())) / n.weight
        assert n.probability == pytest.approx(share) and n.impurity == pytest.approx(2 * share * (1 - share))
    places = {r.leaf: r["count"] for r in df.groupBy(tree.place_of(nodes).alias("leaf")).count().collect()}
    assert places == {n.node: n.rows for n in nodes if n.column_name is None}
    used = {r.feature: r.importance for r in tree.importances(stored).collect()}
    assert sum(used.values()) == pytest.approx(1.0) and "few" in used


def test_one_class_is_refused_and_pure_or_small_nodes_stay_leaves(spark, table):
    df, _ = table
    with pytest.raises(ValueError, match="one class"):
        tree.fit(df.where(F.col(LABEL) == 1))
    assert len(tree.fit(df, leaf_rows=300)) == 1
    pure = df.withColumn("few", F.col(LABEL).cast("double"))
    assert [n.column_name for n in tree.fit(pure)] == ["few", None, None]


@pytest.fixture(scope="module")
def stored(spark):
    return training.split_table(standins.stage2_table(spark, "/root/testdata/sf0.01"))


def test_tables_score_like_their_pipelines(spark, stored):
    train = training.side(stored, 0)
    fitted = model.fit_all(train, families=("logistic",))["logistic"]
    given = model_table.ModelTable(model_table.LOGISTIC, model_table.logistic_table(fitted, train))
    for inline in (64, 0):
        model_table.INLINE_LEVELS, before = inline, model_table.INLINE_LEVELS
        try:
            again = model_table.score(given, stored).select("client_id", F.col("score").alias("again"), F.col("flag").alias("flag_again"))
            both = model.score_batch(fitted, stored).join(again, "client_id")
            assert both.count() == 1500
            assert both.where((F.abs(F.col("score") - F.col("again")) > 1e-12) | (F.col("flag") != F.col("flag_again"))).count() == 0
            plan = again._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and " Exchange" not in plan
        finally:
            model_table.INLINE_LEVELS = before
    names = [r.feature for r in model_table.coefficients(given).collect()]
    assert sorted(names) == sorted(model.feature_names(fitted, train))


def test_the_better_family_is_chosen_and_kept(spark, stored):
    models = model_table.fit_all(training.side(stored, 0))
    measured = model_table.evaluate(models, training.side(stored, 1)).cache()
    chosen = model_table.select(models, measured)
    best = max(measured.collect(), key=lambda r: (r.average_precision, r.family == model_table.LOGISTIC))
    assert chosen.family == best.family
    spark.sql("create database if not exists kept_models")
    for family, given in models.items():
        model_table.save(given, f"kept_models.{family}")
        loaded = model_table.load(spark, f"kept_models.{family}")
        assert loaded.family == family
        one, two = (sorted(model_table.score(m, stored).collect()) for m in (given, loaded))
        assert one == two


def test_tasks_count_a_run_of_rows_by_value_before_spark_does(spark):
    rows = [(n, y, x, t) for n in (1, 2) for y in (True, False, None) for x in (0.0, -0.0, float("inf")) for t in ("0", "a")] * 3
    df = spark.createDataFrame(rows, "node long, y boolean, c0 double, c1 string").coalesce(1)
    run = df.mapInArrow(tree._count_cells(1), tree._COUNTS).count()
    assert run <= 2 * 5
    found = {tuple(r)[:4]: tuple(r)[4:] for r in tree.value_counts(df, 1).collect()}
    assert found == {(n, 0, x, None): (k, k) for n in (1, 2) for x, k in ((0.0, 12), (float("inf"), 6))} | {
        (n, 1, 0.0, t): (9, 9) for n in (1, 2) for t in ("0", "a")}
