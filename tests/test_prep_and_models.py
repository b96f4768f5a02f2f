"""Splits, preparation, training, comparison, scoring, saving."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from prospectra import schema, standins
from prospectra.operators import features, metrics, model, prep, split
from prospectra.plans import scoring, training
from prospectra.sources import model_store


@pytest.fixture(scope="module")
def labelled(spark):
    """2,000 ids, 40 positives, one id with 500 copies."""
    base = spark.range(1500).select(F.col("id").alias("client_id"), (F.col("id") < 40).cast("int").alias("is_target_customer"))
    hot = spark.range(500).select(F.lit(99_999).cast("long").alias("client_id"), F.lit(0).alias("is_target_customer"))
    return base.unionByName(hot)


def test_hash_split_keeps_copies_together_and_is_stable(labelled):
    a = {tuple(r) for r in split.split_by_hash(labelled).distinct().collect()}
    b = {tuple(r) for r in split.split_by_hash(labelled.repartition(11)).distinct().collect()}
    assert a == b and len(a) == 1501


def test_exact_split_holds_the_class_share(labelled):
    unique = labelled.where("client_id < 99999")
    shares = {r.is_target_customer: (r.n, r.t) for r in split.split_exact(unique).groupBy("is_target_customer")
              .agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect()}
    assert shares == {0: (1460, 292), 1: (40, 8)}
    folds = split.folds_exact(unique).groupBy("is_target_customer", "fold").count().collect()
    assert len(folds) == 10 and {r["count"] for r in folds} == {292, 8}


def test_exact_split_does_not_tear_a_hot_id(labelled):
    out = split.split_exact(labelled)
    assert out.count() == 2000
    assert out.where("client_id = 99999").select("is_test").distinct().count() == 1


def test_folds_cover_everything_once(labelled):
    out = split.assign_folds(labelled)
    assert out.count() == 2000 and {r.fold for r in out.select("fold").distinct().collect()} == set(range(5))


def test_fold_without_positives_has_no_metric(spark):
    df = spark.createDataFrame([(f, int(f == 0 and i == 0), i / 4) for f in range(2) for i in range(4)],
                               "fold int, y int, score double")
    by_fold = metrics.ranking_metrics(df, by=("fold",))
    assert {r.fold: r.average_precision for r in by_fold.collect()}[1] is None
    assert metrics.cv_summary(by_fold).first().folds == 2


def test_scaler_uses_population_deviation_and_survives_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0)], "x double, k double")
    out = prep.standardize(df, ["x", "k"]).collect()
    x = np.array([1.0, 2.0, 0.0])
    assert [r.x for r in out] == pytest.approx(list((x - x.mean()) / x.std()))
    assert [r.k for r in out] == [0.0, 0.0, 0.0]


def test_unseen_level_is_all_zero(spark):
    fit_on = spark.createDataFrame([("a",), ("b",), ("0",)], "c string")
    apply_to = spark.createDataFrame([("a",), (None,), ("new",)], "c string")
    fitted = Pipeline(stages=prep.preparation_stages(fit_on, ())).fit(fit_on)
    vectors = [list(r.v) for r in fitted.transform(apply_to).select(vector_to_array("features").alias("v")).collect()]
    assert vectors == [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0]]


def test_columns_with_too_many_levels_are_refused_by_name(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("free"), F.lit("a").alias("fixed"))
    assert {r.column_name: r.levels for r in prep.level_counts(df, ["free", "fixed"]).collect()} == {"free": 50, "fixed": 1}
    with pytest.raises(ValueError, match=r"free \(50\)"):
        prep.preparation_stages(df, (), most_levels=10)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "is_target_customer int")
    assert {r[0]: r.weight for r in prep.class_weights(df).collect()} == {0: pytest.approx(4 / 6), 1: 2.0}


@pytest.fixture(scope="module")
def stored(spark):
    return training.split_table(features.clean_features(standins.stage1_table(spark, "/root/testdata/sf0.01")))


@pytest.fixture(scope="module")
def trained(stored):
    return training.train_and_select(stored)


@pytest.fixture(scope="module")
def fitted(stored):
    return model.fit_all(training.side(stored, 0))


def matrix(fitted, df):
    """Vectors, labels and balanced weights of the training rows as arrays."""
    vectors = model.PipelineModel(stages=fitted.stages[:-1]).transform(df)
    rows = vectors.select(vector_to_array("features").alias("v"), schema.LABEL).collect()
    x, y = np.array([r.v for r in rows]), np.array([r[schema.LABEL] for r in rows])
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    return x, y, w


def test_logistic_reaches_the_optimum_of_the_penalised_loss(stored, fitted):
    train = training.side(stored, 0)
    x, y, w = matrix(fitted["logistic"], train)
    lr = fitted["logistic"].stages[-1]
    beta, b0 = lr.coefficients.toArray(), lr.intercept
    residual = w * (1 / (1 + np.exp(-(x @ beta + b0))) - y)
    gradient = np.append(x.T @ residual + beta, residual.sum()) / len(y)
    assert np.abs(gradient).max() < 1e-4


def test_tree_limits(stored, fitted):
    train = training.side(stored, 0)
    tree = fitted["tree"].stages[-1]
    assert tree.depth <= 5
    scored = fitted["tree"].transform(train)
    leaves = scored.groupBy("rawPrediction").count().collect()
    assert min(r["count"] for r in leaves) >= 50
    table = {r.feature: r.importance for r in model.importances(fitted["tree"], train).collect()}
    assert sum(table.values()) == pytest.approx(1.0)


def test_feature_names_follow_the_vector(stored, fitted):
    train = training.side(stored, 0)
    names = model.feature_names(fitted["logistic"], train)
    assert len(names) == fitted["logistic"].stages[-1].coefficients.size
    assert names[:1] == ["le17"] and "gender_F" in names and "marital_status_0" in names
    assert "client_id" not in names and schema.LABEL not in names


def test_selection_takes_the_higher_average_precision(trained):
    rows = {r.family: r for r in trained.metrics.collect()}
    assert set(rows) == {"logistic", "tree"}
    best = max(rows.values(), key=lambda r: (r.average_precision, r.family == "logistic"))
    assert trained.family == best.family
    assert all(0.5 < r.roc_auc <= 1 for r in rows.values())


def test_sides_do_not_overlap(stored):
    train, test = training.side(stored, 0), training.side(stored, 1)
    assert train.count() + test.count() == 1500
    assert train.join(test, "client_id", "left_semi").count() == 0


def test_reading_one_side_prunes_directories(stored):
    plan = training.side(stored, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(is_test" in plan


def test_scores_are_probabilities_of_all_rows_without_python(spark, trained):
    table = features.clean_features(standins.stage1_table(spark, "/root/testdata/sf0.01"))
    out = scoring.score_table(trained.model, table)
    assert out.columns == ["client_id", "score", "flag"]
    rows = out.collect()
    assert len(rows) == 1500 and all(0 <= r.score <= 1 and r.flag == int(r.score >= 0.2) for r in rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_scoring_without_an_id_numbers_the_rows(spark, trained):
    table = features.clean_features(standins.stage1_table(spark, "/root/testdata/sf0.01")).drop("client_id")
    out = scoring.score_table(trained.model, table)
    assert sorted(r.row_id for r in out.collect()) == list(range(1500))


def test_saved_model_scores_the_same(spark, stored, trained, tmp_path):
    rows = training.side(stored, 1)
    spark.sql("create database if not exists runs_db")
    run_id = model_store.save_model(trained.model, str(tmp_path / "m"), trained.family, rows.drop(schema.LABEL),
                                    {"test_roc_auc": 0.5, "test_pr_auc": 0.25}, "client_id", "runs_db.model_runs")
    loaded = model_store.load_model(spark, str(tmp_path / "m"))
    assert loaded.family == trained.family
    a = model.score_batch(trained.model, rows).orderBy("client_id").collect()
    b = model.score_batch(loaded.model, rows).orderBy("client_id").collect()
    assert a == b
    model_store.check_signature(rows, loaded.signature)
    with pytest.raises(ValueError, match="travel"):
        model_store.check_signature(rows.drop("travel"), loaded.signature)
    noted = model_store.runs(spark, "runs_db.model_runs").where(F.col("run_id") == run_id).first()
    assert (noted.test_roc_auc, noted.test_pr_auc) == (0.5, 0.25)
    assert spark.read.parquet(str(tmp_path / "m" / run_id / "example")).count() == 5
    newer = model_store.save_model(trained.model, str(tmp_path / "m"), "tree", rows.drop(schema.LABEL), {}, "client_id")
    assert newer != run_id and model_store.load_model(spark, str(tmp_path / "m")).family == "tree"


def test_id_can_be_kept_as_a_feature(stored):
    train = training.side(stored, 0)
    fitted = model.fit_all(train, exclude=(), families=("tree",))["tree"]
    assert model.feature_names(fitted, train)[0] == "client_id"


def test_cross_validation_gives_each_family_and_fold(stored):
    out = training.cross_validate(stored, families=("tree",)).collect()
    assert sorted((r.family, r.fold) for r in out) == [("tree", f) for f in range(5)]
    held = training.side(stored, 0).count()
    assert sum(r["rows"] for r in out) == held


def test_report_covers_the_test_side(stored, trained):
    report, cells = training.report_on_test(trained, stored)
    n = training.side(stored, 1).count()
    assert sum(r["count"] for r in cells.collect()) == n
    assert {r["class"]: r.support for r in report.collect()}["accuracy"] == n


def test_exact_split_table(spark):
    table = standins.stage2_table(spark, "/root/testdata/sf0.01")
    out = training.split_table(table, exact=True)
    shares = {(r[schema.LABEL], r.is_test): r["count"] for r in out.groupBy(schema.LABEL, "is_test").count().collect()}
    assert shares == {(0, 0): 935, (0, 1): 234, (1, 0): 265, (1, 1): 66}
    for side in (0, 1):
        for label in (0, 1):
            folds = [r["count"] for r in out.where((F.col("is_test") == side) & (F.col(schema.LABEL) == label))
                     .groupBy("fold").count().collect()]
            assert len(folds) == 5 and max(folds) - min(folds) <= 1


@pytest.mark.parametrize("odd", [None, 2])
def test_labels_other_than_0_and_1_are_refused(spark, odd):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 1, 2.0), (3, odd, 3.0)], "client_id long, is_target_customer int, x double")
    with pytest.raises(ValueError, match="1 rows have a label"):
        training.split_table(df)


@pytest.mark.parametrize("exact", [True, False])
def test_training_rows_are_marked_by_the_saved_split(spark, trained, exact):
    table = standins.stage2_table(spark, "/root/testdata/sf0.01")
    marked = training.split_table(table, exact=exact)
    how = {"kind": "exact" if exact else "hash", "seed": split.SEED, "cuts": split.class_cuts(marked) if exact else {}}
    out = scoring.score_table(trained.model, table, how=how)
    both = out.join(marked.select("client_id", "is_test"), "client_id")
    assert both.count() == 1500 and both.where(F.col("is_train") == F.col("is_test")).count() == 0


def test_preparation_without_a_fold_is_that_of_the_others(spark):
    rows = [(i, i % 5, int(i % 7 == 0), 0.1, None if i % 11 == 0 else i * 0.37, "x" if i % 3 else None, f"r{i % 5}" if i % 2 else "a")
            for i in range(200)]
    df = spark.createDataFrame(rows, "client_id long, fold int, is_target_customer int, same double, x double, c string, per_fold string")
    left_out = prep.leave_one_out(df, "fold", range(5), schema.LABEL, ("client_id",))
    for k in range(5):
        others = df.where(F.col("fold") != k)
        by_hand = model.prepare(others.drop("fold"))
        shared = model.prepare_left_out(others, left_out[k])
        assert shared.weight_sum == by_hand.weight_sum
        assert model.slot_names(shared.stages, df) == model.slot_names(by_hand.stages, df.drop("fold"))
        a, b = (np.array(sorted([*r.v, r.label__, r.class_weight] for r in p.vectors.select(
            vector_to_array("features").alias("v"), "label__", "class_weight").collect())) for p in (shared, by_hand))
        assert np.allclose(a, b, rtol=1e-12, atol=1e-12)
        assert (a[:, 0] == 0).all()


def test_left_out_levels_beyond_the_limit_are_refused_by_name(spark):
    df = spark.range(50).select("id", (F.col("id") % 5).cast("int").alias("fold"), F.lit(0).alias("y"),
                                F.col("id").cast("string").alias("free"), F.lit("a").alias("fixed"))
    with pytest.raises(ValueError, match=r"free \(40\)"):
        prep.leave_one_out(df, "fold", range(5), "y", ("id",), most_levels=10)


def test_a_constant_column_merges_to_deviation_0():
    assert prep.merged_moments([(3, 0.1, 0.0), (7, 0.1, 0.0), (11, 0.1, 0.0)]) == (0.1, 0.0)
    x = np.arange(40) ** 2 / 7
    mean, deviation = prep.merged_moments([(len(p), p.mean(), p.std()) for p in (x[:3], x[3:17], x[17:])])
    assert (mean, deviation) == (pytest.approx(x.mean(), rel=1e-14), pytest.approx(x.std(), rel=1e-14))


def test_shared_scores_equal_each_model_alone(stored, fitted):
    test = training.side(stored, 1)
    both = model.with_scores(fitted, test, (schema.ID,))
    for family, one in fitted.items():
        alone = {r[0]: r.score for r in model.with_score(one, test, (schema.ID,)).collect()}
        assert {r[0]: r.score for r in both.where(F.col("family") == family).collect()} == alone


def test_cross_validation_prepares_all_folds_together(spark, stored):
    context = spark.sparkContext
    context.setJobGroup("folds", "preparation")
    prep.leave_one_out(stored.where("is_test = 0").drop("is_test"), "fold", range(5))
    jobs = len(context.statusTracker().getJobIdsForGroup("folds"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 20
