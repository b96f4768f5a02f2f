"""The registered queries: every operator run over the whole test tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra import schema, standins
from prospectra.functions.values import clamped, column, flag_at, missing_to_zero, percent_text, segment, text_or_zero
from prospectra.operators import explain, features, label, metrics, model, model_table, prep, profile, publish, split, tree
from prospectra.plans import training
from prospectra.session import shared_folder, write_and_read_back
from prospectra.sources import landing, tables
from prospectra.standins import TARGET_PRODUCT

Query = Callable[[SparkSession, str], DataFrame]

# Dropped or holed on purpose, so that defaults and unmatched rows show.
ABSENT_REQUEST_COLUMNS = ("gender", "ape_sums", "travel")
HOLE = 10


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, dates as text: values that compare equal across engines."""
    out = []
    for f in df.schema.fields:
        value = column(f.name)
        if isinstance(f.dataType, T.DoubleType):
            value = F.round(value, digits)
        elif isinstance(f.dataType, T.DateType):
            value = value.cast("string")
        out.append(value.alias(f.name))
    return df.select(*out)


def _doubles(df: DataFrame) -> list[str]:
    return [c for c in features.numeric_columns(df) if isinstance(df.schema[c].dataType, T.DoubleType)]


# Tables and features -------------------------------------------------------

def feature_table(spark, sf_dir):
    return rounded(standins.stage1(spark, sf_dir))


def clean_features(spark, sf_dir):
    return rounded(standins.stage2(spark, sf_dir))


def target_accounts(spark, sf_dir):
    return label.target_accounts(standins.transactions(spark, sf_dir), TARGET_PRODUCT)


def target_accounts_semi(spark, sf_dir):
    return label.target_accounts_by_semi_join(standins.transactions(spark, sf_dir), TARGET_PRODUCT)


def normalize_columns(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias(" Client ID "), F.col("c_name").alias("Full Name"),
        F.col("c_acctbal").alias("ACCOUNT Balance"), F.col("c_mktsegment").alias("segment"))
    return landing.normalize_columns(raw)


def _landed(df: DataFrame, sep: str) -> str:
    """The frame as CSV files with a header, in the shared folder."""
    folder = f"{shared_folder(df.sparkSession)}/landing-{uuid.uuid4().hex}"
    df.write.options(header=True, sep=sep, quote='"', escape='"').csv(folder)
    return folder


def csv_transactions(spark, sf_dir):
    """Semicolons and blanks in names; line breaks and quotes in the descriptions."""
    rows = standins.transactions(spark, sf_dir)
    landed = rows.select(F.col(schema.ACCOUNT).alias("AccountID"),
                         F.concat(F.lit('say "'), schema.PRODUCT, F.lit('";\nnext')).alias("CNTTYPE desc"), "order_id")
    return landing.read_csv(spark, _landed(landed, ";"), ";", schema.transaction_schema().add("order_id", T.LongType()),
                            multi_line=True)


def csv_customers(spark, sf_dir):
    landed = _landed(standins.customer_360(spark, sf_dir), ",")
    return rounded(landing.read_csv(spark, landed, ",", schema.customer_schema()))


def table_roundtrip(spark, sf_dir):
    database = f"staging_{uuid.uuid4().hex}"
    tables.create_schema(spark, database, f"{shared_folder(spark)}/{database}")
    tables.write_table(standins.customer_360(spark, sf_dir), f"{database}.customer_360")
    tables.copy_table(spark, f"{database}.customer_360", f"{database}.customer_copy")
    return rounded(tables.read_table(spark, f"{database}.customer_copy"))


def swapped_table(spark, sf_dir):
    """A table shown in one step: first a part of the customers, then all of them, then read by its name."""
    database = f"swapped_{uuid.uuid4().hex}"
    tables.create_schema(spark, database, f"{shared_folder(spark)}/{database}")
    customers = standins.customer_360_table(spark, sf_dir)
    tables.swap_table(customers.where(F.col("gender") == "F"), f"{database}.customer_360")
    tables.swap_table(customers, f"{database}.customer_360")
    return rounded(tables.read_table(spark, f"{database}.customer_360"))


def preview(spark, sf_dir):
    return rounded(tables.preview(standins.stage1(spark, sf_dir), schema.ID, 10))


def conform_features(spark, sf_dir):
    requests = standins.stage2_table(spark, sf_dir).drop(*ABSENT_REQUEST_COLUMNS)
    return rounded(features.conform_features(requests))


def clean_values(spark, sf_dir):
    return rounded(features.clean_values(standins.stage2_table(spark, sf_dir)))


def row_ids(spark, sf_dir):
    numbered = features.with_row_ids(standins.customer_360(spark, sf_dir))
    return numbered.agg(F.count("*").alias("rows"), F.countDistinct("row_id").alias("ids"),
                        F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"))


# Profiling -----------------------------------------------------------------

def _profiled(operator: Callable[..., DataFrame], **kwargs) -> Query:
    def run(spark, sf_dir):
        return rounded(operator(standins.stage1_table(spark, sf_dir), **kwargs))
    return run


def boxplot_stats_doubles(spark, sf_dir):
    table = standins.stage1_table(spark, sf_dir)
    return rounded(profile.boxplot_stats(table, columns=_doubles(table)))


def top_k_coefficients(spark, sf_dir):
    """The k strongest features by correlation with the label, on either side."""
    table = standins.stage1_table(spark, sf_dir)
    matrix = profile.correlation(table, [*features.numeric_columns(table), schema.LABEL])
    slopes = (matrix.where((F.col("column_a") == schema.LABEL) & (F.col("column_b") != schema.LABEL))
              .select(F.col("column_b").alias("feature"), F.round("correlation", 9).alias("coefficient")))
    return rounded(metrics.top_and_bottom(slopes, "coefficient"))


def correlation_gaps_first(spark, sf_dir):
    """Rows sorted so that a column's first batches hold no value, and constants that are no binary fractions."""
    table = standins.stage1_table(spark, sf_dir)
    columns = [*_doubles(table), "tenth", "third"]
    table = table.withColumns({"tenth": F.lit(0.1), "third": F.lit(1.0) / 3})
    return rounded(profile.correlation(table.orderBy(F.col("ape_sums").asc_nulls_first(), schema.ID), columns))


def _merged_state(spark, sf_dir) -> DataFrame:
    """The state of the customers from three loads, each summarised alone: many, few and none."""
    table = standins.stage1_table(spark, sf_dir)
    third = column(schema.ID) % 3
    loads = [table.where(third > 0), table.where(third == 0), table.where(F.lit(False))]
    states = [profile.moment_state(load, features.numeric_columns(table)) for load in loads]
    return profile.merge_moments(states[0].unionByName(states[1]).unionByName(states[2]))


def merged_moments(spark, sf_dir):
    """Counts, moments and ranges of all customers, merged from the states of three loads."""
    return rounded(profile.moments_of(_merged_state(spark, sf_dir)))


def merged_correlation(spark, sf_dir):
    """The correlation of all customers, merged from the states of three loads."""
    return rounded(profile.correlation_of(_merged_state(spark, sf_dir)))


def feature_labels(spark, sf_dir):
    info = profile.column_info(standins.stage1_table(spark, sf_dir))
    return explain.labelled_features(info.select("column_name", "non_null"))


# Metrics -------------------------------------------------------------------

def _metric(name: str) -> Query:
    def run(spark, sf_dir):
        found = metrics.ranking_metrics(standins.scored(spark, sf_dir))
        return rounded(found.select("rows", "positives", name))
    return run


def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(standins.scored(spark, sf_dir))


def classification_report(spark, sf_dir):
    return metrics.classification_report(standins.scored(spark, sf_dir))


def cv_summary(spark, sf_dir):
    folds = split.assign_folds(standins.scored(spark, sf_dir))
    return rounded(metrics.cv_summary(metrics.ranking_metrics(folds, by=("fold",))))


def select_best(spark, sf_dir):
    """Two given score columns stand for the two families."""
    scored = standins.scored(spark, sf_dir)
    other = ((F.col(schema.ID) * 53) % 89 + 25 * F.col("y")).cast("double") / F.lit(114.0)
    both = scored.select("y", F.explode(F.array(
        F.struct(F.lit("logistic").alias("family"), F.col(schema.SCORE)),
        F.struct(F.lit("tree").alias("family"), other.alias(schema.SCORE)))).alias("s")).select("y", "s.*")
    return rounded(metrics.select_best(metrics.ranking_metrics(both, by=("family",))))


# Preparation ---------------------------------------------------------------

def impute(spark, sf_dir):
    return rounded(prep.impute(standins.stage2_table(spark, sf_dir)))


def standardize(spark, sf_dir):
    cleaned = features.clean_values(standins.stage2_table(spark, sf_dir))
    return rounded(prep.standardize(cleaned).select(schema.ID, *[
        column(c) for c in features.numeric_columns(cleaned)]))


def one_hot(spark, sf_dir):
    return prep.one_hot_long(standins.stage2_table(spark, sf_dir))


def class_weights(spark, sf_dir):
    return rounded(prep.class_weights(standins.stage2_table(spark, sf_dir)))


def _labelled_ids(spark, sf_dir):
    return standins.scored(spark, sf_dir).select(schema.ID, F.col("y").alias(schema.LABEL))


def split_hash(spark, sf_dir):
    return split.split_by_hash(_labelled_ids(spark, sf_dir))


def split_exact(spark, sf_dir):
    return split.split_exact(_labelled_ids(spark, sf_dir))


def kfold_assign(spark, sf_dir):
    return split.assign_folds(_labelled_ids(spark, sf_dir))


def kfold_exact(spark, sf_dir):
    return split.folds_exact(_labelled_ids(spark, sf_dir))


# Scores and explanations ---------------------------------------------------

def _linear_scored(spark, sf_dir) -> DataFrame:
    table = features.clean_values(standins.stage2_table(spark, sf_dir))
    score = model.score_linear(table, standins.LINEAR_WEIGHTS, standins.LINEAR_INTERCEPT)
    return table.withColumn(schema.SCORE, score)


def score_linear(spark, sf_dir):
    return rounded(_linear_scored(spark, sf_dir).select(
        schema.ID, schema.SCORE, flag_at(F.col(schema.SCORE)).alias(schema.FLAG)))


def scored_sink(spark, sf_dir):
    """The scored table, written to the catalog and read back."""
    database = f"scores_{uuid.uuid4().hex}"
    tables.create_schema(spark, database, f"{shared_folder(spark)}/{database}")
    tables.write_table(score_linear(spark, sf_dir), f"{database}.scored")
    return tables.read_table(spark, f"{database}.scored")


def flag_scores(spark, sf_dir):
    scored = standins.scored(spark, sf_dir)
    score = F.col(schema.SCORE)
    return rounded(scored.select(schema.ID, schema.SCORE, flag_at(score).alias(schema.FLAG),
                                 flag_at(score, schema.CLASS_THRESHOLD).alias("predicted")))


def segments(spark, sf_dir):
    """Scores stretched beyond [0, 1], some NaN and some NULL, so that every guard is used."""
    client = F.col(schema.ID)
    score = (F.when(client % 13 == 0, F.lit(None).cast("double")).when(client % 11 == 0, F.lit(float("nan")))
             .otherwise(F.col(schema.SCORE) * 1.5 - 0.25))
    scored = standins.scored(spark, sf_dir).select(schema.ID, score.alias(schema.SCORE))
    return rounded(scored.select(
        schema.ID, clamped(F.col(schema.SCORE)).alias("clamped"),
        segment(F.col(schema.SCORE)).alias("segment")))


def percent_labels(spark, sf_dir):
    return standins.scored(spark, sf_dir).select(
        schema.ID, percent_text(F.col("score_i").cast("double") / 128).alias("percent"))


def explanations(spark, sf_dir):
    scored = explain.with_explanations(_linear_scored(spark, sf_dir))
    return scored.select(
        schema.ID, F.array_join("explanations", " | ").alias("explanations"),
        F.array_join(explain.explanation_rules(F.col(schema.SCORE)), ",").alias("rules"),
        F.size("explanations").cast("bigint").alias("sentences"))


def explanation_counts(spark, sf_dir):
    return explain.explanation_counts(_linear_scored(spark, sf_dir))


def driver_texts(spark, sf_dir):
    """The strongest given coefficients, their texts, and how many customers have each."""
    given = spark.createDataFrame(list(standins.LINEAR_WEIGHTS.items()), "feature string, coefficient double")
    drivers = explain.key_drivers(given, k=3)
    texts = spark.createDataFrame(list(standins.DRIVER_TEXTS.items()), "feature string, text string")
    held = explain.active_drivers(standins.stage2_table(spark, sf_dir), list(standins.LINEAR_WEIGHTS))
    return explain.driver_texts(drivers, texts).join(held, "feature").select("feature", "text", "customers")


def prospects(spark, sf_dir):
    return rounded(publish.prospects(score_linear(spark, sf_dir), standins.customer_360_table(spark, sf_dir)))


def prospects_unmatched(spark, sf_dir):
    """Every tenth scored row gets an id that no customer has."""
    unknown = F.when(column(schema.ID) % HOLE == 0, -column(schema.ID)).otherwise(column(schema.ID))
    scored = score_linear(spark, sf_dir).withColumn(schema.ID, unknown)
    return rounded(publish.unmatched_prospects(scored, standins.customer_360_table(spark, sf_dir)))


# Models --------------------------------------------------------------------

@functools.cache
def _split_for(application: str, sf_dir: str) -> DataFrame:
    table = standins.stage2_table(SparkSession.active(), sf_dir)
    return training.split_table(table)


def _split_table(spark, sf_dir) -> DataFrame:
    return _split_for(spark.sparkContext.applicationId, sf_dir)


@functools.cache
def _fitted_for(application: str, sf_dir: str) -> training.Trained:
    return training.train_and_select(_split_for(application, sf_dir))


def train_folds(spark, sf_dir):
    """Which side and fold each customer is in, as every training job has it."""
    return _split_table(spark, sf_dir).select(schema.ID, schema.LABEL, F.col("is_test").cast("int"), F.col("fold").cast("int"))


def _trained(spark, sf_dir, family: str):
    train = training.side(_split_table(spark, sf_dir), 0)
    return model.fit_all(train, families=(family,))[family], train


def _slots(spark, names) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "slot int, feature string")


def train_logistic(spark, sf_dir):
    """Per slot: whether the fitted coefficients are at the optimum of the penalised loss."""
    fitted, train = _trained(spark, sf_dir, "logistic")
    last, slots = fitted.stages[-1], model.feature_names(fitted, train)
    vectors = PipelineModel(stages=fitted.stages[:-1]).transform(prep.with_class_weights(train))
    at = F.aggregate(F.zip_with("x", F.lit(last.coefficients.toArray().tolist()), lambda x, b: x * b), F.lit(last.intercept),
                     lambda total, t: total + t)
    rows = vectors.select(vector_to_array(prep.FEATURES).alias("x"), prep.WEIGHT, schema.LABEL)
    residuals = rows.select("x", (F.col(prep.WEIGHT) * (1 / (1 + F.exp(-at)) - column(schema.LABEL))).alias("r"))
    sums = residuals.select(F.posexplode("x").alias("slot", "v"), "r").groupBy("slot").agg(
        F.sum(F.col("v") * F.col("r")).alias("pull"), F.count("*").alias("n"))
    penalty = F.element_at(F.lit(last.coefficients.toArray().tolist()), F.col("slot") + 1)
    return sums.join(_slots(spark, slots), "slot").select(
        "feature", (F.abs((F.col("pull") + penalty) / F.col("n")) < 1e-4).alias("at_optimum"))


def train_tree(spark, sf_dir):
    """The leaves of the fitted tree over its training rows, and its depth."""
    fitted, train = _trained(spark, sf_dir, "tree")
    last = fitted.stages[-1].copy().setLeafCol("leaf")
    leaves = PipelineModel(stages=[*fitted.stages[:-1], last]).transform(train).groupBy("leaf").count()
    return leaves.agg(F.sum("count").alias("rows"), (F.min("count") >= model.TREE_LEAF_ROWS).alias("leaves_are_large"),
                      F.lit(last.depth <= model.TREE_DEPTH).alias("depth_is_bounded"))


@functools.cache
def _exact_tree_for(application: str, sf_dir: str) -> tuple[tree.Node, ...]:
    return tuple(tree.fit(training.side(_split_for(application, sf_dir), 0)))


def _exact_tree(spark, sf_dir) -> tuple[tree.Node, ...]:
    return _exact_tree_for(spark.sparkContext.applicationId, sf_dir)


def exact_tree(spark, sf_dir):
    """The nodes of the exact-split tree: cuts, gains, rows of each class, impurities."""
    return rounded(tree.node_table(spark, _exact_tree(spark, sf_dir)))


def exact_tree_importances(spark, sf_dir):
    return rounded(tree.importances(tree.node_table(spark, _exact_tree(spark, sf_dir))))


def exact_tree_scores(spark, sf_dir):
    """Every customer's leaf, score and flag by the exact-split tree, as one native expression."""
    nodes = _exact_tree(spark, sf_dir)
    table = features.clean_values(standins.stage2_table(spark, sf_dir))
    scored = table.select(schema.ID, tree.place_of(nodes).alias("leaf"), tree.probability(nodes).alias(schema.SCORE))
    return rounded(scored.withColumn(schema.FLAG, flag_at(F.col(schema.SCORE))))


def _tested_by_exact_tree(spark, sf_dir) -> DataFrame:
    test = training.side(_split_table(spark, sf_dir), 1)
    return test.select(column(schema.LABEL).alias("y"), tree.probability(_exact_tree(spark, sf_dir)).alias(schema.SCORE))


def exact_tree_metrics(spark, sf_dir):
    """ROC-AUC and average precision of the exact-split tree on the test side."""
    return rounded(metrics.ranking_metrics(_tested_by_exact_tree(spark, sf_dir)))


def exact_tree_report(spark, sf_dir):
    """Precision, recall and F1 of the exact-split tree on the test side."""
    return metrics.classification_report(_tested_by_exact_tree(spark, sf_dir))


@functools.cache
def _model_tables_for(application: str, sf_dir: str) -> tuple[dict[str, model_table.ModelTable], DataFrame]:
    stored = _split_for(application, sf_dir)
    models = model_table.fit_all(training.side(stored, 0))
    return models, write_and_read_back(model_table.evaluate(models, training.side(stored, 1)), "metrics")


def _model_tables(spark, sf_dir):
    return _model_tables_for(spark.sparkContext.applicationId, sf_dir)


def model_metrics(spark, sf_dir):
    """Both families on the test side, and which of them is chosen."""
    models, measured = _model_tables(spark, sf_dir)
    chosen = model_table.select(models, measured).family
    return measured.withColumn("chosen", F.col("family") == chosen)


def chosen_model(spark, sf_dir):
    """The chosen model's table, kept in the catalog and read back."""
    database = f"models_{uuid.uuid4().hex}"
    tables.create_schema(spark, database, f"{shared_folder(spark)}/{database}")
    model_table.save(model_table.select(*_model_tables(spark, sf_dir)), f"{database}.chosen")
    return tables.read_table(spark, f"{database}.chosen")


def chosen_model_scores(spark, sf_dir):
    """Score and flag of every customer by the chosen model."""
    table = features.clean_values(standins.stage2_table(spark, sf_dir))
    return model_table.score(model_table.select(*_model_tables(spark, sf_dir)), table)


def chosen_model_report(spark, sf_dir):
    """The chosen model's report on the test side."""
    chosen = model_table.select(*_model_tables(spark, sf_dir))
    scored = model_table.with_score(chosen, training.side(_split_table(spark, sf_dir), 1), (schema.LABEL,))
    return metrics.classification_report(scored, schema.LABEL)


def logistic_coefficients(spark, sf_dir):
    """Every slot's coefficient."""
    return model_table.coefficients(_model_tables(spark, sf_dir)[0][model_table.LOGISTIC])


def exact_coefficients(spark, sf_dir):
    """Coefficients and intercept of the logistic model at its optimum, by second-order steps."""
    return model.exact_coefficients(training.side(_split_table(spark, sf_dir), 0))


def logistic_top_coefficients(spark, sf_dir):
    """The strongest coefficients on either side."""
    return metrics.top_and_bottom(logistic_coefficients(spark, sf_dir), "coefficient")


def fitted_drivers(spark, sf_dir):
    """The fitted model's key drivers, their texts, and how many customers have each."""
    drivers = explain.key_drivers(logistic_coefficients(spark, sf_dir))
    names = [r["feature"] for r in drivers.select("feature").collect()]
    held = explain.active_drivers(standins.stage2_table(spark, sf_dir), names)
    return explain.driver_texts(drivers).join(held, "feature", "left").select(
        "feature", "coefficient", "rank", "text", F.coalesce("customers", F.lit(0)).alias("customers"))


@functools.cache
def _cross_validated_for(application: str, sf_dir: str) -> DataFrame:
    return write_and_read_back(training.cross_validate(_split_for(application, sf_dir)), "cv-metrics")


def cv_metrics(spark, sf_dir):
    """ROC-AUC and average precision of each family and fold."""
    return _cross_validated_for(spark.sparkContext.applicationId, sf_dir)


def cv_means(spark, sf_dir):
    """Mean and deviation over the folds, per family."""
    return metrics.cv_summary(cv_metrics(spark, sf_dir), by=("family",))


def coefficients(spark, sf_dir):
    """The slots of the model's own encoder in order: numbers, then the levels of each text column."""
    fitted, train = _trained(spark, sf_dir, "logistic")
    finite = model.coefficients(fitted, train).where(F.abs("coefficient") < float("inf"))
    return finite.join(_slots(spark, model.feature_names(fitted, train)), "feature").select("slot", "feature")


def importances(spark, sf_dir):
    fitted, train = _trained(spark, sf_dir, "tree")
    return model.importances(fitted, train).agg(
        F.count("*").alias("slots"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sum_is_one"),
        (F.min("importance") >= 0).alias("none_negative"))


def _in_range(*names: str):
    return F.forall(F.array(*names), lambda v: v.isNotNull() & (v >= 0) & (v <= 1))


def cv_scores(spark, sf_dir):
    found = _cross_validated_for(spark.sparkContext.applicationId, sf_dir)
    return found.select("family", "fold", "rows", "positives",
                        _in_range("roc_auc", "average_precision").alias("metrics_in_range"))


def train_and_select(spark, sf_dir):
    """Both families on the test side, and whether the chosen one is the best by average precision."""
    trained = _fitted_for(spark.sparkContext.applicationId, sf_dir)
    best = F.max("average_precision").over(Window.partitionBy())
    chosen = F.col("family") == trained.family
    return trained.metrics.select("family", "rows", "positives", "average_precision", chosen.alias("chosen"), best.alias("best")).select(
        "family", "rows", "positives", (~F.col("chosen") | (F.col("average_precision") == F.col("best"))).alias("choice_is_best"))


def model_report(spark, sf_dir):
    """Rows of each class on the test side, as the chosen model's report counts them."""
    trained = _fitted_for(spark.sparkContext.applicationId, sf_dir)
    report = training.report_on_test(trained, _split_table(spark, sf_dir))[0]
    return report.where(F.col("class").isin("0", "1")).select("class", "support")


def score_batch(spark, sf_dir):
    """Per customer: the score is a probability, the flag follows it, and the exported coefficients give it again."""
    fitted, train = _trained(spark, sf_dir, "logistic")
    table = features.clean_values(standins.stage2_table(spark, sf_dir))
    scaler, last = fitted.stages[1], fitted.stages[-1]
    values = dict(zip(model.feature_names(fitted, train), last.coefficients.toArray().tolist()))
    total = F.lit(last.intercept)
    for c, mean, scale in zip(scaler.numeric_columns(), scaler.getOrDefault(scaler.means), scaler.getOrDefault(scaler.scales)):
        total = total + (missing_to_zero(column(c)) - mean) / scale * values[c]
    for c in features.categorical_columns(table):
        levels = {n[len(c) + 1:]: v for n, v in values.items() if n.startswith(f"{c}_") and n not in table.columns}
        known = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
        total = total + F.coalesce(F.try_element_at(known, text_or_zero(column(c))), F.lit(0.0))
    again = table.select(column(schema.ID).alias("_id"), (1 / (1 + F.exp(-total))).alias("_again"))
    scored = model.score_batch(fitted, table).join(again, column(schema.ID) == F.col("_id"))
    score = F.col(schema.SCORE)
    return scored.select(schema.ID, ((score >= 0) & (score <= 1)).alias("in_range"),
                         (F.col(schema.FLAG) == (score >= schema.FLAG_THRESHOLD).cast("int")).alias("flag_follows"),
                         (F.abs(score - F.col("_again")) < 1e-9).alias("coefficients_agree"))


QUERIES: dict[str, Query] = {
    "feature_table": feature_table,
    "target_accounts": target_accounts,
    "target_accounts_semi": target_accounts_semi,
    "clean_features": clean_features,
    "normalize_columns": normalize_columns,
    "csv_transactions": csv_transactions,
    "csv_customers": csv_customers,
    "table_roundtrip": table_roundtrip,
    "swapped_table": swapped_table,
    "preview": preview,
    "conform_features": conform_features,
    "clean_values": clean_values,
    "row_ids": row_ids,
    "class_distribution": _profiled(profile.class_distribution),
    "imbalance_ratio": _profiled(profile.imbalance_ratio),
    "missing_counts": _profiled(profile.missing_counts),
    "column_info": _profiled(profile.column_info),
    "column_kinds": _profiled(profile.column_kinds),
    "describe_numeric": _profiled(profile.describe_numeric),
    "describe_categorical": _profiled(profile.describe_categorical),
    "histogram": _profiled(profile.histogram),
    "top_categories": _profiled(profile.top_categories),
    "correlation": _profiled(profile.correlation),
    "correlation_gaps_first": correlation_gaps_first,
    "merged_moments": merged_moments,
    "merged_correlation": merged_correlation,
    "boxplot_stats": _profiled(profile.boxplot_stats),
    "boxplot_stats_doubles": boxplot_stats_doubles,
    "target_rate": _profiled(profile.target_rate),
    "top_k_coefficients": top_k_coefficients,
    "feature_labels": feature_labels,
    "confusion_matrix": confusion_matrix,
    "classification_report": classification_report,
    "roc_auc": _metric("roc_auc"),
    "average_precision": _metric("average_precision"),
    "cv_summary": cv_summary,
    "select_best": select_best,
    "impute": impute,
    "standardize": standardize,
    "one_hot": one_hot,
    "class_weights": class_weights,
    "split_hash": split_hash,
    "split_exact": split_exact,
    "kfold_assign": kfold_assign,
    "kfold_exact": kfold_exact,
    "train_folds": train_folds,
    "score_linear": score_linear,
    "scored_sink": scored_sink,
    "flag_scores": flag_scores,
    "segments": segments,
    "percent_labels": percent_labels,
    "explanations": explanations,
    "explanation_counts": explanation_counts,
    "driver_texts": driver_texts,
    "prospects": prospects,
    "prospects_unmatched": prospects_unmatched,
    "train_logistic": train_logistic,
    "train_tree": train_tree,
    "exact_tree": exact_tree,
    "exact_tree_importances": exact_tree_importances,
    "exact_tree_scores": exact_tree_scores,
    "exact_tree_metrics": exact_tree_metrics,
    "exact_tree_report": exact_tree_report,
    "model_metrics": model_metrics,
    "chosen_model": chosen_model,
    "chosen_model_scores": chosen_model_scores,
    "chosen_model_report": chosen_model_report,
    "logistic_coefficients": logistic_coefficients,
    "exact_coefficients": exact_coefficients,
    "logistic_top_coefficients": logistic_top_coefficients,
    "fitted_drivers": fitted_drivers,
    "cv_metrics": cv_metrics,
    "cv_means": cv_means,
    "coefficients": coefficients,
    "importances": importances,
    "cv_scores": cv_scores,
    "train_and_select": train_and_select,
    "model_report": model_report,
    "score_batch": score_batch,
}
