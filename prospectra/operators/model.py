"""Training, comparison and reading of the two classifiers."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra import schema
from prospectra.functions.values import column, flag_at, missing_to_zero
from prospectra.operators import metrics, newton, prep, split

# The two families and their settings.
FAMILIES = ("logistic", "tree")
LOGISTIC_ITERATIONS = 800
TREE_DEPTH = 5
TREE_LEAF_ROWS = 50
# Candidate cut points per feature; the tree is exact for columns with fewer values.
TREE_BINS = 128
_LABEL = "label__"


def classifier(family: str, weight_sum: float):
    """An unfitted classifier on ``features``.

    The logistic penalty equals a unit penalty on the summed loss, hence the
    division by the sum of weights, over which Spark averages the loss.
    """
    shared = dict(featuresCol=prep.FEATURES, labelCol=_LABEL, weightCol=prep.WEIGHT)
    if family == "logistic":
        return LogisticRegression(maxIter=LOGISTIC_ITERATIONS, regParam=1.0 / weight_sum, elasticNetParam=0.0,
                                  standardization=False, tol=1e-8, family="binomial", **shared)
    if family == "tree":
        return DecisionTreeClassifier(maxDepth=TREE_DEPTH, minInstancesPerNode=TREE_LEAF_ROWS, maxBins=TREE_BINS,
                                      seed=split.SEED, **shared)
    raise ValueError(f"unknown family: {family}")


class Prepared(NamedTuple):
    """A fitted preparation and the weighted vectors it makes of the training rows."""
    stages: PipelineModel
    vectors: DataFrame
    weight_sum: float


def prepare(train: DataFrame, label: str = schema.LABEL,
            exclude: Sequence[str] = (schema.ID,)) -> Prepared:
    """Fit the preparation once for all families.

    Training reads its rows dozens of times, so ``train`` should be a stored
    table; the vectors are kept on the executors and spill to disk.
    """
    stages = Pipeline(stages=prep.preparation_stages(train, (*exclude, label))).fit(train)
    weighted = prep.with_class_weights(stages.transform(train), label)
    vectors = weighted.select(column(label).cast("double").alias(_LABEL), prep.WEIGHT, prep.FEATURES).persist()
    # Balanced weights add up to the number of rows.
    return Prepared(stages, vectors, float(vectors.count()))


def prepare_left_out(train: DataFrame, left_out: prep.LeftOut, label: str = schema.LABEL) -> Prepared:
    """The weighted vectors of the other folds' rows, by a preparation that is fitted already."""
    weighted = left_out.stages.transform(train).withColumn(prep.WEIGHT, prep.class_weight(label, left_out.weights))
    vectors = (weighted.select(column(label).cast("double").alias(_LABEL), prep.WEIGHT, prep.FEATURES)
               .where(F.col(prep.WEIGHT).isNotNull()).persist())
    return Prepared(left_out.stages, vectors, float(left_out.rows))


def fit(prepared: Prepared, family: str) -> PipelineModel:
    fitted = classifier(family, prepared.weight_sum).fit(prepared.vectors)
    return PipelineModel(stages=[*prepared.stages.stages, fitted])


def fit_all(train: DataFrame, label: str = schema.LABEL, exclude: Sequence[str] = (schema.ID,),
            families: Iterable[str] = FAMILIES) -> dict[str, PipelineModel]:
    return fit_prepared(prepare(train, label, exclude), families)


def fit_prepared(prepared: Prepared, families: Iterable[str] = FAMILIES) -> dict[str, PipelineModel]:
    """A model per family; the prepared vectors are let go of afterwards."""
    try:
        return {family: fit(prepared, family) for family in families}
    finally:
        prepared.vectors.unpersist()


def with_score(model: PipelineModel, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """The kept columns (all by default) and ``score``, the probability of class 1."""
    # The stages rewrite the feature columns, so they work on a copy.
    keep = list(keep if keep is not None else df.columns)
    source = df.withColumn("_kept", F.struct(*[column(c).alias(f"k{i}") for i, c in enumerate(keep)]))
    scored = model.transform(source)
    probability = vector_to_array("probability")[1]
    return scored.select(*[F.col(f"_kept.k{i}").alias(c) for i, c in enumerate(keep)],
                         probability.alias(schema.SCORE))


def with_scores(models: Mapping[str, PipelineModel], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(kept columns, family, score) for every row and model; the models share their preparation,
    so that each row is read and made a vector once."""
    source = df.withColumn("_kept", F.struct(*[column(c).alias(f"k{i}") for i, c in enumerate(keep)]))
    stages = next(iter(models.values())).stages[:-1]
    scored = PipelineModel(stages=stages).transform(source).select("_kept", prep.FEATURES)
    for family, fitted in models.items():
        # Nothing but the probability is asked for.
        last = fitted.stages[-1].copy().setProbabilityCol(f"_{family}").setRawPredictionCol("").setPredictionCol("")
        scored = last.transform(scored)
    scores = F.array(*[F.struct(F.lit(family).alias("family"), vector_to_array(f"_{family}")[1].alias(schema.SCORE))
                       for family in models])
    return scored.select(*[F.col(f"_kept.k{i}").alias(c) for i, c in enumerate(keep)], F.inline(scores))


def score_batch(model: PipelineModel, df: DataFrame, id_col: str = schema.ID,
                threshold: float = schema.FLAG_THRESHOLD) -> DataFrame:
    """(id, score, flag) for every row, as one lazy plan over the partitions."""
    return (with_score(model, df, (id_col,))
            .withColumn(schema.FLAG, flag_at(F.col(schema.SCORE), threshold)))


def score_linear(df: DataFrame, weights: dict[str, float], intercept: float) -> Column:
    """Probability from given coefficients on raw columns; missing counts as 0."""
    total = F.lit(intercept)
    for name, weight in weights.items():
        total = total + missing_to_zero(column(name)) * F.lit(weight)
    return 1 / (1 + F.exp(-total))


def evaluate(models: dict[str, PipelineModel], test: DataFrame, label: str = schema.LABEL) -> DataFrame:
    """family, rows, positives, roc_auc, average_precision on the given rows, ranked in one pass."""
    scored = [with_score(fitted, test, (label,)).withColumn("family", F.lit(family))
              for family, fitted in models.items()]
    return metrics.ranking_metrics(functools.reduce(DataFrame.unionByName, scored), label, by=("family",))


def feature_names(model: PipelineModel, df: DataFrame) -> list[str]:
    return slot_names(PipelineModel(stages=model.stages[:-1]), df)


def slot_names(stages: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the vector slots, read from the metadata of the column that the preparation assembles."""
    described = stages.transform(df.limit(0))
    groups = described.schema[prep.FEATURES].metadata["ml_attr"]["attrs"]
    slots = sorted(((a["idx"], a["name"]) for attrs in groups.values() for a in attrs))
    return [re.sub(r"__levels_", "_", name) for _, name in slots]


def _slot_table(spark, names: Sequence[str], values: Sequence[float], value: str) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], f"feature string, {value} double")


def coefficients(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, coefficient) of a logistic model; one row per vector slot."""
    return _slot_table(df.sparkSession, feature_names(model, df), model.stages[-1].coefficients.toArray(),
                       "coefficient")


def exact_coefficients(train: DataFrame, label: str = schema.LABEL, exclude: Sequence[str] = (schema.ID,)) -> DataFrame:
    """(feature, coefficient) at the optimum of the logistic loss, the intercept among them; see ``newton``."""
    prepared = prepare(train, label, exclude)
    try:
        found = newton.fit(prepared.vectors, _LABEL, prep.WEIGHT, prep.FEATURES)
    finally:
        prepared.vectors.unpersist()
    names = [*slot_names(prepared.stages, train), "intercept"]
    return _slot_table(train.sparkSession, names, [*found.weights, found.intercept], "coefficient")


def importances(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, importance) of a tree model; importances add up to 1."""
    return _slot_table(df.sparkSession, feature_names(model, df), model.stages[-1].featureImportances.toArray(),
                       "importance")
