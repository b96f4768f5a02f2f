"""Quality of scores: ranking metrics, confusion counts, report and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra import schema
from prospectra.functions.values import column, nan_to_null
from prospectra.operators.ranks import running_totals, stored


def ranking_metrics(df: DataFrame, label: str = "y", score: str = schema.SCORE,
                    by: Sequence[str] = ()) -> DataFrame:
    """rows, positives, roc_auc and average_precision, per group if asked.

    Exact: equal scores are one step.  Rows are first summed per score, so
    only distinct scores are ordered, and those in buckets (see ``ranks``).
    ROC-AUC is NULL without both classes, average precision without
    positives.  Groups must be few (folds, models).
    """
    groups = list(by) or ["_whole"]
    steps = (df.groupBy(*by, column(score).alias("_score"))
             .agg(F.count_if(column(label) == 1).alias("_pos"), F.count("*").alias("_all")))
    steps = stored(steps if by else steps.withColumn("_whole", F.lit(0)))
    totals = steps.groupBy(*groups).agg(F.sum("_pos").alias("_positives"), F.sum("_all").alias("_rows"))
    ranked = running_totals(steps, "_score", ("_pos", "_all"), groups).join(F.broadcast(totals), groups)
    # Running totals ascend; counted from the top, rows above are the rest.
    above = (F.col("_positives") - F.col("upto__pos")).cast("double")
    reached = (above + F.col("_pos")).cast("double")
    reached_all = (F.col("_rows") - F.col("upto__all") + F.col("_all")).cast("double")
    negatives = (F.col("_all") - F.col("_pos")).cast("double")
    summed = ranked.groupBy(*by).agg(
        F.max("_rows").alias("rows"), F.max("_positives").alias("positives"),
        F.sum(negatives * (above + F.col("_pos") / 2)).alias("_area"),
        F.sum(F.col("_pos") * reached / reached_all).alias("_precision"))
    p, n = F.col("positives").cast("double"), (F.col("rows") - F.col("positives")).cast("double")
    return summed.select(
        *by, "rows", "positives",
        F.when((p > 0) & (n > 0), F.col("_area") / (p * n)).alias("roc_auc"),
        F.when(p > 0, F.col("_precision") / p).alias("average_precision"))


def confusion_matrix(df: DataFrame, label: str = "y", score: str = schema.SCORE,
                     threshold: float = schema.CLASS_THRESHOLD) -> DataFrame:
    """(actual, predicted, count) for both classes, zero cells included."""
    counts = _cells(df, label, score, threshold)
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"_{a}{p}").alias("count"))
        for a in (0, 1) for p in (0, 1)])))


def _cells(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    predicted = F.coalesce(nan_to_null(column(score)) >= threshold, F.lit(False)).cast("int")
    return df.agg(*[F.count_if((column(label) == a) & (predicted == p)).alias(f"_{a}{p}")
                    for a in (0, 1) for p in (0, 1)])


def classification_report(df: DataFrame, label: str = "y", score: str = schema.SCORE,
                          threshold: float = schema.CLASS_THRESHOLD, digits: int = 4) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the two averages.

    A zero denominator gives 0.  The accuracy row holds the accuracy in all
    three places.
    """
    cells = _cells(df, label, score, threshold)

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    per_class = []
    for c in (0, 1):
        hit, missed, false = F.col(f"_{c}{c}"), F.col(f"_{c}{1 - c}"), F.col(f"_{1 - c}{c}")
        precision, recall = ratio(hit, hit + false), ratio(hit, hit + missed)
        per_class.append((precision, recall, ratio(2 * hit, 2 * hit + false + missed), hit + missed))
    total = per_class[0][3] + per_class[1][3]
    accuracy = ratio(F.col("_00") + F.col("_11"), total)
    macro = [(per_class[0][i] + per_class[1][i]) / 2 for i in range(3)]
    weighted = [ratio(per_class[0][i] * per_class[0][3] + per_class[1][i] * per_class[1][3], total) for i in range(3)]
    lines = [("0", *per_class[0]), ("1", *per_class[1]), ("accuracy", accuracy, accuracy, accuracy, total),
             ("macro avg", *macro, total), ("weighted avg", *weighted, total)]
    return cells.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("class"), F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"),
                 F.round(f, digits).alias("f1"), s.alias("support")) for name, p, r, f, s in lines])))


def cv_summary(fold_metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of the fold metrics; folds without a value are left out."""
    return fold_metrics.groupBy(*by).agg(
        F.count("*").alias("folds"),
        *[f(m).alias(f"{m}_{name}") for m in ("roc_auc", "average_precision")
          for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


def select_best(metrics: DataFrame, order: Sequence[str] = ("logistic", "tree")) -> DataFrame:
    """The family with the highest average precision; a tie keeps the first of ``order``."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("family"))
    return metrics.orderBy(F.desc_nulls_last("average_precision"), place).limit(1)


def top_and_bottom(table: DataFrame, value: str, name: str = "feature", k: int = 20) -> DataFrame:
    """The k highest and k lowest rows with their side; ties by name."""
    rows = table.where(F.col(value).isNotNull())
    top = rows.orderBy(F.desc(value), name).limit(k).withColumn("side", F.lit("top"))
    bottom = rows.orderBy(F.asc(value), name).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)
