"""Rule-based explanations of a score, as one array column.

The sentences are this project's own.  Everything is a built-in expression, so
explaining adds no shuffle and no Python to a scoring plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectra import schema
from prospectra.functions.values import (any_set, column, display_label, is_set, joined_labels, missing_to_zero,
                                         segment, whole_text)

# Age bands and interests, their order and their display names.
AGE_LABELS = {
    "le17": "≤ 17 years",
    "18-21": "18–21 years",
    "22-27": "22–27 years",
    "28-34": "28–34 years",
    "35-39": "35–39 years",
    "40-49": "40–49 years",
    "ge50": "≥ 50 years",
}
INTEREST_LABELS = {
    "travel": "travel & holidays",
    "sport": "sports",
    "health": "health & wellness",
    "children": "family & children",
    "automotive": "vehicles & automotive",
    "culinary": "food & lifestyle",
    "shopping": "shopping & lifestyle",
    "gadget": "gadgets & technology",
}
MODERN_CHANNELS = ("bank_transfer_payment", "credit_card_payment")

def _rules(score: Column, medium: float) -> dict[str, tuple[Column, Column]]:
    """Rule name -> (when it speaks, what it says), in reading order."""
    ages, interests = joined_labels(AGE_LABELS), joined_labels(INTEREST_LABELS)
    amount, policies = missing_to_zero(column("ape_sums")), missing_to_zero(column("inforce_counts"))
    return {
        "age": (ages != "", F.concat(F.lit("Age band: "), ages, F.lit("."))),
        "relationship": (is_set(column("fwd_max_flag")), F.lit("Holds the strongest relationship status.")),
        "yearly": (is_set(column("yearly_payment")), F.lit("Pays premiums yearly.")),
        "monthly": (is_set(column("monthly_payment")), F.lit("Pays premiums monthly.")),
        "online": (is_set(column("ecomm_counts")), F.lit("Buys online.")),
        "channel": (any_set(MODERN_CHANNELS), F.lit("Pays by bank transfer or credit card.")),
        "premium": (amount > 0, F.concat(F.lit("Annual premium of about "), F.format_number(amount, 0), F.lit("."))),
        "policies": (policies > 0, F.concat(F.lit("Policies in force: "), whole_text(policies), F.lit("."))),
        "interests": (interests != "", F.concat(F.lit("Interested in "), interests, F.lit("."))),
        "segment": (F.lit(True), F.concat(segment(score, medium), F.lit(" potential."))),
    }


def explanation_rules(score: Column, medium: float = schema.FLAG_THRESHOLD) -> Column:
    """Names of the rules that apply, in order."""
    return F.array_compact(F.array(*[F.when(on, F.lit(n)) for n, (on, _) in _rules(score, medium).items()]))


def explanation_texts(score: Column, medium: float = schema.FLAG_THRESHOLD) -> Column:
    """The sentences that apply, in order."""
    return F.array_compact(F.array(*[F.when(on, text) for on, text in _rules(score, medium).values()]))


def with_explanations(scored: DataFrame, medium: float = schema.FLAG_THRESHOLD) -> DataFrame:
    """Add ``explanations`` to rows that carry the features and a score."""
    return scored.withColumn("explanations", explanation_texts(column(schema.SCORE), medium))


def explanation_counts(scored: DataFrame, medium: float = schema.FLAG_THRESHOLD) -> DataFrame:
    """How many customers each rule speaks for."""
    return (scored.select(F.explode(explanation_rules(column(schema.SCORE), medium)).alias("rule"))
            .groupBy("rule").agg(F.count("*").alias("customers")))


def key_drivers(coefficients: DataFrame, k: int = 5, name: str = "feature", value: str = "coefficient") -> DataFrame:
    """(feature, coefficient, rank) of the k strongest coefficients of a fitted model, either sign; ties by name."""
    strength = F.abs(column(value))
    top = coefficients.select(column(name), column(value)).orderBy(F.desc_nulls_last(strength), column(name)).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(strength), column(name))))


def driver_texts(drivers: DataFrame, texts: DataFrame | None = None, name: str = "feature") -> DataFrame:
    """Add ``text`` to ``key_drivers``: the caller's, matched whatever the case, else a sentence from sign and rank.

    ``texts`` has (feature, text).
    """
    direction = F.when(F.col("coefficient") >= 0, F.lit("raises")).otherwise(F.lit("lowers"))
    own = F.concat(F.lit("Driver "), F.col("rank"), F.lit(": "), column(name), F.lit(" "), direction, F.lit(" the score."))
    if texts is None:
        return drivers.withColumn("text", own)
    given = texts.select(F.lower("feature").alias("_key"), F.col("text").alias("_text")).dropDuplicates(["_key"])
    found = drivers.join(given, F.lower(column(name)) == F.col("_key"), "left")
    return found.withColumn("text", F.coalesce("_text", own)).drop("_key", "_text")


def active_drivers(df: DataFrame, drivers: Sequence[str]) -> DataFrame:
    """(feature, customers): how many customers have each driver, by column or by level.

    A driver that is no column is read as ``column_level``.
    """
    present = []
    for driver in drivers:
        if driver in df.columns:
            held = is_set(column(driver))
        else:
            base, _, level = driver.rpartition("_")
            held = column(base) == level
        present.append(F.when(held, F.lit(driver)))
    return (df.select(F.explode(F.array_compact(F.array(*present))).alias("feature"))
            .groupBy("feature").agg(F.count("*").alias("customers")))


def labelled_features(names: DataFrame, name: str = "column_name") -> DataFrame:
    """Add the display label of a feature name."""
    return names.withColumn("label", display_label(column(name)))
