"""License scans: an exact set-similarity join of license templates with text blocks.

Words are cut and counted in one native pass over the texts.  Named phrases are
found as consecutive words.  Beyond them, each template is a set of words.  A
block is as long as two templates and may start at any word; a text has a
template where some block holds enough of its words:

- a template of fewer than ``SHORT_WORDS`` words must stand in full, since one
  word may be all that tells two of them apart; a longer one may lack a fifth,
  but never one of its naming words;
- template words are put in one global order, rarest in the corpus first, by
  their document frequencies over all texts;
- texts send the places of a template's first ``m - least + 1`` words only
  (prefix filter) and are joined with the templates on the word, so the cost
  follows the meetings, not the number of templates;
- around a meeting enough text must be left (length filter), and the template's
  words within reach must suffice (positional filter);
- blocks around what is left are counted exactly, each from a template word on.

Only built-in functions are used.  The templates are a fixed list in this
module or the caller's; everything broadcast is made from it alone.

Defined results: a NULL text is empty; a text without words has no places, no
labels and score 0; repeated rows are scanned row by row; other columns are
not read.  Texts of any length are scanned whole; what is kept of one are the
places of template words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.session import write_and_read_back

THRESHOLD_PERCENT = 80
# Templates of fewer words must stand in full.
SHORT_WORDS = 10


@dataclass(frozen=True)
class Template:
    """A label, the wording that stands for it, and the words that must not be missing."""
    label: str
    wording: str
    naming: str = ""

    def words(self) -> list[str]:
        return self.wording.split()

    def distinct(self) -> list[str]:
        return sorted(set(self.words()))

    def least(self, percent: int = THRESHOLD_PERCENT) -> int:
        """Distinct words that a block must hold."""
        size = len(self.distinct())
        return size if len(self.words()) < SHORT_WORDS else -(-size * percent // 100)


# Phrases whose places are counted, and their labels.
PHRASES = (
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
)
# Notices as they commonly stand in files.
TEMPLATES = (
    Template("gpl", "this work is licensed under the gnu general public license version 3", "gnu"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                    "general public license as published by the free software foundation", "gnu"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                    "associated documentation files"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
             "creative commons attribution"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
                    "that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    Template("all-rights-reserved", "all rights reserved"),
)

# Everything but 0-9, A-Z, a-z and what lies beyond ASCII separates words.
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(words: Column, phrase: list[str]) -> Column:
    """The 0-based starts of a phrase among the words."""
    def at(w: Column, i: Column) -> Column:
        hit = w == phrase[0]
        for k, p in enumerate(phrase[1:], 1):
            hit = hit & (F.get(words, i + k) == p)
        return F.when(hit, i.cast("long"))
    return F.filter(F.transform(words, at), lambda p: p.isNotNull())


def scan_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: tuple[Template, ...] = PHRASES,
               templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """A written table, one row per document: word count, phrase places, and the places of template words."""
    vocabulary = sorted({w for t in templates for w in t.words()})
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _SEPARATORS, " "))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), plain.alias("plain"))
    # Lower-casing A-Z only is slow on every text; on texts that have no A-Z it is the same as leaving them.
    rows = rows.withColumn("plain", F.when(F.col("plain").rlike("[A-Z]"), _ascii_lower(F.col("plain"))).otherwise(F.col("plain")))
    words = F.when(F.col("plain") == "", F.array().cast("array<string>")).otherwise(F.split("plain", " "))
    rows = rows.withColumn("words", words)
    # Phrases are looked for by words only where the text has the phrase at all.
    found = [F.when(F.contains(F.concat(F.lit(" "), F.col("plain"), F.lit(" ")), F.lit(f" {p.wording} ")),
                    _places(F.col("words"), p.words())).otherwise(F.array().cast("array<bigint>")) for p in phrases]
    spots = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("word"))),
                     lambda spot: spot["word"].isin(vocabulary))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), spots.alias("spots"),
                       *[f.alias(f"places_{i}") for i, f in enumerate(found)])
    places = F.flatten(F.array(*[f"places_{i}" for i in range(len(phrases))]))
    labels = F.array_compact(F.array(*[F.when(F.size(f"places_{i}") > 0, F.lit(p.label)) for i, p in enumerate(phrases)]))
    return write_and_read_back(rows.select(
        F.monotonically_increasing_id().alias("row_key"), "doc_id", "n_words", "spots", places.alias("places"),
        F.array_distinct(labels).alias("base_labels")), "license-words")


def _ascii_lower(text: Column) -> Column:
    """A-Z to a-z; ``lower`` does just that unless it would turn other letters into ASCII ones."""
    odd = text.rlike("[\\u0130\\u212A]")
    return F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def word_order(scanned: DataFrame) -> DataFrame:
    """(word, documents) of every template word found.  As many rows as templates have words."""
    counted = scanned.select(F.explode(F.array_distinct("spots.word")).alias("word")).groupBy("word").agg(F.count("*").alias("documents"))
    return write_and_read_back(counted, "template-word-counts")


def _ordered_templates(spark: SparkSession, counts: DataFrame, templates: tuple[Template, ...],
                       percent: int) -> tuple[DataFrame, list[str]]:
    """One row per template, its words in global order with its sizes; and all templates' prefix words."""
    frequency = {r["word"]: r["documents"] for r in counts.collect()}
    rows, prefix_words = [], set()
    for number, t in enumerate(templates):
        words = sorted(t.distinct(), key=lambda w: (frequency.get(w, 0), w))
        prefix_words.update(words[:len(words) - t.least(percent) + 1])
        naming = _texts(sorted(set(t.naming.split()))) if t.naming else F.array().cast("array<string>")
        rows.append(F.struct(F.lit(number).alias("template"), F.lit(t.label).alias("label"), _texts(words).alias("t_words"),
                             naming.alias("naming"), F.lit(2 * len(t.words())).alias("reach"), F.lit(t.least(percent)).alias("least")))
    return spark.range(1).select(F.inline(F.array(*rows))), sorted(prefix_words)


def template_matches(scanned: DataFrame, templates: tuple[Template, ...] = TEMPLATES,
                     percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(row_key, template, label, place, common, size): the best block around every prefix word that has one."""
    ordered, prefix_words = _ordered_templates(scanned.sparkSession, word_order(scanned), templates, percent)
    by_word = ordered.select("*", F.explode(F.slice("t_words", F.lit(1), F.size("t_words") - F.col("least") + 1)).alias("word"))
    meetings = scanned.select("row_key", "n_words", "spots", F.explode(F.filter(
        "spots", lambda spot: spot["word"].isin(prefix_words))).alias("spot"))
    place, reach, least = F.col("spot.place"), F.col("reach"), F.col("least")
    met = meetings.join(F.broadcast(by_word), F.col("spot.word") == F.col("word"))
    # Length filter: the text between the earliest and the latest block around the meeting.
    met = met.where(F.least(F.col("n_words"), place + reach) - F.greatest(F.lit(0), place - reach + 1) >= least)
    near = F.filter("spots", lambda s: (s["place"] > place - reach) & (s["place"] < place + reach) & F.array_contains("t_words", s["word"]))
    met = met.select("row_key", "template", "label", place.alias("place"), "t_words", "naming", "reach", "least", near.alias("near"))
    # Positional filter: the template's words within reach of the meeting.
    met = met.where(F.size(F.array_distinct("near.word")) >= F.col("least"))

    def common(start: Column) -> Column:
        block = F.filter("near", lambda s: (s["place"] >= start["place"]) & (s["place"] < start["place"] + F.col("reach")))
        words = F.array_distinct(F.transform(block, lambda s: s["word"]))
        return F.when(F.size(F.array_intersect("naming", words)) == F.size("naming"), F.size(words)).otherwise(F.lit(0))

    starts = F.filter("near", lambda s: s["place"] <= F.col("place"))
    best = met.select("row_key", "template", "label", "place", "least", F.size("t_words").alias("size"),
                      F.array_max(F.transform(starts, common)).alias("common"))
    return best.where(F.col("common") >= F.col("least")).drop("least")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: tuple[Template, ...] = PHRASES,
         templates: tuple[Template, ...] = TEMPLATES, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per document: phrase places, labels of phrases and templates, and the best containment."""
    scanned = scan_words(docs, doc_id, text, phrases, templates)
    found = template_matches(scanned, templates, percent).groupBy("row_key").agg(
        F.collect_set("label").alias("more"), F.max(F.col("common") / F.col("size")).alias("best"))
    found = write_and_read_back(found, "license-matches")
    n_base = F.size("places").cast("long")
    labels = F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))
    return scanned.drop("spots").join(found, "row_key", "left").select(
        "doc_id", "n_words", n_base.alias("n_base"), F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"), F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
