"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.llm import (bpe, chat_format, divergence, fingerprints, license_scan, lm_scoring, mixing, ngram_join,
                            prefix_trie, quality_classifier, quality_rules, sentence_pieces, token_counts)
from prospectra.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edited(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "removed_words")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = quality_classifier.featurize(documents(spark, sf_dir))
    model = quality_classifier.train(features, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(features, model)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every line of every document."""
    return token_counts.count_by_section(documents(spark, sf_dir))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


# A conversation that looks like the template's own markers.
_CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit(_CONTROL_TEXT).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").union(own)
    return chat_format.read_back(chat_format.format_conversations(rows))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself, one row per copy: its place in the global order is the row order."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    sized = docs.withColumn("chars", F.coalesce(F.length("text"), F.lit(0)))
    rates = mixing.source_rates(sized, size=F.col("chars"))
    return mixing.mix(sized, rates).select("doc_id", "source", F.col("chars").cast("long").alias("chars"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(documents(spark, sf_dir))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_token_counts": op4_token_counts,
    "op5_ngram_join": op5_ngram_join,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_chat_format": op7_chat_format,
    "op8_mixing": op8_mixing,
    "op9_license_scan": op9_license_scan,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_divergence": op13_divergence,
    "pipeline": pipeline,
}
