import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prospectra.llm import mixing
from tests.llm import edge_rows as e


def brute_counts(data, rates, seed=mixing.SEED):
    out = []
    for doc_id, text, _, source, _ in data:
        inner = hashlib.md5((text or "").encode()).hexdigest()
        h = hashlib.md5(f"{seed}|{'-' if doc_id is None else doc_id}|{inner}".encode()).hexdigest()
        u, lam = int(h[:13], 16) / 2 ** 52, rates[source]
        k, p = 0, math.exp(-lam)
        total = p
        while u >= total and k < 200:
            k += 1
            p *= lam / k
            total += p
        out.append(k)
    return out


def test_counts_equal_brute_force_and_rows_follow(spark):
    df = e.table(spark, extra=True)
    rates = mixing.source_rates(df)
    by = {r["source"]: r["rate"] for r in rates.collect()}
    counts = brute_counts(e.rows(), by)
    mixed = mixing.mix(df, rates)
    assert mixed.columns == df.columns
    want = Counter({d[:2]: 0 for d in e.rows()})
    for d, n in zip(e.rows(), counts):
        want[d[:2]] += n
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == +want


def test_shares_meet_the_targets(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"),
                                      F.when(F.col("id") < 20_000, "big").when(F.col("id") < 29_000, "mid")
                                      .otherwise("small").alias("source"))
    rates = mixing.source_rates(docs, weights={"big": 1, "mid": 1, "small": 0.5})
    mixed = mixing.mix(docs, rates)
    count = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(count["big"] - 12_000) < 500 and abs(count["mid"] - 12_000) < 500 and abs(count["small"] - 6_000) < 400
    drawn = mixing.draw_counts(docs.where("source = 'small'"), rates).groupBy("copies").count().collect()
    assert abs(sum(r["copies"] * r["count"] for r in drawn) / 1000 - 6) < 0.4       # Poisson: mean and variance 6
    assert abs(sum((r["copies"] - 6) ** 2 * r["count"] for r in drawn) / 1000 - 6) < 1.2
    places = [i for i, r in enumerate(mixed.select("source").collect()) if r[0] == "small"]
    assert abs(sum(places) / len(places) - 15_000) < 800                            # spread over the whole order


def test_rare_source_in_a_large_mix_is_drawn_in_full(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"),
                                     F.when(F.col("id") < 1_999, "big").otherwise("rare").alias("source"))
    sizes = F.when(F.col("source") == "big", 1e6).otherwise(1.0)
    assert mixing.source_rates(docs, size=sizes).where("source = 'rare'").first()["rate"] > 600
    rates = mixing.source_rates(docs, weights={"big": 1.0, "rare": 1.0}, size=F.when(F.col("source") == "big", 1.0).otherwise(8.0))
    rare = docs.where("source = 'big'").withColumn("source", F.lit("rare"))
    mean = rates.where("source = 'rare'").first()["rate"]
    assert mean > 64
    counts = {r["doc_id"]: r["copies"] for r in mixing.draw_counts(rare, rates).collect()}
    assert counts == {r["doc_id"]: r["copies"] for r in mixing.draw_counts(rare.repartition(5), rates).collect()}
    drawn = list(counts.values())
    assert abs(sum(drawn) / len(drawn) - mean) < 1.2 and max(drawn) > 140          # Poisson: mean and variance alike
    assert abs(sum((x - mean) ** 2 for x in drawn) / len(drawn) / mean - 1) < 0.2
    assert mixing.mix(docs, rates).where("source = 'rare'").count() > 64


def test_weightless_sources_and_limits(spark):
    df = e.table(spark)
    assert {r["source"] for r in mixing.mix(df, mixing.source_rates(df, weights={"src1": 1.0})).collect()} <= {"src1"}
    with pytest.raises(ValueError, match="repeated"):
        mixing.source_rates(df, budget=1e6)
    none = e.empty(spark)
    assert mixing.mix(none, mixing.source_rates(none)).collect() == []
