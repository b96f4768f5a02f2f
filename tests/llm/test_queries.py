import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prospectra.llm import mixing, ngram_join, quality_classifier, quality_rules
from prospectra.llm.oracle import ORACLE_SQL
from prospectra.llm.queries import QUERIES
from prospectra.session import write_and_read_back
from tests.compare import duck, mismatch
from tests.llm import edge_rows as e


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert mismatch(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"op7_chat_format", "op11_prefix_trie"}))
def test_sql_agrees_on_awkward_rows(spark, tmp_path, name):
    path = str(tmp_path / "documents.parquet")
    e.table(spark).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert mismatch(QUERIES[name](spark, str(tmp_path)), con, ORACLE_SQL[name]) is None


def test_every_operator_is_registered():
    assert all(any(q.startswith(f"op{i}_") for q in QUERIES) for i in range(1, 14))


def test_pipeline_does_what_its_operators_say(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    verdicts = {r["doc_id"] for r in quality_rules.apply_rules(docs).where("kept").collect()}
    one = corpus_pipeline.rules_stage(spark, docs, sf_dir)
    assert ids(one) == sorted(verdicts)
    features = quality_classifier.featurize(one)
    good = {r["doc_id"] for r in quality_classifier.score(features, quality_classifier.train(features, labels))
            .where("predicted = 1").collect()}
    two = corpus_pipeline.classifier_stage(spark, one, sf_dir)
    assert ids(two) == sorted(good)
    groups = {r["component_id"] for r in ngram_join.near_duplicates(two).collect()}
    three = corpus_pipeline.near_duplicate_stage(spark, two, sf_dir)
    assert ids(three) == sorted(groups)
    drawn = mixing.draw_counts(three, mixing.source_rates(three)).select("doc_id", "copies").collect()
    want = sorted(r["doc_id"] for r in drawn for _ in range(r["copies"]))
    result = corpus_pipeline.run(spark, sf_dir)
    assert ids(result) == want
    assert result.where("not round_trip").count() == 0
    assert result.where("n_tokens * 4 <> octet_length(ids)").count() == 0


def test_pipeline_stages_take_awkward_rows(spark, sf_dir):
    docs = e.table(spark, extra=True).select("*", *[F.lit(i).alias(n) for i, n in enumerate(("decoded", "n_tokens", "round_trip"))])
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_and_read_back(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == names
    last = write_and_read_back(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir), "stage")
    assert last.columns == [*names, "_ids", "_n_tokens", "_round_trip"]
    rows = last.collect()
    assert len(rows) == docs.count() > 0
    assert all(r["_round_trip"] and r["_n_tokens"] == len(r["_ids"]) // 4 > 0 and (r["ids"], r["n_tokens"]) == ("x", 1) for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, e.empty(spark), sf_dir).collect() == []
