import zlib

import numpy as np

from prospectra.llm import quality_classifier as qc
from tests.llm import edge_rows as e


def brute_score(model, x):
    out = []
    for row in x:
        total = model.intercept + sum(t[sum(v >= c for c in edges)] for v, edges, t in zip(row, model.edges, model.tables))
        for (a, b), grid in zip(model.pairs, model.grids):
            total += grid[sum(row[a] >= c for c in model.pair_edges[a]), sum(row[b] >= c for c in model.pair_edges[b])]
        out.append(1 / (1 + np.exp(-total)))
    return out


def test_learns_additive_and_pairwise_effects():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5) | (x[:, 2] > 0.9)).astype(float)
    model = qc.fit(x[:3000], y[:3000])
    assert (1, 0) in model.pairs
    assert np.mean((model.scores(x[3000:]) > 0.5) == y[3000:]) > 0.93
    assert np.allclose(model.scores(x[:50]), brute_score(model, x[:50]))


def test_held_out_accuracy_on_the_given_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    features = qc.featurize(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = qc.score(features, qc.train(features, labels))
    both = scored.where("held_out").join(labels, "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in both["doc_id"])
    assert ((both["predicted"] == 1) == (both["quality"] == 1)).mean() > 0.95


def test_edge_rows_score_and_filter(spark):
    df = e.table(spark, extra=True)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    features = qc.featurize(df)
    model = qc.train(features, labels)
    scored = qc.score(features, model).collect()
    assert len(scored) == len(e.rows()) and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in scored)
    kept = qc.keep_good(df, model)
    assert kept.columns == df.columns
    assert kept.count() == sum(r["predicted"] for r in scored)


def test_no_labels_one_class_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    features = qc.featurize(e.table(spark))
    assert {r["score"] for r in qc.score(features, qc.train(features, none)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    assert all(r["score"] > 0.9 for r in qc.score(features, qc.train(features, one)).collect())
    nothing = qc.featurize(e.empty(spark))
    assert qc.score(nothing, qc.train(nothing, one)).collect() == []
