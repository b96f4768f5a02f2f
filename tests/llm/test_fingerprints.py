import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prospectra.llm import fingerprints as fp
from tests.llm import edge_rows as e


def key(row):
    return (row[0] is not None, row[0] or 0)


def edits(data):
    """(doc_id, n_chars, sha256 of the edited text) for unique ids."""
    rows = sorted(data, key=key)
    out = []
    for (doc_id, text, *_), (_, after, *_) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        q = len(text) // 4
        out.append((doc_id, len(text), hashlib.sha256((text[:len(text) - q] + after[:q]).encode()).hexdigest()))
    return out


def unique(data):
    return list({d[0]: d for d in data}.values())


@pytest.mark.parametrize("chars", [fp.PARTITION_CHARS, 2000, 200])
def test_edited_texts_follow_the_next_document(spark, monkeypatch, chars):
    monkeypatch.setattr(fp, "PARTITION_CHARS", chars)
    data = unique(e.rows())
    found = fp.compare_with_edited(e.table(spark, data, extra=True)).collect()
    assert sorted((tuple(r)[:3] for r in found), key=str) == sorted(edits(data), key=str)
    by = {r["doc_id"]: r for r in found}
    assert by[20]["fingerprint"] == by[21]["fingerprint"] and by[43]["fingerprint"] == by[44]["fingerprint"]
    assert by[40]["fingerprint"] == by[41]["fingerprint"] == by[42]["fingerprint"]
    order = [r for r in sorted(found, key=lambda r: key((r["doc_id"],)))]
    for a, b in zip(order, order[1:] + order[:1]):
        same = [a["fingerprint"][i:i + 4] == b["fingerprint"][i:i + 4] for i in range(0, 256, 4)]
        assert len(a["fingerprint"]) == 256 and a["near_next"] == sum(same) / 64
    assert by[20]["near_next"] == 1.0 and by[43]["near_next"] == 1.0


def test_repeated_rows_and_ties_keep_every_row(spark):
    found = fp.compare_with_edited(e.table(spark)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(d[0] for d in e.rows())


def bag(text):
    w = e.words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def test_collision_rate_is_generalised_jaccard(spark):
    """Over many pairs, the mean likeness meets the mean similarity of weighted bags."""
    pairs = []
    for i in range(150):
        a = " ".join(e.prose(i, 25) for _ in range(1 + i % 4))          # repeats make weights above 1
        b = " ".join([e.edited(e.prose(i, 25), i, 0.03)] * (1 + i % 3))
        pairs.append((i, a, b))
    df = spark.createDataFrame(pairs, "k long, a string, b string")
    rows = df.select("k", fp.shingle_hashes(F.col("a")).alias("a"), fp.shingle_hashes(F.col("b")).alias("b"))
    found = fp.fingerprints(rows, ["k"], "a", "b").select("k", fp.likeness(F.col("a"), F.col("b")).alias("near")).collect()
    near = {r["k"]: r["near"] for r in found}
    real = {}
    for k, a, b in pairs:
        x, y = bag(a), bag(b)
        real[k] = sum((x & y).values()) / sum((x | y).values())
    assert 0.2 < sum(real.values()) / 150 < 0.8
    assert abs(sum(near.values()) - sum(real.values())) / 150 < 0.02
    assert max(abs(near[k] - real[k]) for k in real) < 0.3


def test_plan_is_native_with_one_text_shuffle(spark, sf_dir):
    df = fp.compare_with_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert fp.compare_with_edited(e.empty(spark)).collect() == []
