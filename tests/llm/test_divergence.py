import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from prospectra.llm import divergence
from tests.llm import edge_rows as e

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least_docs, top=50):
    """(lang, source, part, item, value, rank) by plain counting."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        terms = _TERM.findall(e.ascii_lower(text))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in counts}:
        kept = {t for t, n in docs[lang].items() if n >= least_docs}
        own = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(own.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s, c in own.items():
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def sources(seed, docs=160, names=7):
    """Documents whose words lean towards their source, some terms long, some not ASCII."""
    rng = random.Random(seed)
    words = [*(f"{a}{b}" for a in ("pre", "prefix", "préfixe", "漢字", "İK", "x" * 40) for b in ("", "a", "es", "ß" * 9, "y" * 70)),
             "One", "two3four", "it's", "MIT_License"]
    rows = []
    for i in range(docs):
        source = rng.randrange(names)
        text = " ".join(rng.choice(words[source::3] + words[:6]) for _ in range(rng.randint(0, 25)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), f"s{source}" if source else None, 0))
    return rows


@pytest.mark.parametrize("seed, least, width, block, tile", [(1, 5, 4, 2048, 128), (2, 3, 1, 4, 2), (3, 8, 3, 7, 3), (4, 2, 64, 1, 1)])
def test_equals_brute_force(spark, seed, least, width, block, tile):
    rows = sources(seed)
    got = divergence.audit(e.table(spark, rows), least, first_width=width, block_terms=block, tile_sources=tile)
    assert found(got) == brute(rows, least)


def test_awkward_rows(spark):
    want = brute(e.rows(), 3)
    assert want and found(divergence.audit(e.table(spark), 3)) == want
    clashing = e.table(spark, extra=True).select("*", *[F.lit("x").alias(n) for n in ("terms", "counts", "term", "n", "place", "p", "value")])
    assert found(divergence.audit(clashing, 3)) == want
    # No term is frequent: distances are 0 and ranked by name.
    assert found(divergence.audit(e.table(spark), 10_000)) == brute(e.rows(), 10_000)
    assert divergence.audit(e.empty(spark)).collect() == []


def test_refinement_finds_the_frequent_terms_and_drops_the_rest_early(spark):
    rng = random.Random(1)
    rows = [(i, "common " + "".join(rng.choices("abcdefgh", k=30)), "en", "s", 0) for i in range(200)]
    terms = divergence.count_terms(e.table(spark, rows))
    assert [tuple(r) for r in divergence.frequent_terms(terms, 30, 2).collect()] == [("en", "common ", 200)]


def test_very_long_terms(spark):
    rows = [(i, "z" * 3_000 + ("q" if i % 2 else "") + " word", "en", f"s{i % 3}", 0) for i in range(8)]
    assert found(divergence.audit(e.table(spark, rows), 4)) == brute(rows, 4)


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 10**15, 7), (10**15 - 1, 10**15, 7), (123456789012345, 999999999999999, 10**6), (5, 5, 1), (0, 0, 3)]
    df = spark.createDataFrame(cases, "n long, total long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n + 5) // (total + 5 * v) for n, total, v in cases]


def test_runs_of_documents_are_combined_before_spark_counts(spark):
    documents = spark.createDataFrame([("l", "s", ["longest ", "longer ", "a "], [1, 2, 3])] * 40, divergence._TERMS).coalesce(1)
    rows = documents.select("lang", "terms").mapInArrow(divergence._count_prefixes(0, 5), "lang string, term string, docs long")
    assert sorted(map(tuple, rows.collect())) == [("l", "a ", 40), ("l", "longe", 40)]
    rows = documents.select("lang", "terms").mapInArrow(divergence._count_prefixes(2, 6), "lang string, term string, docs long")
    assert sorted(map(tuple, rows.collect())) == [("l", "longer", 40), ("l", "longes", 40)]
    uses = documents.mapInArrow(divergence._count_uses, "lang string, source string, term string, n long")
    assert sorted(map(tuple, uses.collect())) == [("l", "s", "a ", 120), ("l", "s", "longer ", 80), ("l", "s", "longest ", 40)]


def test_terms_move_as_one_value_and_wide_prefixes_read_long_terms_only(spark):
    rows = [(1, "ab AB " + "x" * 11 + " " + "y" * 12, "en", "s", 0), (2, " ", "en", "s", 0), (3, None, None, None, 0)]
    documents = divergence.count_terms(e.table(spark, rows))
    assert dict(documents.dtypes)["terms"] == "string" and dict(documents.dtypes)["counts"] == "binary"
    got = {(r.lang, r.source, r.terms, r.longer, bytes(r.counts)) for r in documents.collect()}
    one = b"".join(n.to_bytes(8, "little") for n in (2, 1, 1))
    assert got == {("en", "s", "ab \n" + "x" * 11 + " \n" + "y" * 12 + " ", "y" * 12 + " ", one),
                   ("en", "s", None, None, b""), ("", "", None, None, b"")}
    assert sorted(map(tuple, divergence.frequent_terms(documents, 1, 3).collect())) == [
        ("en", "ab ", 1), ("en", "x" * 11 + " ", 1), ("en", "y" * 12 + " ", 1)]
    uses = documents.mapInArrow(divergence._count_uses, "lang string, source string, term string, n long").collect()
    assert sorted((r.term, r.n) for r in uses) == [("ab ", 2), ("x" * 11 + " ", 1), ("y" * 12 + " ", 1)]
