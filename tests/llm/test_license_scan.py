import random
import re

from prospectra.llm import license_scan as scan
from tests.llm import edge_rows as e

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, percent=scan.THRESHOLD_PERCENT):
    w = WORDS.findall(e.ascii_lower(text))
    places, base = [], set()
    for p in scan.PHRASES:
        own = p.words()
        at = [i for i in range(len(w)) if w[i:i + len(own)] == own]
        places += at
        base |= {p.label} if at else set()
    labels, best = set(base), 0.0
    for t in scan.TEMPLATES:
        need, n, naming = set(t.words()), len(t.words()), set(t.naming.split())
        for i in range(len(w)):
            met = need & set(w[i:i + 2 * n])
            share = len(met) / len(need)
            if naming <= met and (share * 100 >= percent if n >= 10 else met == need):
                labels.add(t.label)
                best = max(best, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), 1.0 if places else best)


def test_equals_brute_force(spark):
    long = " ".join([e.prose(1, 300), scan.TEMPLATES[5].wording, e.prose(2, 300), scan.TEMPLATES[9].wording.replace("met", "x")])
    texts = ["MIT License", "the mit\nlicense; CC-BY 4.0, cc by", "GNU General-Public (License) gnu general public license",
             "Apache Apache License license apache", "licensed under CC BY-NC 4.0.", "All rights reserved", "all rights are reserved",
             long, "permission is hereby granted free of charge to any person", "İK mit licenſe K", "cc by" * 3, "cc by " * 50,
             scan.TEMPLATES[1].wording.upper(), " ".join(reversed(scan.TEMPLATES[0].words())), "\x00\x7f", "ÉÀ éà mit license"]
    # Passages with words put in between, at every offset.
    rng = random.Random(2)
    for t in scan.TEMPLATES:
        for gap in (0, 1, 3):
            spread = [x for word in t.words() for x in (word, *(["und"] * (rng.random() < gap / 2)))]
            texts.append(" ".join(["vor"] * rng.randint(0, 2 * len(spread)) + spread + ["nach"] * rng.randint(0, 40)))
    data = [*e.rows(), *[(1000 + i, t, "en", "a", 0) for i, t in enumerate(texts)]]
    found = [tuple(r) for r in scan.scan(e.table(spark, data, extra=True)).collect()]
    assert sorted(found, key=str) == sorted(((d[0], *brute(d[1])) for d in data), key=str)


def test_every_template_is_found_in_itself_and_misses_when_cut(spark):
    data = [(i, f"{e.prose(i, 40)} {t.wording} {e.prose(50 + i, 40)}", "en", "a", 0) for i, t in enumerate(scan.TEMPLATES)]
    half = [(100 + i, " ".join(t.words()[:len(t.words()) // 2]), "en", "a", 0) for i, t in enumerate(scan.TEMPLATES)]
    found = {r["doc_id"]: r for r in scan.scan(e.table(spark, data + half)).collect()}
    for i, t in enumerate(scan.TEMPLATES):
        assert t.label in found[i]["labels"].split(",") and found[i]["score"] == 1.0
    assert all(found[i]["score"] in (0.0, 1.0) for i in found)


def test_plan_is_native_and_empty_table_works(spark):
    df = scan.scan(e.table(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert scan.scan(e.empty(spark)).collect() == []


def test_labels_that_differ_in_one_word(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.", "released under the apache license",
             "Released under the MIT License", "all rights reserved", "all rights", "licensed under the license version 2 0"]
    rows = scan.scan(e.table(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])).collect()
    assert [r["labels"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [
        "cc-by,cc-by-nc", "cc-by,cc-by-sa", "apache", "mit", "all-rights-reserved", "", ""]


def test_naming_words_must_stand(spark):
    gpl = scan.TEMPLATES[1].wording
    rows = [(0, gpl.replace("gnu ", ""), "en", "a", 0), (1, gpl.replace("free charge ", ""), "en", "a", 0)]
    found = {r["doc_id"]: r["labels"] for r in scan.scan(e.table(spark, rows)).collect()}
    assert found == {0: "", 1: "gpl"}


def test_passages_at_every_offset(spark):
    """Spread over nearly twice its length, a passage is found wherever it begins."""
    words = scan.TEMPLATES[0].words()
    spread = [x for w in words[:-1] for x in (w, "so")] + words[-1:]
    rows = [(i, " ".join(["vor"] * i + spread + ["nach"] * 30), "en", "a", 0) for i in range(2 * len(words))]
    assert all("gpl" in r["labels"] for r in scan.scan(e.table(spark, rows)).collect())


def test_cost_follows_meetings_not_templates(spark):
    """Many templates that no text meets add no meeting."""
    many = (*scan.TEMPLATES, *[scan.Template(f"t{i}", " ".join(f"word{i}x{j}" for j in range(12))) for i in range(300)])
    df = e.table(spark, [(i, f"{e.prose(i, 60)} {t.wording}", "en", "a", 0) for i, t in enumerate(scan.TEMPLATES)])
    plain, with_many = ([tuple(r) for r in scan.scan(df, templates=t).orderBy("doc_id").collect()] for t in (scan.TEMPLATES, many))
    assert plain == with_many
