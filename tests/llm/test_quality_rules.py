from collections import Counter, defaultdict

import duckdb

from prospectra.llm import quality_rules as rules
from prospectra.llm.oracle import ORACLE_SQL
from prospectra.llm.queries import QUERIES
from tests.compare import mismatch
from tests.llm import edge_rows as e


def brute(data, limit_docs, limit_percent, least_left, most_docs=1000):
    docs, lines_of = [], []
    for doc_id, text, _, source, _ in data:
        w = e.words(text)
        windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {i + d for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for d in range(5)}
        raw = [x for x in (text or "").split("\n") if e.words(x)]
        lines = Counter()
        for x in raw:
            lines[" ".join(e.words(e.ascii_lower(x)))] += len(e.words(x))
        docs.append([doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""),
                     len(raw) - len(set(raw)), len(covered), source])
        lines_of.append(lines)
    pages, sizes = defaultdict(set), defaultdict(set)
    for d, lines in zip(docs, lines_of):
        sizes[d[6]].add(frozenset(lines))
        for line in lines:
            pages[d[6], line].add(frozenset(lines))
    often = {k for k, f in pages.items()
             if len(f) > limit_docs and (len(f) * 100 > len(sizes[k[0]]) * limit_percent or len(f) > most_docs)}
    out = []
    for d, lines in zip(docs, lines_of):
        gone = sum(n for line, n in lines.items() if (d[6], line) in often)
        failed = d[1] < 10 or 100 * d[5] > 20 * d[1]
        out.append((*d[:6], failed, not failed and 100 * (d[1] - gone) >= least_left * d[1], gone))
    return out


def run(spark, df, limit_docs=rules.LIMIT_DOCS, limit_percent=rules.LIMIT_PERCENT, most_docs=rules.MOST_DOCS):
    m = rules.measure(df)
    found = rules.judge(m, rules.frequent_lines(m, limit_docs, limit_percent, most_docs))
    return [tuple(r) for r in found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                           "base_failed", "kept", "removed_words").collect()]


def test_measures_and_verdicts_equal_brute_force(spark):
    found = run(spark, e.table(spark, extra=True))
    assert sorted(found, key=str) == sorted(brute(e.rows(), 20, 5, 30), key=str)


def test_shared_lines_deplete_documents_but_copies_do_not(spark):
    furniture = "\n".join(f"menu entry number {i} of this very site" for i in range(5))
    pages = [(i, f"{furniture}\n{e.prose(100 + i, 4)}", "en", "a", 0) for i in range(30)]
    copies = [(100 + i, e.prose(7, 60), "en", "a", 0) for i in range(30)]
    clean = [(200 + i, f"menu entry number 0 of this very site\n{e.prose(300 + i, 60)}", "en", "a", 0) for i in range(30)]
    data = pages + copies + clean
    found = run(spark, e.table(spark, data))
    assert sorted(found) == sorted(brute(data, 20, 5, 30))
    kept = {r[0] for r in found if r[7]}
    assert kept == {d[0] for d in copies + clean}
    assert not kept & {d[0] for d in pages}


def test_furniture_longer_than_the_body_depletes_documents(spark):
    furniture = "\n".join(e.prose(900 + i, 9) for i in range(5))
    pages = [(i, f"{furniture}\nown words number {i}", "en", "a", 0) for i in range(30)]
    copies = [(100 + i, e.prose(7, 60).upper() if i % 2 else e.prose(7, 60), "en", "a", 0) for i in range(30)]
    df = e.table(spark, pages + copies)
    found = {r["doc_id"]: r for r in rules.apply_rules(df).collect()}
    for d in pages:
        assert not found[d[0]]["base_failed"] and not found[d[0]]["kept"] and found[d[0]]["removed_words"] == 45
    assert all(found[d[0]]["kept"] and found[d[0]]["removed_words"] == 0 for d in copies)
    assert {r["doc_id"] for r in rules.keep_good(df).collect()} == {d[0] for d in copies}


def test_copies_do_not_hide_the_furniture_of_other_pages(spark):
    furniture = "\n".join(e.prose(900 + i, 9) for i in range(5))
    pages = [(i, f"{furniture}\nown words number {i}", "en", "a", 0) for i in range(30)]
    copies = [(1000 + i, e.prose(7, 60), "en", "a", 0) for i in range(900)]      # the pages are under 5 % of all rows
    kept = {r["doc_id"] for r in rules.apply_rules(e.table(spark, pages + copies)).where("kept").collect()}
    assert kept == {d[0] for d in copies}


def test_kept_rows_keep_their_columns_and_repeats(spark):
    df = e.table(spark, extra=True)
    kept = rules.keep_good(df)
    assert kept.columns == df.columns
    want = [d for d, v in zip(e.rows(), brute(e.rows(), 20, 5, 30)) if v[7]]
    assert sorted((tuple(r)[:5] for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert run(spark, e.empty(spark)) == []
    assert rules.keep_good(e.empty(spark)).collect() == []


def test_a_big_host_is_not_spared(spark):
    """A banner in 60 of 2,000 pages is under the share of the host; beyond the absolute limit it goes all the same."""
    data = [(i, (f"{e.prose(5, 40)}\n" if i < 60 else "") + f"{e.prose(1000 + i, 12)}", "en", "big", 0) for i in range(2000)]
    df = e.table(spark, data)
    assert all(r[8] == 0 for r in run(spark, df))
    found = run(spark, df, most_docs=50)
    assert sorted(found) == sorted(brute(data, 20, 5, 30, 50))
    assert {r[0] for r in found if r[8]} == set(range(60))


def test_sql_counts_like_the_query(spark, tmp_path):
    """Pages whose shared lines are longer than their own."""
    furniture = "\n".join(e.prose(900 + i, 9) for i in range(5))
    data = [(i, f"{furniture}\nown words number {i}", "en", "a" if i % 2 else None, 0) for i in range(60)]
    data += [(100 + i, e.prose(7, 60), "en", "a", 0) for i in range(40)]
    path = str(tmp_path / "documents.parquet")
    e.table(spark, data).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert mismatch(QUERIES["op2_quality_rules"](spark, str(tmp_path)), con, ORACLE_SQL["op2_quality_rules"]) is None
