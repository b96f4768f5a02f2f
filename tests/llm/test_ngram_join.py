import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from prospectra.llm import ngram_join as join
from tests.llm import edge_rows as e


def brute(data):
    sets = []
    for _, text, *_ in data:
        w = e.words(e.ascii_lower(text))
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    at = list(range(len(data)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                at[root(i)] = root(j)
    out = []
    for i, (d, *_) in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if root(j) == root(i) and data[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return out


def found(df):
    return sorted((tuple(r) for r in join.near_duplicates(df).collect()), key=str)


def test_edge_cases_equal_brute_force(spark):
    assert found(e.table(spark, extra=True)) == sorted(brute(e.rows()), key=str)


def test_chains_and_star_of_near_copies_equal_brute_force(spark):
    rng = random.Random(5)
    data, base = [], e.prose(400, 150)
    for i in range(90):                     # around one centre, from near to far
        data.append((rng.randrange(10 ** 6), e.edited(base, i, rng.choice([0.0, 0.005, 0.01, 0.02, 0.03])), "en", "a", 0))
    text = e.prose(500, 100)
    for i in range(25):                     # each like the one before it
        text = e.edited(text, 900 + i, 0.01)
        data.append((10 ** 6 + i, text, "en", "a", 0))
    passage = e.prose(600, 40)
    for i in range(40):                     # a passage that unrelated texts share
        data.append((2 * 10 ** 6 + i, passage + " " + e.prose(700 + i, 12 + i), "en", "b", 0))
    assert found(e.table(spark, data)) == sorted(brute(data), key=str)


def test_order_does_not_change_links(spark):
    data = [(i, e.edited(e.prose(1, 80), i, 0.02), "en", "a", 0) for i in range(40)]
    df = e.table(spark, data)
    found = []
    for sets in (join.shingle_sets(df, top=3), join.shingle_sets(df)):     # first with almost nothing listed
        nodes = join.set_nodes(sets)
        names = {r["node"]: r["doc_id"] for r in nodes.collect()}
        pairs = join.candidates_across(join.prefix_entries(nodes), spark.createDataFrame([], "node long, component long"))
        found.append({frozenset(names[n] for n in r) for r in join.verify(pairs, nodes, df).collect()})
    assert found[0] == found[1] != set()


def test_links_and_their_number_equal_brute_force(spark):
    base = e.prose(400, 150)
    data = [(i, e.edited(base, i // 2, 0.01 * (i % 7)), "en", "a", 0) for i in range(50)]
    data += [(100 + i, base.upper(), "en", "a", 0) for i in range(6)] + [(None, base, "en", "a", 0), (7, None, "en", "a", 0)]
    sets = [join.exact_shingles(t) for _, t, *_ in data]
    want = [(d, len(sets[i]), sum(join.linked(sets[i], other) for j, other in enumerate(sets) if j != i))
            for i, (d, *_) in enumerate(data)]
    found = [tuple(r) for r in join.link_counts(e.table(spark, data)).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert join.link_counts(e.empty(spark)).collect() == []


def test_a_passage_of_many_texts_is_one_entry_per_block():
    sizes = join.Sizes.of(10 ** 6)
    passage = e.prose(3, 40)
    texts = [passage, *[f"{passage} {e.prose(50 + i, 9)}" for i in range(300)], None]
    blocks = list(join._key_blocks(sizes)([pa.RecordBatch.from_pydict({"text": pa.array(texts[:150], pa.string())}),
                                           pa.RecordBatch.from_pydict({"text": pa.array(texts[150:], pa.string())})]))
    assert sum(len(b) // 4 for x in blocks for b in x.column("block").to_pylist()) < 36 + 300 * 10
    table = pa.Table.from_batches(blocks)
    want = Counter(k for t in texts for k in join._top_bits(join.Hasher()(t), sizes.key_bits).tolist())
    for r in set(table.column("range").to_pylist()):
        merged = join._merge_blocks(sizes)((pa.scalar(r),), table.filter(pc.equal(table.column("range"), r)))
        got = dict(zip(merged.column("keys")[0].as_py(), merged.column("counts")[0].as_py()))
        assert got == {k: n for k, n in want.items() if k >> sizes.width == r and n >= join.LEAST_TOP_FREQUENCY}


def test_sizes_grow_with_the_texts(monkeypatch, spark):
    small, large, huge = (join.Sizes.of(n) for n in (10 ** 6, 3 * 10 ** 10, 10 ** 14))
    assert small == (40, 8) and small.range_bits < large.range_bits < huge.range_bits and huge.width <= 32
    assert 3 * 10 ** 10 / 6 / 2 ** large.range_bits < join.RANGE_KEYS
    monkeypatch.setattr(join, "RANGE_KEYS", 3)
    monkeypatch.setattr(join, "BLOCK_KEYS", 100)
    df = e.table(spark)
    assert join.Sizes.of(5000).range_bits > 8
    assert found(df) == sorted(brute(e.rows()), key=str)


def test_one_of_each_group_stays(spark):
    df = e.table(spark, extra=True)
    kept = join.keep_one_per_group(df)
    assert kept.columns == df.columns
    want = brute(e.rows())
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    alone = [d for d, n, c in want if n == 0]
    groups = {c for d, n, c in want if n}
    assert ids == sorted([*alone, *groups], key=str)


def test_groups_are_judged_by_row_where_ids_repeat_or_miss(spark):
    near, alone = e.prose(1, 120), [e.prose(800 + i, 60) for i in range(5)]
    data = [(1, near), (2, e.edited(near, 3, 0.01)), (2, alone[0]),         # (a) another text of an id that is left out
            (3, alone[1]), (3, alone[2]), (3, alone[2]),                    # (b) two texts with one id, one of them twice
            (None, alone[3]), (None, alone[4]), (None, alone[4].upper()),   # (b) groups without an id
            (None, e.edited(near, 4, 0.01)), (None, None), (2, ""), (2, "")]    # (c) a NULL id in a named group
    kept = join.keep_one_per_group(e.table(spark, [(*d, "en", "a", 0) for d in data], extra=True))
    found = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()), key=str)
    assert found == sorted([(1, near), (2, alone[0]), (3, alone[1]), (3, alone[2]), (None, alone[3]), (None, alone[4]),
                            (None, ""), (2, ""), (2, "")], key=str)


def test_empty_table(spark):
    assert found(e.empty(spark)) == []
    assert join.keep_one_per_group(e.empty(spark)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 6, 19, 100, 1001])
def test_prefix_holds_a_common_shingle(n):
    """Two sets of n that share just enough must meet in their prefixes."""
    least = -(-join.NUMERATOR * 2 * n // (join.NUMERATOR + join.DENOMINATOR))
    assert n - least < join.prefix_size(n)
    assert np.all(join.Hasher()("A b c d e") == join.Hasher()("a B c d e"))
