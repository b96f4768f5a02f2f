import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from prospectra.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += not children[node]
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(seed, n=100, longest=12):
    """Few different texts, so that prefixes are shared at many depths; some ids are missing."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 3, rng.randint(1, longest)])):
            rows.append((c, t, rng.choice(["user", "user", "assistant"]), rng.choice(["a", "a", "a", "bé", "漢" * 5])))
    return rows


AWKWARD = [
    (0, None, "user", "null turn first"), (0, 0, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (0, 1, "assistant", "tie"),
    (1, 5, "user", "x"), (2, 0, "user", "ab"), (2, 0, "us", "erab"), (5, 0, "", "no role"), (6, -3, "user", "z" * 200_000),
    (None, 0, "user", "no id"), (7, None, None, None), (7, None, None, None), (11, 2, "user", "q"), (11, 1, "user", "p")]


@pytest.mark.parametrize("seed, shard, band, most", [(1, 256, 64, 200_000), (2, 4, 2, 3), (3, 1, 1, 1)])
def test_equals_brute_force(spark, seed, shard, band, most):
    rows = conversations(seed)
    df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), SCHEMA).repartition(7)
    assert found(prefix_trie.build_trie(df, least_shard=shard, least_band=band, most=most)) == brute(rows)


def test_awkward_rows(spark):
    want = brute(AWKWARD)
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    assert found(prefix_trie.build_trie(df)) == want
    clashing = df.select("*", *[F.lit("x").alias(n) for n in ("depth", "k1", "piece", "shard", "tokens", "n_convs")])
    assert found(prefix_trie.build_trie(clashing)) == want
    assert prefix_trie.build_trie(df.limit(0)).collect() == []
    only_null = df.where("conv_id is null")
    assert prefix_trie.build_trie(only_null).collect() == []


def test_one_long_conversation_and_many_copies(spark):
    """A conversation of 200 turns (heavy in many bands) and 300 equal ones (a heavy path, one long list of ends)."""
    rows = [(3, t, "user", f"turn {t}") for t in range(200)]
    rows += [(1000 + c, t, "user", f"copy {t}") for c in range(300) for t in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.build_trie(df, least_shard=20, least_band=10, most=10)) == brute(rows)


def test_pieces_of_a_conversation_are_many(spark):
    """A long conversation is numbered over several tasks."""
    rows = [(3, t, "user", f"turn {t}") for t in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        places = prefix_trie.ordered_turns(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert places.select("piece").distinct().count() > 1
    assert sorted(r[0] for r in places.select("place").collect()) == list(range(1, 2001))


def test_queue_gives_what_was_put_in_any_order_of_spills():
    rng = random.Random(9)
    for most in (1, 2, 5, 1000):
        queue = prefix_trie.MessageQueue(most)
        keys = sorted((s, -d, k, 0) for s in range(3) for d in range(4) for k in range(4))
        put, got = defaultdict(list), defaultdict(list)
        for at, key in enumerate(keys):
            got[key] = sorted(queue.take(key))
            for later in rng.sample(keys[at + 1:], min(3, len(keys) - at - 1)):
                totals = (rng.randrange(10), rng.randrange(10**15))
                queue.put(later, totals)
                put[later].append(totals)
        assert {k: sorted(v) for k, v in put.items()} == {k: v for k, v in got.items() if v}
