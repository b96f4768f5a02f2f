"""Conversation prefix trie, with subtree totals by time-forward processing.

Conversations are rebuilt (the first turns of every fifth one are shared with
the four after it), and all sequences of first turns become nodes of a trie.  A
node is named by its depth and 128 bits: the exclusive-or of one hash per turn
and place.  Such names can be made for all prefixes at once, by running totals
inside pieces of a conversation and one offset per piece, so a conversation of
any length is worked on by many tasks; and a node's parent is named by taking
the last turn's hash out again.

Subtree totals go up by time-forward processing: a task sorts its nodes by
reverse level, takes the totals sent to a node from a priority queue, adds the
node's own, and sends the sum on to the parent through the queue, which spills
sorted runs to disk when it grows.  Each subtree is one shard's work:

1. A node weighs what its members still have to say; a light node's subtree is
   at most about the square root of all rows.  The highest light nodes are the
   roots of shards; nodes above are heavy, at most so many per level.
2. Within shards, totals run up to the shard roots.
3. Heavy nodes are cut into bands of levels.  Totals run up within every band,
   then across the bands' top nodes, then once more within the bands, with what
   the bands below have sent.

Memory is bounded by the queue's limit, whatever the shape of the trie.  The
digest of the conversations that end in a node is fed with runs of ids that
other tasks have joined, so a node with very many copies costs one task few rows.

Defined results: a NULL role or text is empty; NULL turns come first; equal
turns are ordered by role, then text; repeated rows are turns of their own; a
row without a conv_id belongs to no conversation; only the four named columns
are read, so other columns cannot clash; texts of any length are hashed whole;
an empty table has no conversation and so no node.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct
import tempfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectra.llm.common import in_runs, ready_for_python, small_or_plain
from prospectra.session import write_and_read_back

# Rebuilding: groups of so many conversations share up to MOST_SHARED turns.
GROUP = 5
MOST_SHARED = 8
# Lightest limit of a shard's weight, and least levels of a band.
LEAST_SHARD = 256
LEAST_BAND = 64
# Totals that a task's queue holds in memory; ids joined to one run.
QUEUE_ENTRIES = 200_000
RUN_IDS = 5_000


# Rebuilt turns --------------------------------------------------------------

def _hashes(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes: the salt goes in first."""
    return [F.xxhash64(F.lit(salt), *columns).alias(f"h{salt}") for salt in (1, 2)]


def ordered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """A written table (conv_id, piece, place, h1, h2, bytes): every turn's place in its
    conversation (from 1), hashes of role and text, and the text's UTF-8 bytes.

    Turns are sorted into ranges over all tasks and keep their range as ``piece``, so that a
    long conversation lies in many; places are counted per piece and shifted by the pieces before.
    """
    empty = F.lit("")
    turns = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), empty).alias("role"), F.coalesce(F.col(text).cast("string"), empty).alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # Repeated rows fall into one range; their order among themselves makes no difference.
    pieces = write_and_read_back(
        turns.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv_id", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("at"),
                *_hashes(F.col("role"), F.length("role"), F.col("text")), F.octet_length("text").cast("long").alias("bytes")),
        "trie-turns")
    within = Window.partitionBy("conv_id", "piece").orderBy("at")
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (pieces.groupBy("conv_id", "piece").agg(F.count("*").alias("n"))
              .select("conv_id", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"),
                      F.sum("n").over(Window.partitionBy("conv_id")).alias("turns")))
    return write_and_read_back(
        pieces.withColumn("own", F.row_number().over(within)).join(shifts, ["conv_id", "piece"])
        .select("conv_id", "piece", (F.col("own") + F.col("shift")).alias("place"), "turns", "h1", "h2", "bytes"), "trie-places")


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes over: crc32 of its decimal id, modulo 9."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("long")


def rebuilt_turns(places: DataFrame) -> DataFrame:
    """A written table of all turns of rebuilt conversations: (conv_id, piece, depth, turns, bytes,
    k1, k2, p1, p2); k names the node of the first ``depth`` turns, p its parent.

    A conversation without turns has a row of depth 0.
    """
    c = F.col("conv_id")
    convs = (places.groupBy("conv_id").agg(F.first("turns").alias("own_turns"))
             .withColumns({"base": c - c % GROUP, "shared": shared_turns(c)}))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own_turns").alias("base_turns"))
    sizes = write_and_read_back(
        convs.join(bases, "base", "left")
        .withColumn("taken", F.least("shared", F.coalesce("base_turns", F.lit(0))))
        .select("conv_id", "base", "shared", "taken",
                (F.col("taken") + F.greatest(F.col("own_turns") - F.col("shared"), F.lit(0))).alias("all_turns")), "trie-sizes")
    # At most 8 turns of a base, for the few conversations of its group.
    heads = (places.where((F.col("place") <= MOST_SHARED) & (c % GROUP == 0))
             .select(c.alias("base"), F.col("place").alias("depth"), "h1", "h2", "bytes")
             .join(sizes, "base").where(F.col("depth") <= F.col("taken"))
             .select("conv_id", F.lit(-1).alias("piece"), "depth", "all_turns", "h1", "h2", "bytes"))
    # Sizes are joined per piece: a long conversation's pieces are many keys.
    per_piece = places.groupBy("conv_id", "piece").agg(F.lit(1).alias("one")).join(sizes, "conv_id").drop("one")
    tails = (places.select("conv_id", "piece", "place", "h1", "h2", "bytes")
             .join(per_piece, ["conv_id", "piece"]).where(F.col("place") > F.col("shared"))
             .select("conv_id", "piece", (F.col("place") - F.col("shared") + F.col("taken")).alias("depth"), "all_turns",
                     "h1", "h2", "bytes"))
    turns = write_and_read_back(heads.unionByName(tails).select(
        "conv_id", "piece", "depth", "all_turns", "bytes", *_hashes(F.col("depth"), F.col("h1"), F.col("h2"))), "trie-rebuilt")

    by_piece = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (turns.groupBy("conv_id", "piece").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
               .select("conv_id", "piece", *[F.coalesce(F.bit_xor(f"x{i}").over(by_piece), F.lit(0)).alias(f"o{i}") for i in (1, 2)]))
    upto = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = (turns.select("*", *[F.bit_xor(f"h{i}").over(upto).alias(f"r{i}") for i in (1, 2)])
             .join(offsets, ["conv_id", "piece"])
             .select("conv_id", "piece", "depth", F.col("all_turns").alias("turns"), "bytes",
                     *[F.col(f"r{i}").bitwiseXOR(F.col(f"o{i}")).alias(f"k{i}") for i in (1, 2)],
                     *[F.col(f"r{i}").bitwiseXOR(F.col(f"o{i}")).bitwiseXOR(F.col(f"h{i}")).alias(f"p{i}") for i in (1, 2)]))
    zero = F.lit(0).cast("long")
    turnless = sizes.where("all_turns = 0").select(
        "conv_id", F.lit(-1).alias("piece"), zero.alias("depth"), zero.alias("turns"), zero.alias("bytes"),
        *[zero.alias(k) for k in ("k1", "k2", "p1", "p2")])
    return write_and_read_back(named.unionByName(turnless), "trie-paths")


# Nodes ----------------------------------------------------------------------

NODE = ["depth", "k1", "k2"]


def trie_nodes(paths: DataFrame) -> DataFrame:
    """A written table of one row per node: name, parent's name, members and the node's own weight and value."""
    nodes = paths.where("depth > 0").groupBy(*NODE).agg(
        F.min(F.struct("conv_id", "piece")).alias("smallest"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.sum(F.col("turns") - F.col("depth") + 1).alias("weight"))
    # Every conversation has a row of depth 1 or, without turns, of depth 0.
    zero = F.lit(0).cast("long")
    root = (paths.where("depth <= 1").agg(F.min(F.struct("conv_id", "piece")).alias("smallest"), F.count("*").alias("n_convs"))
            .where("n_convs > 0").select(*[zero.alias(c) for c in NODE], "smallest", "n_convs", zero.alias("bytes"),
                                         *[F.lit(None).cast("long").alias(p) for p in ("p1", "p2")], zero.alias("weight")))
    every = nodes.unionByName(root).select(
        *NODE, "p1", "p2", F.col("smallest.conv_id").alias("conv_id"), F.col("smallest.piece").alias("piece"), "n_convs",
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("own_tokens"), "weight")
    return write_and_read_back(every, "trie-nodes")


# Time-forward processing ----------------------------------------------------

class MessageQueue:
    """A priority queue of (key, totals) that spills sorted runs to disk.

    Keys are taken out in rising order, and none is put in below the last one taken, so
    runs are read once, from front to back.  Spilled runs are nameless files of the task.
    """

    _RECORD = struct.Struct("<7q")

    def __init__(self, most: int = QUEUE_ENTRIES) -> None:
        self._most, self._held, self._heads = most, [], []
        self._runs: list[BinaryIO] = []

    def put(self, key: tuple, totals: tuple[int, int]) -> None:
        """``key`` is (shard, -depth, k1, k2), all 64-bit numbers."""
        heapq.heappush(self._held, (key, totals))
        if len(self._held) > self._most:
            self._spill()

    def _spill(self) -> None:
        run = tempfile.TemporaryFile()
        for key, totals in sorted(self._held):
            run.write(self._RECORD.pack(*key, *totals, 0))
        run.seek(0)
        self._held = []
        self._runs.append(run)
        self._advance(len(self._runs) - 1)

    def _advance(self, number: int) -> None:
        record = self._runs[number].read(self._RECORD.size)
        if record:
            values = self._RECORD.unpack(record)
            heapq.heappush(self._heads, (values[:4], values[4:6], number))
        else:
            self._runs[number].close()

    def take(self, key: tuple) -> Iterator[tuple[int, int]]:
        """The totals put in under ``key``, and away with all below it."""
        while self._held and self._held[0][0] <= key:
            found, totals = heapq.heappop(self._held)
            if found == key:
                yield totals
        while self._heads and self._heads[0][0] <= key:
            found, totals, number = heapq.heappop(self._heads)
            self._advance(number)
            if found == key:
                yield totals


_PASSED = "depth long, k1 long, k2 long, n_leaves long, tokens long"
_PASSED_ARROW = pa.schema([(n, pa.int64()) for n in ("depth", "k1", "k2", "n_leaves", "tokens")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _pass_up(most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = MessageQueue(most)
        for batch in in_runs(batches, 10_000):
            out = []
            for shard, depth, k1, k2, q1, q2, up, leaves, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                for more_leaves, more_tokens in queue.take((shard, -depth, k1, k2)):
                    leaves += more_leaves
                    tokens += more_tokens
                out.append((depth, k1, k2, leaves, tokens))
                if up is not None:
                    # A parent in another shard never asks; what was sent to it goes when its key is passed.
                    queue.put((shard, -up, q1, q2), (leaves, tokens))
            yield _batch(out, _PASSED_ARROW)
    return run


def pass_up(nodes: DataFrame, most: int = QUEUE_ENTRIES) -> DataFrame:
    """(depth, k1, k2, n_leaves, tokens): each node's totals over its descendants in the same shard, its own included.

    ``nodes`` has a ``shard``, the node's name, its parent's (``up``, ``q1``, ``q2``; NULL ``up``: none in the
    shard) and its own ``n_leaves`` and ``tokens``.  A parent is at a lower depth, not always the next.
    """
    ready_for_python(nodes)
    deepest_first = ["shard", F.desc("depth"), "k1", "k2"]
    rows = nodes.select("shard", *NODE, "q1", "q2", "up", "n_leaves", "tokens").repartition("shard")
    return rows.sortWithinPartitions(*deepest_first).mapInArrow(_pass_up(most), _PASSED)


def _messages(totals: DataFrame, tops: DataFrame) -> DataFrame:
    """What the top nodes send up, added per receiver: (depth, k1, k2, more_leaves, more_tokens)."""
    sent = totals.join(tops.select(*NODE, F.col("depth").alias("_d"), "p1", "p2"), NODE)
    return (sent.groupBy((F.col("_d") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
            .agg(F.sum("n_leaves").alias("more_leaves"), F.sum("tokens").alias("more_tokens")))


def _with_messages(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    got = nodes.join(messages, NODE, "left")
    return got.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)),
                            "tokens": F.col("tokens") + F.coalesce("more_tokens", F.lit(0))}).drop("more_leaves", "more_tokens")


def subtree_totals(nodes: DataFrame, paths: DataFrame, least_shard: int = LEAST_SHARD, least_band: int = LEAST_BAND,
                   most: int = QUEUE_ENTRIES) -> DataFrame:
    """(depth, k1, k2, n_leaves, tokens) of every node's whole subtree; ``nodes`` with own ``n_leaves`` and ``tokens``."""
    limit = max(least_shard, math.isqrt(paths.count()))
    heavy = write_and_read_back(nodes.where((F.col("weight") > limit) | (F.col("depth") == 0)), "trie-heavy")
    names = small_or_plain(heavy.where("depth > 0").select(*NODE, F.lit(True).alias("is_heavy")))
    marked = paths.where("depth > 0").join(names, NODE, "left")

    # Weights fall along a path, so its light nodes are below its heavy ones; the first is the root of a shard.
    light_roots = marked.where("is_heavy is null").groupBy("conv_id").agg(
        F.min(F.struct(*NODE)).alias("shard_root"))
    pieces = paths.groupBy("conv_id", "piece").agg(F.lit(1).alias("one")).drop("one")
    roots = pieces.join(light_roots, "conv_id").select("conv_id", "piece", "shard_root")
    light = write_and_read_back(
        nodes.join(names, NODE, "left").where("is_heavy is null and depth > 0").join(roots, ["conv_id", "piece"])
        .select(*NODE, "p1", "p2", "n_leaves", "tokens", F.xxhash64("shard_root").alias("shard"),
                (F.col("shard_root.depth") == F.col("depth")).alias("is_top")), "trie-light")
    inside = F.when(~F.col("is_top"), F.col("depth") - 1)
    light_totals = write_and_read_back(
        pass_up(light.withColumns({"up": inside, "q1": F.col("p1"), "q2": F.col("p2")}), most), "trie-light-totals")
    from_light = _messages(light_totals, light.where("is_top"))

    # Across shard roots: bands of heavy levels, their top nodes, and the bands again.
    levels = heavy.agg(F.max("depth")).first()[0] or 0
    band = max(least_band, math.isqrt(levels))
    heavy = write_and_read_back(
        _with_messages(heavy, from_light).withColumns({
            "shard": F.floor(F.col("depth") / band), "is_top": F.col("depth") % band == 0,
            "up": F.when(F.col("depth") % band > 0, F.col("depth") - 1), "q1": F.col("p1"), "q2": F.col("p2")}), "trie-banded")
    if levels < band:
        return light_totals.unionByName(pass_up(heavy, most))
    banded = write_and_read_back(pass_up(heavy, most), "trie-band-totals")
    # A top node's next top node above is on the same path, one band up.
    steps = paths.where((F.col("depth") > 0) & (F.col("depth") % band == 0)).select("conv_id", *NODE)
    above = steps.select("conv_id", (F.col("depth") + band).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"))
    tops = heavy.where("is_top").select("conv_id", *NODE).join(above, ["conv_id", "depth"], "left")
    linked = banded.join(tops, NODE).select(
        F.lit(0).alias("shard"), *NODE, *[F.coalesce(q, F.lit(0)).alias(q) for q in ("q1", "q2")],
        F.when(F.col("depth") > 0, F.col("depth") - band).alias("up"), "n_leaves", "tokens")
    across = write_and_read_back(pass_up(linked, most), "trie-across")
    from_below = _messages(across, heavy.where("is_top and depth > 0"))
    return light_totals.unionByName(pass_up(_with_messages(heavy, from_below), most))


# Digests of ends -------------------------------------------------------------

_RUNS = "depth long, k1 long, k2 long, first_id long, ids string"
_RUNS_ARROW = pa.schema([*[(n, pa.int64()) for n in (*NODE, "first_id")], ("ids", pa.string())])


def _join_ids(most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            done = []
            for *key, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (key != node or len(ids) >= most):
                    done.append((*node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = key
                ids.append(conv_id)
            yield _batch(done, _RUNS_ARROW)
        if ids:
            yield _batch([(*node, ids[0], ",".join(map(str, ids)))], _RUNS_ARROW)
    return run


_DIGESTS = "depth long, k1 long, k2 long, ends_sha256 string"
_DIGESTS_ARROW = pa.schema([*[(n, pa.int64()) for n in NODE], ("ends_sha256", pa.string())])


def _digest_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest = None, hashlib.sha256()
    for batch in batches:
        done = []
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key == node:
                digest.update(b",")
            else:
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield _batch(done, _DIGESTS_ARROW)
    if node:
        yield _batch([(*node, digest.hexdigest())], _DIGESTS_ARROW)


def end_digests(paths: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes where conversations end."""
    ready_for_python(paths)
    ends = paths.where("depth = turns").select(*NODE, "conv_id")
    # Ranges part a node's ids where they are many; each task joins its own to runs.
    runs = (ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
            .mapInArrow(_join_ids(RUN_IDS), _RUNS))
    return (write_and_read_back(runs, "trie-ends").repartition(*NODE).sortWithinPartitions(*NODE, "first_id")
            .mapInArrow(_digest_runs, _DIGESTS))


_NO_ENDS = hashlib.sha256(b"").hexdigest()


def build_trie(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               least_shard: int = LEAST_SHARD, least_band: int = LEAST_BAND, most: int = QUEUE_ENTRIES) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    paths = rebuilt_turns(ordered_turns(rows, conv_id, turn, role, text))
    named = trie_nodes(paths)
    children = (named.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
                .agg(F.count("*").alias("n_children")))
    nodes = write_and_read_back(
        named.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "tokens": F.col("own_tokens")}), "trie-counted")
    totals = write_and_read_back(subtree_totals(nodes, paths, least_shard, least_band, most), "trie-totals")
    ends = write_and_read_back(end_digests(paths), "trie-digests")
    parents = named.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    # Both sides are written tables, so the children of a node with very many are split over tasks.
    placed = write_and_read_back(
        nodes.select(*NODE, "p1", "p2", "conv_id", "n_convs", "n_children").join(parents, ["depth", "p1", "p2"], "left"), "trie-placed")
    return (placed.join(totals, NODE).join(ends, NODE, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    F.col("tokens").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256")))
