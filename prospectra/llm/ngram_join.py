"""N-gram Jaccard join: which documents share enough five-word shingles, and the groups that follow.

Two texts link when their shingle sets have a Jaccard similarity of 0.8 or
more.  The steps, all of them joins and counts in Spark:

1. *Order.*  Tasks send sorted blocks of shingle keys per key range; a range's
   blocks are merged to exact document frequencies.  Shingles of one document
   come first in the global order, then shared ones, then the ``TOP`` most
   frequent by rising frequency.  Any total order gives the same links; this
   one keeps frequent shingles out of the prefixes.  Tasks hold two things of
   fixed size: the table of the ``TOP`` keys and a bitmap of shared keys.
2. *Prefixes.*  Each text gives the first ``n - ceil(0.8 n) + 1`` shingles of
   that order with their positions; those that no second document holds meet
   nobody and are not sent.  Equal sets are one node from here on.
3. *Candidates.*  Prefixes join on the shingle, under the length filter and the
   positional filter.  A round first pairs each node with one leader per
   shingle, the node with the fewest rarer shingles, so a group of thousands
   of copies costs one pair per copy.  A second round pairs what still lies in
   different components, so no link between different components is lost.
4. *Verification.*  A pair is taken once, passes the suffix filter on bin
   counts of both sets, and its two texts are compared exactly.
5. *Components* by repeated smallest-label steps, each written to the shared
   folder.

A node is a class of equal sets, told apart by 128 bits of the set and numbered
in a written table.  ``links`` gives all pairs of nodes that link, for callers
that want more than components; ``link_counts`` the number per document.

Defined results: a text with fewer than five words has one shingle, all its
words; NULL texts and texts without words have none and link with nothing.
Rows that repeat an id are rows of their own; the component id is the smallest
id of the component's rows (NULL if all are NULL).  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectra.llm.common import free_name, in_slices, ready_for_python, small_or_plain
from prospectra.session import write_and_read_back

SHINGLE = 5
NUMERATOR, DENOMINATOR = 80, 100
# The frequent end of the order that tasks hold in memory: so many keys at most.
TOP = 1_000_000
LEAST_TOP_FREQUENCY = 8
# A full bitmap prunes less; links stay.
BITMAP_BITS = 28
# Shingles that one task counts together, at most about so many; and those of a block that is sent.
RANGE_KEYS = 1_000_000
BLOCK_KEYS = 3_000_000
BINS = 32
# Nodes with their bins that a join may broadcast.
SIDE_ROWS = 100_000
_LEAST_RANGE_BITS, _MOST_RANGE_BITS, _LEAST_KEY_BITS = 8, 18, 40
_BYTES_PER_SHINGLE = 6

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def exact_shingles(text: str | None) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(SHINGLE)]))


class Hasher:
    """Shingle hashes of texts; keeps word hashes between texts, up to a bound."""
    WORDS = 250_000

    def __init__(self) -> None:
        self._known: dict[bytes, int] = {}

    def _word_hashes(self, words: list[bytes]) -> np.ndarray:
        known, hashed = self._known, xxhash.xxh64_intdigest
        if len(known) > self.WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = hashed(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        """The distinct 64-bit shingle hashes, sorted."""
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        h = self._word_hashes(words)
        n = max(len(h) - SHINGLE + 1, 1)
        acc = np.full(n, np.uint64(min(len(h), SHINGLE)))
        for i in range(min(len(h), SHINGLE)):
            acc = (acc ^ h[i:i + n]) * _MULTIPLY
            acc ^= acc >> np.uint64(29)
        acc = acc * _MIX
        return np.unique(acc ^ (acc >> np.uint64(32)))


def _top_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


# 1. Order ------------------------------------------------------------------

class Sizes(NamedTuple):
    """How frequencies are counted: by the top bits of a shingle's hash, in ranges of those keys.

    Both grow with the texts, so a range stays about as large and keys stay apart.
    """
    key_bits: int
    range_bits: int

    @classmethod
    def of(cls, text_bytes: int) -> Sizes:
        shingles = max(text_bytes // _BYTES_PER_SHINGLE, 1)
        range_bits = min(_MOST_RANGE_BITS, max(_LEAST_RANGE_BITS, (shingles // RANGE_KEYS).bit_length()))
        # A step inside a range must fit in 32 bits.
        return cls(min(range_bits + 32, max(_LEAST_KEY_BITS, shingles.bit_length() + 12)), range_bits)

    @property
    def width(self) -> int:
        return self.key_bits - self.range_bits


def _key_blocks(sizes: Sizes):
    """Per ``BLOCK_KEYS`` keys and key range: the distinct keys as 32-bit steps, so that they pack well.

    A key that several documents of the block hold is sent once, its place and
    how many more hold it beside the steps: a passage in a third of all texts
    costs its range one entry per block.
    """
    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        hasher, held, size = Hasher(), [], 0
        for batch in in_slices(batches, 0):
            new = [_top_bits(hasher(t), sizes.key_bits) for t in batch.column(0).to_pylist()]
            held += new
            size += sum(map(len, new))
            if size >= BLOCK_KEYS:
                keys = np.concatenate(held)
                held, size = [], 0
                keys.sort()
                yield keys
        keys = np.concatenate([*held, np.empty(0, np.uint64)])
        held = []
        keys.sort()
        yield keys

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.uint64(sizes.width)
        for keys in runs(batches):
            first = np.flatnonzero(np.r_[np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]])
            count = np.diff(first, append=len(keys)).astype(np.uint32)
            keys = keys[first]
            del first
            cuts = np.searchsorted(keys, np.arange((1 << sizes.range_bits) + 1, dtype=np.uint64) << width)
            ranges, blocks, places, more = [], [], [], []
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                part = keys[cuts[r]:cuts[r + 1]] - (np.uint64(r) << width)
                extra = count[cuts[r]:cuts[r + 1]] - 1
                at = np.flatnonzero(extra)
                ranges.append(r)
                blocks.append(np.diff(part, prepend=np.uint64(0)).astype(np.uint32).tobytes())
                places.append(at.astype(np.uint32).tobytes())
                more.append(extra[at].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges, pa.int32()), *(pa.array(x, pa.binary()) for x in (blocks, places, more))],
                ["range", "block", "places", "more"])
    return run


def _merge_blocks(sizes: Sizes):
    """One range: the bitmap slice of keys that two documents hold, and the frequent keys."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        r = key[0].as_py()
        keys, held = [], []
        for block, places, more in zip(*(table.column(c).to_pylist() for c in ("block", "places", "more"))):
            keys.append(np.cumsum(np.frombuffer(block, np.uint32), dtype=np.uint64))
            held.append(np.ones(len(keys[-1]), np.uint32))
            held[-1][np.frombuffer(places, np.uint32)] += np.frombuffer(more, np.uint32)
        keys, held = np.concatenate(keys), np.concatenate(held)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        found, count = keys[first], np.add.reduceat(held[order].astype(np.int64), first)
        bits = np.zeros(1 << BITMAP_BITS - sizes.range_bits, bool)
        bits[found[count > 1] >> np.uint64(sizes.key_bits - BITMAP_BITS)] = True
        often = count >= LEAST_TOP_FREQUENCY
        base = np.uint64(r) << np.uint64(sizes.width)
        return pa.table({
            "range": pa.array([r], pa.int32()), "shared": pa.array([np.packbits(bits).tobytes()], pa.binary()),
            "keys": pa.array([(found[often] + base).astype(np.int64)], pa.list_(pa.int64())),
            "counts": pa.array([count[often].astype(np.int64)], pa.list_(pa.int64()))})
    return run


class Order:
    """The global order of shingles: rare first, by listed frequency and hash."""

    def __init__(self, sizes: Sizes, keys: np.ndarray, counts: np.ndarray, shared: np.ndarray) -> None:
        self.key_bits, self.keys, self.counts, self.shared = sizes.key_bits, keys, counts, shared

    def sort(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes in order, and which of them a second document may hold."""
        bit = _top_bits(h, BITMAP_BITS)
        met = (self.shared[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1
        rank = met.astype(np.int64)
        if len(self.keys):
            k = _top_bits(h, self.key_bits)
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            rank = np.where(self.keys[at] == k, self.counts[at], rank)
        order = np.lexsort((h, rank))
        return h[order], rank[order] > 0


def shingle_order(texts: DataFrame, top: int = TOP) -> Order:
    """Count every text's shingles; what comes to the driver has a fixed bound.

    That is ``2 ** BITMAP_BITS`` bits and at most ``top`` keys: the cut is the
    smallest frequency that no more than ``top`` keys reach.
    """
    sizes = Sizes.of(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    counted = write_and_read_back(
        texts.mapInArrow(_key_blocks(sizes), "range int, block binary, places binary, more binary").groupBy("range").applyInArrow(
            _merge_blocks(sizes), "range int, shared binary, keys array<long>, counts array<long>"), "shingle-frequencies")
    pairs = counted.select(F.explode(F.arrays_zip("keys", "counts")).alias("k")).select("k.keys", "k.counts")
    reached = F.sum("n").over(Window.orderBy(F.desc("counts")))
    least = (pairs.groupBy("counts").agg(F.count("*").alias("n")).orderBy(F.desc("counts")).limit(top)
             .select("counts", reached.alias("reached")).where(F.col("reached") <= top).agg(F.min("counts")).first()[0])
    shared = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
    size = len(shared) >> sizes.range_bits
    for row in counted.select("range", "shared").collect():
        shared[row["range"] * size:(row["range"] + 1) * size] = np.frombuffer(row["shared"], np.uint8)
    listed = (pairs.where(F.col("counts") >= least) if least else pairs.limit(0)).toArrow()
    keys = listed.column("keys").to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    return Order(sizes, keys[order], listed.column("counts").to_numpy()[order].astype(np.int64), shared)


# 2. Prefixes ---------------------------------------------------------------

_SETS = ("doc_id long, text_hash long, n long, set_a long, set_b long, bins array<int>, tokens array<long>, "
         "places array<int>")


def prefix_size(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def _lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*parts, np.empty(0, kind)]).astype(kind))


def _sets(order: Broadcast):
    """Per text: set size and hashes, bin counts, and the prefix shingles that others may hold."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in in_slices(batches, 2):
            ns, names, bins, tokens, places = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                h = hasher(text)
                ns.append(len(h))
                names.append(xxhash.xxh128_digest(h.tobytes()))
                bins.append(np.bincount((h >> np.uint64(59)).astype(np.int64), minlength=BINS))
                prefix, met = order.value.sort(h)
                at = np.flatnonzero(met[:prefix_size(len(h))]) if len(h) else np.empty(0, np.int64)
                tokens.append(prefix[at].view(np.int64))
                places.append(at)
            name = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(name[:, 0]), pa.array(name[:, 1]),
                 _lists(bins, np.int32), _lists(tokens, np.int64), _lists(places, np.int32)],
                ["doc_id", "text_hash", "n", "set_a", "set_b", "bins", "tokens", "places"])
    return run


def _read(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"),
                       F.col(text).cast("string").alias("text"))


def shingle_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", top: int = TOP) -> DataFrame:
    """A written table of one row per document: its set in numbers, and its prefix."""
    ready_for_python(docs)
    rows = _read(docs, doc_id, text)
    order = docs.sparkSession.sparkContext.broadcast(shingle_order(rows.select("text"), top))
    return write_and_read_back(rows.mapInArrow(_sets(order), _SETS), "shingle-sets")


def set_nodes(sets: DataFrame) -> DataFrame:
    """A written table of one row per distinct set that has shingles, combined map-side.

    ``node`` is a number given out at writing, ``rows`` the rows of the set, and
    (doc_id, text_hash) its first row: smallest id, rows without an id last.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    same = [F.first(c).alias(c) for c in ("n", "bins", "tokens", "places")]
    found = sets.where("n > 0").groupBy("set_a", "set_b").agg(F.count("*").alias("rows"), first, *same)
    return write_and_read_back(found.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", "rows",
                                            "first.*", "n", "bins", "tokens", "places"), "set-nodes")


# 3. Candidates -------------------------------------------------------------

def least_overlap(n_a: Column, n_b: Column) -> Column:
    """The smallest intersection size that reaches the threshold."""
    return F.ceil(NUMERATOR * (n_a + n_b) / (NUMERATOR + DENOMINATOR))


def _may_link(a: str, b: str) -> Column:
    """Length filter, and positional filter as if this were the pair's first common shingle.

    The order is global, so of a pair's common shingles the first gives the
    highest bound: a pair that links passes there.
    """
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    return ((DENOMINATOR * F.least(n_a, n_b) >= NUMERATOR * F.greatest(n_a, n_b))
            & (F.least(n_a - F.col(f"{a}.pos"), n_b - F.col(f"{b}.pos")) >= least_overlap(n_a, n_b)))


def prefix_entries(nodes: DataFrame) -> DataFrame:
    """A written table (token, node, n, pos, lead) of prefix shingles that several nodes hold.

    ``lead`` is a shingle's smallest (share of rarer shingles, node) in one
    number; its holder leads.
    """
    entry = F.explode(F.arrays_zip("tokens", "places")).alias("e")
    entries = write_and_read_back(nodes.select("node", "n", entry).select(
        F.col("e.tokens").alias("token"), "node", "n", F.col("e.places").alias("pos")), "prefix-entries")
    share = F.floor(F.col("pos") * 4096 / F.col("n")).cast("long")
    entries = entries.withColumn("rank", F.shiftleft(share, 50) + F.shiftrightunsigned(F.xxhash64("node"), 14))
    held = (entries.groupBy("token").agg(F.count("*").alias("nodes"), F.min("rank").alias("lead"))
            .where("nodes > 1").select("token", "lead"))
    held = write_and_read_back(held, "shared-tokens")
    return write_and_read_back(entries.join(held, "token"), "shared-entries")


def candidates_to_leaders(entries: DataFrame) -> DataFrame:
    """One pair per node and shingle: the node with the shingle's leader."""
    leaders = write_and_read_back(entries.where("rank = lead").select("token", "node", "n", "pos"), "leaders")
    met = entries.alias("a").join(leaders.alias("b"), (F.col("a.token") == F.col("b.token")) & _may_link("a", "b")
                                  & (F.col("a.node") != F.col("b.node")))
    return _distinct_pairs(met)


def candidates_across(entries: DataFrame, component: DataFrame) -> DataFrame:
    """All pairs that meet on a shingle and are not yet in one component."""
    placed = write_and_read_back(
        entries.join(component, "node", "left").select(
            "token", "node", "n", "pos", F.coalesce("component", "node").alias("component")), "placed-entries")
    mixed = write_and_read_back(
        placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi").select("token"), "mixed-tokens")
    rest = write_and_read_back(placed.join(mixed, "token", "left_semi"), "rest-entries")
    met = rest.alias("a").join(rest.alias("b"), (F.col("a.token") == F.col("b.token")) & _may_link("a", "b")
                               & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")))
    return _distinct_pairs(met)


def _distinct_pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


# 4. Verification -----------------------------------------------------------

def linked(first: set, second: set) -> bool:
    both = len(first & second)
    return bool(both) and DENOMINATOR * both >= NUMERATOR * (len(first) + len(second) - both)


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, first = None, set()
    for batch in in_slices(batches, 3):
        keep = []
        for a, text_a, text_b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            if a != last:
                last, first = a, exact_shingles(text_a)
            keep.append(linked(first, exact_shingles(text_b)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs that really link, as a written table (a, b).  Each pair's texts are compared once.

    Both sides of every join are written tables: a leader with a great many
    pairs is split by adaptive execution, or meets a small side by broadcast.
    """
    pairs = write_and_read_back(pairs, "pairs")
    met = _ends(pairs, "pair-nodes")
    sides = write_and_read_back(nodes.select("node", "n", "bins", "doc_id", "text_hash").join(small_or_plain(met), "node"),
                                "pair-sides")
    small = small_or_plain(sides.select("node", "n", "bins"), SIDE_ROWS)
    a, b = (small.toDF(s, f"n_{s}", f"bins_{s}") for s in "ab")
    apart = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda x, y: x + y)
    near = (pairs.join(a, "a").join(b, "b")
            .where(apart <= F.col("n_a") + F.col("n_b") - 2 * least_overlap(F.col("n_a"), F.col("n_b"))).select("a", "b"))
    near = write_and_read_back(near, "near-pairs")
    wanted = write_and_read_back(sides.select("node", "doc_id", "text_hash").join(
        small_or_plain(_ends(near, "near-nodes")), "node"), "wanted-texts")
    found = (_read(docs, doc_id, text).alias("d").join(
        small_or_plain(wanted).alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
        & (F.col("d.text_hash") == F.col("w.text_hash"))).select("node", "text").dropDuplicates(["node"]))
    found = write_and_read_back(found, "near-texts")
    paired = (near.join(found.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
              .join(found.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
              .select("a", "b", "text_a", "text_b"))
    return write_and_read_back(paired.mapInArrow(_compare, "a long, b long"), "links")


def _ends(pairs: DataFrame, name: str) -> DataFrame:
    return write_and_read_back(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), name)


# 5. Components -------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node.

    Every step takes the smallest label among neighbours, then the label's own
    label, and is written before the next one reads it.
    """
    edges = write_and_read_back(links.select(F.col("a").alias("node"), F.col("b").alias("other"))
                                .union(links.select("b", "a")), "edges")
    labels = write_and_read_back(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("other"), F.col("component").alias("seen")), "other")
        nearest = seen.groupBy("node").agg(F.min("seen").alias("seen"))
        lower = labels.join(nearest, "node").select("node", F.least("component", "seen").alias("component"),
                                                    F.col("component").alias("before"))
        lower = write_and_read_back(lower, "labels")
        jumps = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        after = write_and_read_back(lower.join(jumps, "component").select("node", F.col("root").alias("component"), "before"),
                                    "labels")
        if after.where("component <> before").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, n, component_id, kept_hash), one row per document.

    A component keeps the row of its smallest id (NULL if all are NULL) and, of that id's texts
    in the component, the smallest text hash.  Both are NULL for rows without shingles.
    """
    sets = shingle_sets(docs, doc_id, text)
    nodes = set_nodes(sets)
    entries = prefix_entries(nodes)
    links_ = verify(candidates_to_leaders(entries), nodes, docs, doc_id, text)
    rest = verify(candidates_across(entries, components(links_)), nodes, docs, doc_id, text)
    found = components(links_.union(rest))
    classes = write_and_read_back(
        nodes.select("node", "set_a", "set_b", F.struct("unnamed", "doc_id", "text_hash").alias("first"))
        .join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "classes")
    named = write_and_read_back(classes.groupBy("component").agg(F.min("first").alias("first")).select(
        "component", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("kept_hash")), "components")
    named = write_and_read_back(classes.join(named, "component").select("set_a", "set_b", "component_id", "kept_hash"),
                                "class-names")
    return sets.join(named, ["set_a", "set_b"], "left").select("doc_id", "text_hash", "n", "component_id", "kept_hash")


# 6. Results ----------------------------------------------------------------

def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """All links between different sets: written tables of the sets, the nodes and the links (a, b).

    No pair of a component is left out here, so a group of many different near
    copies costs all its links.  Rows of one node link with each other.
    """
    sets = shingle_sets(docs, doc_id, text)
    nodes = set_nodes(sets)
    pairs = candidates_across(prefix_entries(nodes), nodes.select("node", F.col("node").alias("component")))
    return sets, nodes, verify(pairs, nodes, docs, doc_id, text)


def link_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, n_links), one row per document; rows with an equal set count as links, too."""
    sets, nodes, found = links(docs, doc_id, text)
    rows = nodes.select("node", "rows")
    ends = found.select(F.col("a").alias("node"), F.col("b").alias("other")).union(found.select("b", "a"))
    met = ends.join(rows.toDF("other", "met"), "other").groupBy("node").agg(F.sum("met").alias("met"))
    counted = write_and_read_back(nodes.select("node", "set_a", "set_b", "rows").join(met, "node", "left").select(
        "set_a", "set_b", (F.col("rows") - 1 + F.coalesce("met", F.lit(0))).alias("n_links")), "link-counts")
    return sets.join(counted, ["set_a", "set_b"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    return _grouped(docs, doc_id, text).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each component, the one with the smallest id.

    Rows are told apart by id and text, so another text with the same id, or
    with no id, is judged by its own component.  Rows without shingles all
    stay; where kept rows share an id and text, one stays.
    """
    found = write_and_read_back(_grouped(docs, doc_id, text), "near-duplicates").where("n > 0")
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("kept_hash"))
    names = [free_name(docs.columns, n) for n in ("row_id", "row_hash")]
    gone_names = [free_name([*docs.columns, *names], n) for n in ("gone_id", "gone_hash")]
    keyed = docs.select("*", F.col(doc_id).cast("long").alias(names[0]), F.xxhash64(F.col(text)).alias(names[1]))

    def rows_of(keys: DataFrame, name: str) -> tuple[DataFrame, Column]:
        keys = small_or_plain(write_and_read_back(keys, name)).toDF(*gone_names)
        return keys, F.col(names[0]).eqNullSafe(F.col(gone_names[0])) & (F.col(names[1]) == F.col(gone_names[1]))

    kept = keyed.join(*rows_of(found.where(~first).select("doc_id", "text_hash").distinct(), "left-out"), "left_anti")
    repeated = found.where(first).groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    if repeated.isEmpty():
        return kept.drop(*names)
    repeated, same = rows_of(repeated, "repeated-rows")
    return (kept.join(repeated, same, "left_anti")
            .unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(names)).drop(*names))
