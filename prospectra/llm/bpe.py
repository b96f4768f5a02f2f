"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pre-tokens a task has not met yet are laid end to end, with borders that
no merge crosses, and one queue works through them all.  Its buckets, one per
merge rank, hold positions of a linked list; three levels of bitmaps tell which
buckets hold any, so finding the lowest set bit at each level gives the next
rank.  Merging leaves old entries behind in other buckets: an entry counts only
if the pair at its position still has the bucket's rank.  The cost is one push
per created pair, whatever a pre-token's length, where rescanning for the best
pair would cost the square of it.

Defined results: a NULL text is empty and has no tokens; repeated rows are
encoded row by row; other columns are passed through untouched.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra.llm.common import SLICE_BYTES, free_name, in_slices, ready_for_python

# Pre-tokens that a task remembers; beyond, it keeps those of the texts at hand.
REMEMBERED = 300_000
REMEMBERED_BYTES = 64


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


class RankQueue:
    """Positions by rank; ``first()`` is the smallest rank that has any."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self._low: dict[int, int] = {}
        self._middle: dict[int, int] = {}
        self._top = 0

    def open(self, rank: int, positions: list[int]) -> None:
        """Start a bucket; later positions are appended to it."""
        self.buckets[rank] = positions
        word, block = rank >> 6, rank >> 12
        self._low[word] = self._low.get(word, 0) | 1 << (rank & 63)
        self._middle[block] = self._middle.get(block, 0) | 1 << (word & 63)
        self._top |= 1 << block

    def first(self) -> int:
        """The smallest rank with a bucket, or -1."""
        if not self._top:
            return -1
        block = (self._top & -self._top).bit_length() - 1
        bits = self._middle[block]
        word = block << 6 | (bits & -bits).bit_length() - 1
        bits = self._low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def close(self, rank: int) -> None:
        """Take a bucket out, and the bits above it where nothing is left below."""
        del self.buckets[rank]
        word, block = rank >> 6, rank >> 12
        self._low[word] &= ~(1 << (rank & 63))
        if not self._low[word]:
            self._middle[block] &= ~(1 << (word & 63))
            if not self._middle[block]:
                self._top &= ~(1 << block)


class Codec:
    """Encode and decode by a table of byte strings and ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self._one = np.array([ranks.get(bytes([a]), -1) for a in range(256)])
        self._two = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self._known: dict[str, bytes] = {}

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each byte string, all worked through one rank queue."""
        ids, ends = self._merged(words)
        return [part.tolist() for part in np.split(ids, ends[:-1])] if words else []

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in one row, and where each word's end.

        Merging makes a longer string, so no new pair falls into the bucket at
        hand; if one falls below it, the queue turns there first.
        """
        data, rank_of = b"".join(words), self.ranks.get
        size = len(data)
        border = bytearray(size + 1)
        starts = np.cumsum([0, *map(len, words)])
        np.frombuffer(border, np.uint8)[starts] = 1
        after = list(range(1, size + 1))    # start of the next part
        before = list(range(-1, size - 1))  # start of the part before
        token = self._one[np.frombuffer(data, np.uint8)].tolist()  # id of the part that starts here
        gone = bytearray(size)              # no part starts here any more
        queue, pair = self._pairs(data, border)
        buckets, start = queue.buckets, queue.open
        rank = queue.first()
        while rank >= 0:
            bucket = buckets[rank]
            bucket.sort(reverse=True)
            lower = False
            while bucket and not lower:
                i = bucket.pop()
                if pair[i] != rank:
                    continue                # stale
                j = after[i]
                k = after[i] = after[j]
                token[i] = rank
                gone[j] = 1
                pair[i] = pair[j] = -1
                if not border[k]:
                    before[k] = i
                    new = rank_of(data[i:after[k]], -1)
                    if new >= 0:
                        pair[i] = new
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            start(new, [i])
                        lower = new < rank
                if not border[i]:
                    h = before[i]
                    new = pair[h] = rank_of(data[h:k], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            start(new, [h])
                        lower = lower or new < rank
            if not bucket:
                queue.close(rank)
            rank = queue.first()
        stays = np.frombuffer(gone, np.uint8) == 0
        return np.array(token, np.uint32)[stays], np.concatenate([[0], np.cumsum(stays)])[starts[1:]]

    def _pairs(self, data: bytes, border: bytearray) -> tuple[RankQueue, list[int]]:
        """The queue of all adjacent bytes' ranks, and the rank at each position (-1: none)."""
        queue = RankQueue()
        byte = np.frombuffer(data, np.uint8).astype(np.int64)
        pair = np.full(len(byte), -1)
        pair[:-1] = np.where(np.frombuffer(border, np.uint8)[1:-1] > 0, -1, self._two[byte[:-1] << 8 | byte[1:]])
        order = np.argsort(pair, kind="stable")
        order = order[pair[order] >= 0]
        ranks, cuts = np.unique(pair[order], return_index=True)
        for rank, positions in zip(ranks.tolist(), np.split(order, cuts[1:])):
            queue.open(rank, positions.tolist())
        return queue, pair.tolist()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        pieces = [self.split(t) for t in texts]
        if len(self._known) > REMEMBERED:
            # What occurs here is what is most likely to occur next.
            self._known = {p: b for p in {p for parts in pieces for p in parts} if (b := self._known.get(p)) is not None}
        known, look_up = self._known, self._known.get
        found = [list(map(look_up, parts)) for parts in pieces]
        fresh = {p for parts, ids in zip(pieces, found) if None in ids for p, i in zip(parts, ids) if i is None}
        rest = []
        for p in fresh:
            data = p.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            if whole is None:
                rest.append((data, p))
            else:
                known[p] = whole.to_bytes(4, "little")
        if rest:
            rest.sort()
            ids, ends = self._merged([data for data, _ in rest])
            packed, at = ids.astype("<u4").tobytes(), 0
            for (_, p), end in zip(rest, (ends * 4).tolist()):
                known[p] = packed[at:end]
                at = end
        out = [b"".join(ids) if None not in ids else b"".join([known[p] if i is None else i for p, i in zip(parts, ids)])
               for parts, ids in zip(pieces, found)]
        for data, p in rest:
            if len(data) > REMEMBERED_BYTES:
                del known[p]
        return out

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_batch([text])[0]).cast("I").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> Codec:
    """One per worker process: loaded once, reused by its later tasks."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Codec(ranks, pattern)


@contextmanager
def _no_cycle_search() -> Iterator[None]:
    """The work makes many lists and no cycles; searching for some took a third of its time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _codec_run(at: int, names: list[str], vocabulary: str, pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in in_slices(batches, at, 2 * SLICE_BYTES):
            with _no_cycle_search():
                ids = own.encode_batch([t or "" for t in batch.column(at).to_pylist()])
                made = [ids, [own.decode(memoryview(b).cast("I")) for b in ids]][:len(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(m, pa.binary()) for m in made]],
                                             [*batch.schema.names, *names])
    return run


def _added(docs: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([*docs.schema.fields, *[T.StructField(n, T.BinaryType()) for n in names]])


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text``, as little-endian unsigned 32-bit numbers.  No shuffle."""
    names = [free_name(docs.columns, ids)]
    ready_for_python(docs)
    return docs.mapInArrow(_codec_run(docs.columns.index(text), names, vocabulary or default_vocabulary(),
                                      pattern or default_pattern()), _added(docs, names))


def round_trip(docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded",
               vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """As ``encode``, with the bytes that the ids decode to, in the same pass."""
    names = [free_name(docs.columns, ids), free_name(docs.columns, decoded)]
    ready_for_python(docs)
    return docs.mapInArrow(_codec_run(docs.columns.index(text), names, vocabulary or default_vocabulary(),
                                      pattern or default_pattern()), _added(docs, names))


def decode(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded", vocabulary: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """``encoded`` with the bytes that its ids stand for; NULL ids stay NULL."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    ready_for_python(encoded)
    at, names = encoded.columns.index(ids), [free_name(encoded.columns, decoded)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in in_slices(batches, at):
            made = [None if b is None else own.decode(memoryview(b).cast("I")) for b in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, *names])

    return encoded.mapInArrow(run, _added(encoded, names))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by a full round trip."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return round_trip(rows).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                                   F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
