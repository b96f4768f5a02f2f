"""SentencePiece encoding and decoding for merge-type models, by exact backtracking.

A merge-type model starts from single characters and always joins the adjacent
pair whose piece scores best, the leftmost of equals.  Its result has a simple
test: a row of pieces is *the* encoding of its text if and only if merging the
text of every two neighbours anew gives these two pieces back.  So the encoder
takes the longest piece that starts at a position (an Aho-Corasick automaton
finds all pieces of a text in one pass), keeps it if it is compatible with the
piece before it, tries the next shorter one otherwise, and steps back where
none is left.  A position has one valid way to be reached, so a position that
failed once has failed for good: a bit field remembers it, and the search is
linear in practice and never exponential.

Merging two neighbours anew needs no characters: of a piece's own merges only
those matter that change the symbol at its edge.  Each piece's edges and the
worst merge that stands before each change are worked out once; a pair is
compatible if, as both sides grow, no merge across the border ever comes first.

Characters in no piece become one byte piece per UTF-8 byte.  Texts are cut
where no piece can reach across (before a run of blanks, around characters of no
piece, between a letter and a mark that follows one in no piece), and parts
already met are remembered, within bounds.

Only models that keep texts as they are (identity normalisation, blanks kept,
one blank put in front, byte fallback) are accepted; others are refused when
the model is loaded.

Defined results: a NULL or empty text has no ids and decodes to the empty text;
NULL ids decode to NULL; repeated rows are encoded row by row; other columns
are passed through, and a name that is taken gets underscores in front.  Texts
of any length are encoded whole: memory is bounded by a few slices of text or
the longest text.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra.llm.common import SLICE_BYTES, free_name, in_slices, ready_for_python

BLANK = "▁"
# Parts of texts and pairs of pieces that a task remembers.
REMEMBERED = 300_000
REMEMBERED_CHARS = 64
REMEMBERED_PAIRS = 500_000

# Kinds of pieces in a model file, and the kind of a merge-type model.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_MERGE_TYPE = 2
_REPLACEMENT = "�"
_LETTER = "[0-9A-Za-zÀ-ɏ]"


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


# Bytes that are no UTF-8 are replaced one by one.
codecs.register_error("each-byte", lambda e: (_REPLACEMENT, e.start + 1))


class Edges:
    """How one edge of a piece changes while the piece is merged: the first symbol,
    then (worst merge needed, symbol) per change.  Merges compare by -score."""

    def __init__(self, first: str, steps: list[tuple[float, str]]) -> None:
        self.first, self.steps = first, steps


class Codec:
    def __init__(self, pieces: Sequence[tuple[str, float, int]], unknown: str = " ⁇ ") -> None:
        """``pieces``: (text, score, kind) in the order of their ids."""
        self.score = {p: s for p, s, kind in pieces if kind == _NORMAL}
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        self._byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        if len(self._byte_ids) != 256:
            raise ValueError("the model has no piece for every byte")
        self._surfaces = [self._surface(p, kind, unknown) for p, _, kind in pieces]
        self._control = frozenset(i for i, (_, _, kind) in enumerate(pieces) if kind == _CONTROL)
        self._stripped = frozenset(i for i, (p, _, kind) in enumerate(pieces) if kind == _NORMAL and p.startswith(BLANK))
        # A piece that its own text does not merge to can never be a result.
        reachable = [p for p in self.score if self.merge(p) == [p]]
        self._automaton = ahocorasick.Automaton()
        for p in reachable:
            self._automaton.add_word(p, p)
        self._automaton.make_automaton()
        known = set(reachable)
        self._shorter = {p: next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in known), p[0])
                         for p in reachable if len(p) > 1}
        self._packed = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self._cut, self._separator = self._cuts()
        self._parts: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._left: dict[str, Edges] = {}
        self._right: dict[str, Edges] = {}

    @staticmethod
    def _surface(piece: str, kind: int, unknown: str) -> bytes:
        if kind == _BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == _CONTROL else (unknown if kind == _UNKNOWN else piece.replace(BLANK, " ")).encode()

    def _cuts(self) -> tuple[re.Pattern, str]:
        """Where texts are cut: at places that no piece reaches across."""
        chars = {c for p in self.score for c in p}
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in chars)
        separator = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in chars)
        if any(BLANK in p.lstrip(BLANK) for p in self.score):   # a piece goes on after a blank
            return re.compile(f"[^{alone}]+|[{alone}]" if alone else ".+", re.DOTALL), separator
        after_letter = {b for p in self.score for a, b in zip(p, p[1:]) if re.match(_LETTER, a)}
        marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if c in chars and not c.isalnum() and c not in after_letter)
        inner = f"(?:[^{BLANK}{alone}{marks}]+" + (f"|(?<!{_LETTER})[{marks}])*" if marks else ")*")
        return re.compile(f"{BLANK}+{inner}|[^{BLANK}{alone}]{inner}" + (f"|[{alone}]" if alone else "")), separator

    # Merging -----------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """The model's result for a short text, by merging its characters one pair at a time."""
        return self._merged(text)[0]

    def _merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The pieces, and per merge (-score, first symbol, last symbol) after it."""
        symbols, history, score = list(text), [], self.score.get
        while len(symbols) > 1:
            best = min((-s, i) for i in range(len(symbols) - 1)
                       for s in (score(symbols[i] + symbols[i + 1], -np.inf),))
            if best[0] == np.inf:
                break
            i = best[1]
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            history.append((best[0], symbols[0], symbols[-1]))
        return symbols, history

    def _edges(self, piece: str) -> tuple[Edges, Edges]:
        """The left and the right edge of a piece."""
        history, out = self._merged(piece)[1], []
        for side, first in ((1, piece[0]), (2, piece[-1])):
            steps, now, worst = [], first, -np.inf
            for entry in history:
                worst = max(worst, entry[0])
                if entry[side] != now:
                    now = entry[side]
                    steps.append((worst, now))
                    worst = -np.inf
            out.append(Edges(first, steps))
        self._left[piece], self._right[piece] = out
        return out[0], out[1]

    def compatible(self, a: str, b: str) -> bool:
        """Whether ``a + b``, merged anew, gives these two pieces."""
        right = (self._right.get(a) or self._edges(a)[1])
        left = (self._left.get(b) or self._edges(b)[0])
        x, y, i, j, score = right.first, left.first, 0, 0, self.score.get
        while True:
            # Of equal scores the leftmost goes first: inside a, then across, then inside b.
            in_a = right.steps[i][0] if i < len(right.steps) else np.inf
            in_b = left.steps[j][0] if j < len(left.steps) else np.inf
            across = score(x + y)
            if across is not None and -across < in_a and -across <= in_b:
                return False
            if in_a == np.inf and in_b == np.inf:
                return True
            if in_a <= in_b:
                x, i = right.steps[i][1], i + 1
            else:
                y, j = left.steps[j][1], j + 1

    # Encoding ----------------------------------------------------------------

    def pieces_of(self, parts: Sequence[str]) -> Iterator[list[str]]:
        """The pieces (and characters of no piece) of each part; one automaton pass over all."""
        row = self._separator.join(parts)
        longest: list[str | None] = [None] * (len(row) + 1)
        for end, piece in self._automaton.iter(row):
            longest[end + 1 - len(piece)] = piece     # longer ones end later
        start = 0
        for part in parts:
            yield self._search(row, start, start + len(part), longest)
            start += len(part) + 1

    def _search(self, row: str, start: int, end: int, longest: list[str | None]) -> list[str]:
        pairs, shorter = self._pairs, self._shorter
        failed: bytearray | None = None
        path: list[str] = []
        at, before, piece = start, "", ""
        while at < end:
            piece = piece or longest[at] or row[at]
            while piece:
                to = at + len(piece)
                if failed is None or not failed[to - start >> 3] >> (to - start & 7) & 1:
                    if not before:
                        break
                    fits = pairs.get((before, piece))
                    if fits is None:
                        fits = pairs[before, piece] = self.compatible(before, piece)
                    if fits:
                        break
                piece = shorter.get(piece, "")
            if piece:
                path.append(piece)
                at, before, piece = to, piece, ""
                continue
            if failed is None:
                failed = bytearray((end - start >> 3) + 1)
            failed[at - start >> 3] |= 1 << (at - start & 7)
            last = path.pop()       # the first character alone always leads to a result, so there is one
            at -= len(last)
            before, piece = path[-1] if path else "", shorter.get(last, "")
            while not piece:        # nothing shorter: step back further
                failed[at - start >> 3] |= 1 << (at - start & 7)
                last = path.pop()
                at -= len(last)
                before, piece = path[-1] if path else "", shorter.get(last, "")
        return path

    def _pack(self, piece: str) -> bytes:
        return b"".join(self._byte_ids[b].to_bytes(4, "little") for b in piece.encode("utf-8", "surrogatepass"))

    def encode_batch(self, texts: Sequence[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        texts = [self._cut.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        if len(self._parts) > REMEMBERED // 2:
            # Two generations: what is met again moves to the younger one, the rest goes with the older one.
            self._parts, self._older = {}, self._parts
        if len(self._pairs) > REMEMBERED_PAIRS:
            self._pairs.clear()
        known, older, get = self._parts, self._older, self._packed.get
        fresh = []
        for p in {p for parts in texts for p in parts}:
            if p not in known:
                ids = older.get(p)
                if ids is None:
                    fresh.append(p)
                else:
                    known[p] = ids
        for part, pieces in zip(fresh, self.pieces_of(fresh)):
            known[part] = b"".join([get(p) or self._pack(p) for p in pieces])
        out = [b"".join(map(known.__getitem__, parts)) for parts in texts]
        for p in fresh:
            if len(p) > REMEMBERED_CHARS:
                del known[p]
        return out

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_batch([text])[0]).cast("I").tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """The text of any ids; the blank in front of the first piece goes."""
        if self._control.isdisjoint(ids):
            data = b"".join(map(self._surfaces.__getitem__, ids))
            return (data[1:] if len(ids) and ids[0] in self._stripped else data).decode("utf-8", "each-byte")
        # Control ids have no text, but the bytes on their two sides make no character together.
        seen = [i for i in ids if i not in self._control]
        data, runs = b"", []
        for i in ids:
            if i in self._control:
                runs.append(data)
                data = b""
            else:
                data += self._surfaces[i]
        text = "".join(run.decode("utf-8", "each-byte") for run in [*runs, data])
        return text[1:] if seen and seen[0] in self._stripped else text


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    """One per worker process: loaded once, reused by its later tasks."""
    from sentencepiece import sentencepiece_model_pb2
    read = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as f:
        read.ParseFromString(f.read())
    how, trained = read.normalizer_spec, read.trainer_spec
    plain = (trained.model_type == _MERGE_TYPE and trained.byte_fallback and not trained.treat_whitespace_as_suffix
             and not how.precompiled_charsmap and how.add_dummy_prefix and not how.remove_extra_whitespaces
             and how.escape_whitespaces and not read.denormalizer_spec.precompiled_charsmap
             and all(p.type in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for p in read.pieces))
    if not plain:
        raise ValueError(f"{model}: not a merge-type model with byte fallback that keeps texts as they are")
    return Codec([(p.piece, p.score, p.type) for p in read.pieces], trained.unk_surface)


def _lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(b) // 4 for b in packed]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _added(df: DataFrame, fields: Sequence[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, kind) for n, kind in fields]])


def _encode_run(at: int, names: list[str], model: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in in_slices(batches, at, SLICE_BYTES):
            packed = own.encode_batch([t or "" for t in batch.column(at).to_pylist()])
            made = [_lists(packed)]
            if len(names) > 1:
                made.append(pa.array([own.decode(memoryview(b).cast("I")) for b in packed], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])
    return run


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str | None = None) -> DataFrame:
    """``docs`` with the list of piece ids of ``text``.  No shuffle."""
    ready_for_python(docs)
    name = free_name(docs.columns, ids)
    return docs.mapInArrow(_encode_run(docs.columns.index(text), [name], model or default_model()),
                           _added(docs, [(name, T.ArrayType(T.IntegerType()))]))


def round_trip(docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded",
               model: str | None = None) -> DataFrame:
    """As ``encode``, with the text that the ids decode to, in the same pass."""
    ready_for_python(docs)
    names = [free_name(docs.columns, ids), free_name([*docs.columns, ids], decoded)]
    return docs.mapInArrow(_encode_run(docs.columns.index(text), names, model or default_model()),
                           _added(docs, [(names[0], T.ArrayType(T.IntegerType())), (names[1], T.StringType())]))


def decode(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded", model: str | None = None) -> DataFrame:
    """``encoded`` with the text of its list of ids; NULL ids stay NULL."""
    ready_for_python(encoded)
    model, at, name = model or default_model(), encoded.columns.index(ids), free_name(encoded.columns, decoded)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            made = [None if i is None else own.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, name])

    return encoded.mapInArrow(run, _added(encoded, [(name, T.StringType())]))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by a full round trip."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return round_trip(rows, model=model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
