"""Token counts by section: whole texts are encoded once and tokens are joined to sections by their spans.

Encoding sections one by one would split tokens at every border and count too
many.  Here a document is encoded as a whole; the byte lengths of its tokens
give each one a span of characters; sections are intervals of the same
characters, and a sorted interval join gives each token its sections.  A token
that lies in several goes to one of them by an explicit rule:

- ``first``: the section of its first character,
- ``last``: the section of its last character,
- ``largest``: the section that holds most of its characters, the first of equals.

A token that is part of a character spans that character.  The counts of a
document's sections add up to its token count under any rule.

Defined results: a NULL or empty text is one empty section without tokens;
repeated rows are counted row by row; sections are numbered from 0 and cover
the text without gaps; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.llm.bpe import default_pattern, default_vocabulary
from prospectra.llm.common import in_slices, ready_for_python

RULES = ("first", "last", "largest")


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, pattern: str):
    """One per worker process: the encoder, and each id's length in bytes."""
    import tiktoken
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def line_ends(text: str) -> np.ndarray:
    """Sections are lines: the end of each, in characters, its line break included."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    return ends[:-1] if len(ends) > 1 and ends[-1] == ends[-2] else ends


def token_spans(text: str, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token, from the tokens' lengths in bytes."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    number = np.cumsum((data & 0xC0) != 0x80) - 1      # of the character that a byte is part of
    ends = np.cumsum(token_bytes)
    return number[ends - token_bytes], number[ends - 1] + 1


def attribute(starts: np.ndarray, stops: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Per section: tokens given to it, and how many of them cross a border.

    ``ends`` are the sorted section ends; the interval join is a binary search
    of both ends of each token's span.
    """
    first = np.searchsorted(ends, starts, side="right")
    last = np.searchsorted(ends, stops - 1, side="right")
    crossing = first != last
    chosen = last.copy() if rule == "last" else first.copy()
    if rule == "largest":
        begins = np.concatenate([[0], ends[:-1]])
        for i in np.flatnonzero(crossing):
            parts = np.arange(first[i], last[i] + 1)
            inside = np.minimum(ends[parts], stops[i]) - np.maximum(begins[parts], starts[i])
            chosen[i] = parts[np.argmax(inside)]
    n = len(ends)
    return np.bincount(chosen, minlength=n), np.bincount(chosen[crossing], minlength=n)


def count_by_section(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: str = "first",
                     sections: Callable[[str], np.ndarray] = line_ends, vocabulary: str | None = None,
                     pattern: str | None = None) -> DataFrame:
    """(doc_id, section, start_char, end_char, n_tokens, n_crossing), one row per section.  No shuffle."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ready_for_python(docs)
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    names = ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoder(vocabulary, pattern)
        for batch in in_slices(batches, 1):
            counts, parts = [], []
            for content in batch.column(1).to_pylist():
                content = content or ""
                ends = sections(content)
                ids = np.array(encoder.encode_ordinary(content), np.int64)
                starts, stops = token_spans(content, lengths[ids]) if len(ids) else (ids, ids)
                given, crossing = attribute(starts, stops, ends, rule)
                counts.append(len(ends))
                parts.append(np.stack([np.arange(len(ends)), np.concatenate([[0], ends[:-1]]), ends, given, crossing]))
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            table = np.concatenate([*parts, np.empty((5, 0), np.int64)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *map(pa.array, table.astype(np.int64))], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
