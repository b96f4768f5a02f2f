"""Quality rules: repetition inside a document, and lines that many documents of a host share.

One Python pass measures each text and hashes its normalised lines.  The rest
is joins and counts: a line that more distinct documents of one host hold than
the host's limit allows is removed, and a document is rejected when too few of
its words are left.

Copies must not make each other's lines look like page furniture, so documents
that agree in the set of all their normalised lines count once; pages that
share some lines and differ in any other are documents of their own.

A host's limit follows its size between two absolute numbers, so that a line of
a few pages never goes and a line of very many always does, however big the host.

Defined results: a NULL text has no words (so it fails the base rule); NULL
hosts form one host of their own; repeated rows are measured row by row and
count once; an empty table gives an empty table.  Input columns other than the
three named ones are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra.llm.common import free_name, in_slices, ready_for_python, row_keys, small_or_plain
from prospectra.session import write_and_read_back

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
# A line is removed in a host beyond this many documents and this share of the host's documents,
# and beyond ``MOST_DOCS`` documents whatever the share.
LIMIT_DOCS = 20
LIMIT_PERCENT = 5
MOST_DOCS = 1000
# A document is depleted when less than this share of its words is left.
LEAST_LEFT_PERCENT = 30

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SEPARATORS = " \t\n\x0b\x0c\r"

_MEASURES = ("row_key long, doc_id long, host long, text_hash_a long, text_hash_b long, n_words long, word_chars long, "
             "n_symbols long, n_dup_lines long, n_repeat_words long, "
             "page long, lines array<struct<line: long, words: int>>")


_ARROW = pa.schema([
    *[(n, pa.int64()) for n in ("row_key", "doc_id", "host", "text_hash_a", "text_hash_b", "n_words", "word_chars",
                                "n_symbols", "n_dup_lines", "n_repeat_words", "page")],
    ("lines", pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())])))])


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _hash(data: bytes, seed: int = 0) -> int:
    return _signed(xxhash.xxh64_intdigest(data, seed))


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur twice or more."""
    windows = list(zip(*[words[i:] for i in range(WINDOW)]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    covered = upto = 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return covered


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_SEPARATORS)]
    return len(lines) - len(set(lines))


def _line_entries(data: bytes, host: bytes) -> tuple[int, list[dict]]:
    """The hash of the text's set of normalised lines, and one entry per such line: its hash
    within the host and its words over all places."""
    words: dict[bytes, int] = {}
    for raw in data.lower().split(b"\n"):
        parts = raw.split()
        if parts:
            line = b" ".join(parts)
            words[line] = words.get(line, 0) + len(parts)
    entries = [{"line": _hash(host + b"\0" + line), "words": n} for line, n in words.items()]
    return _hash(b"\n".join(sorted(words))), entries


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = row_keys()
    for batch in in_slices(batches, 1):
        rows = []
        for doc_id, text, source in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or ""
            data = text.encode("utf-8", "surrogatepass")
            host = b"-" if source is None else b"+" + source.encode("utf-8", "surrogatepass")
            words = data.split()
            page, lines = _line_entries(data, host)
            rows.append({
                "row_key": next(keys), "doc_id": doc_id, "host": _hash(host),
                "text_hash_a": _hash(data), "text_hash_b": _hash(data, 1), "n_words": len(words),
                "word_chars": len(text) - sum(text.count(c) for c in _SEPARATORS),
                "n_symbols": len(_SYMBOLS.findall(text)), "n_dup_lines": duplicate_lines(text),
                "n_repeat_words": repeated_words(words), "page": page, "lines": lines})
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """A written table of one row per document: counts, text hashes and line entries."""
    ready_for_python(docs)
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"), F.col(host).cast("string"))
    return write_and_read_back(rows.mapInArrow(_measure, _MEASURES), "quality-measures")


def frequent_lines(measures: DataFrame, limit_docs: int = LIMIT_DOCS, limit_percent: int = LIMIT_PERCENT,
                   most_docs: int = MOST_DOCS) -> DataFrame:
    """A written table (host, line, documents) of the lines above their host's limit.

    Documents with the same set of lines count once, for a line and for the
    host's size.  The pairs are made distinct by (line, set) first, so a line
    that a third of all documents hold is spread over many tasks and counted
    map-side.  Counts are written before they meet the hosts' sizes, so that a
    host with very many lines is split.
    """
    sizes = write_and_read_back(measures.groupBy("host", "page").agg(F.lit(1).alias("one"))
                                .groupBy("host").agg(F.count("*").alias("host_docs")), "host-sizes")
    entries = measures.select("host", "page", F.explode("lines").alias("l")).select("host", "page", "l.line")
    found = write_and_read_back(
        entries.groupBy("host", "line", "page").agg(F.lit(1).alias("one"))
        .groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > limit_docs), "line-counts")
    beyond = (F.col("documents") * 100 > F.col("host_docs") * limit_percent) | (F.col("documents") > most_docs)
    above = found.join(small_or_plain(sizes), "host").where(beyond)
    return write_and_read_back(above.select("host", "line", "documents"), "frequent-lines")


def judge(measures: DataFrame, frequent: DataFrame, least_left_percent: int = LEAST_LEFT_PERCENT) -> DataFrame:
    """``measures`` without the lines, with ``removed_words``, ``base_failed`` and ``kept``.

    The removed words are written before they are joined back, so both joins
    read plain tables and adaptive execution can split a hot line or host.
    """
    lines = measures.select("row_key", "host", F.explode("lines").alias("l")).select("row_key", "host", "l.line", "l.words")
    hits = lines.join(small_or_plain(frequent.select("host", "line")), ["host", "line"])
    removed = write_and_read_back(hits.groupBy("row_key").agg(F.sum("words").alias("removed_words")), "removed-words")
    gone = F.coalesce(F.col("removed_words"), F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - gone) < least_left_percent * F.col("n_words")
    return (measures.drop("page", "lines").join(removed, "row_key", "left")
            .select("*", gone.alias("_gone"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))
            .drop("removed_words").withColumnRenamed("_gone", "removed_words"))


def apply_rules(docs: DataFrame, **columns: str) -> DataFrame:
    measures = measure(docs, **columns)
    return judge(measures, frequent_lines(measures))


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    A verdict depends on host and text alone, so rejected rows are taken out by
    the hashes of both; rows are never matched by an id that may repeat.
    """
    verdicts = apply_rules(docs, doc_id=doc_id, text=text, host=host)
    gone = write_and_read_back(verdicts.where(~F.col("kept")).select("host", "text_hash_a", "text_hash_b").distinct(),
                               "rejected-texts")
    names = [free_name(docs.columns, f"rule_key_{i}") for i in range(3)]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])
    keyed = docs.mapInArrow(_with_keys(docs.columns.index(text), docs.columns.index(host), names), schema)
    gone = small_or_plain(gone).toDF(*names)
    return keyed.join(gone, names, "left_anti").drop(*names)


def _with_keys(text_at: int, host_at: int, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, text_at):
            keys = []
            for text, host in zip(batch.column(text_at).to_pylist(), batch.column(host_at).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                source = b"-" if host is None else b"+" + host.encode("utf-8", "surrogatepass")
                keys.append((_hash(source), _hash(data), _hash(data, 1)))
            columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])
    return run
