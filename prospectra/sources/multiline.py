"""CSV records with line breaks inside quotes, cut by many tasks.

A line break ends a record only outside quotes, and whether a place is inside
quotes depends on all quotes before it.  Reading such files as one stream costs
one task per file.  Here they are read as text lines in splits, twice:

1. Quotes are counted per line and split.  The splits' parities, one row each,
   run up in file order and say whether a split starts inside quotes.
2. Each split closes its records where the running parity is even.  What
   belongs to a record begun in another split, and a last record that is still
   open, are set aside: two pieces per split at most, which are put together in
   a small shuffle.  All other records stay where they were read.

A quote counts wherever it stands, so files must be well formed: a field that
holds a quote, a separator or a line break is quoted, its quotes are doubled.
A line ends with a line feed.  Where a file's first line ends with CR LF, CR LF
is its line end and reads as a line feed, inside quotes too, as in Spark's own
reader; elsewhere a carriage return belongs to the value.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospectra.session import write_and_read_back

# Splits whose table may be broadcast, some 50 bytes each; beyond, lines move to their split's row.
BROADCAST_SPLITS = 1_000_000
# What a piece of text is: a record, the begin of one, the middle of one, the end of one.
_WHOLE, _BEGIN, _MIDDLE, _END = range(4)

_PIECES = "file long, split long, kind int, first boolean, text string"
_PIECES_ARROW = pa.schema([("file", pa.int64()), ("split", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()),
                           ("text", pa.string())])


def _lines(spark: SparkSession, path: str | list[str], quote: str) -> DataFrame:
    """(file, split, at, odd, value): the lines, in order inside a task, and whether each has an odd number of quotes."""
    text = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote), F.lit("")))
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                       F.monotonically_increasing_id().alias("at"), (quotes % 2 == 1).alias("odd"), "value")


def split_table(lines: DataFrame) -> DataFrame:
    """A written table of one row per split: whether it starts inside quotes, and whether its file's lines end with CR LF."""
    counted = lines.groupBy("file", "split").agg(
        F.count_if("odd").alias("quotes"), F.min_by(F.col("value").endswith("\r"), "at").alias("_cr"))
    in_file = Window.partitionBy("file").orderBy("split")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    return write_and_read_back(counted.select(
        "file", "split", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        F.first("_cr").over(in_file).alias("cr")), "csv-splits")


class _Split:
    """One split's lines, put together to records as they come."""

    def __init__(self, key: tuple[int, int], inside: bool) -> None:
        self.key, self.parity, self.foreign = key, int(inside), inside
        self.first = key[1] == 0
        self.pending: list[str] = []

    def feed(self, lines: pa.Array, odd: np.ndarray) -> Iterator[pa.RecordBatch]:
        after = (np.cumsum(odd) + self.parity) & 1
        self.parity = int(after[-1])
        closed = np.flatnonzero(after == 0)
        if not len(closed):
            self.pending += lines.to_pylist()
            return
        ends = np.concatenate([[0], closed + 1])
        records = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines.slice(0, int(ends[-1]))), "\n")
        kinds = np.full(len(closed), _WHOLE, np.int32)
        if self.pending or self.foreign:
            # The first one was begun before.
            if self.pending:
                records = pa.concat_arrays([pa.array(["\n".join([*self.pending, records[0].as_py()])]), records[1:]])
            kinds[0] = _END if self.foreign else _WHOLE
        yield self._batch(kinds, records)
        self.pending, self.foreign = lines[int(ends[-1]):].to_pylist(), False

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.pending:
            yield self._batch(np.array([_MIDDLE if self.foreign else _BEGIN], np.int32), pa.array(["\n".join(self.pending)]))

    def _batch(self, kinds: np.ndarray, records: pa.Array) -> pa.RecordBatch:
        n = len(records)
        first = np.zeros(n, bool)
        first[0], self.first = self.first, False
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, self.key[0])), pa.array(np.full(n, self.key[1])), pa.array(kinds),
                                           pa.array(first), records], schema=_PIECES_ARROW)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current = None
    for batch in batches:
        file, split = (batch.column(i).to_numpy() for i in (0, 1))
        inside, odd = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        if not len(file):
            continue
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(split) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)]):
            key = (int(file[a]), int(split[a]))
            if current is None or key != current.key:
                if current is not None:
                    yield from current.close()
                current = _Split(key, bool(inside[a]))
            yield from current.feed(batch.column(4).slice(a, b - a), odd[a:b])
    if current is not None:
        yield from current.close()


def records(spark: SparkSession, path: str | list[str], quote: str = '"', broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """(record, first): every non-empty record of the files as text, and whether it is its file's first."""
    lines = _lines(spark, path, quote)
    splits = split_table(lines)
    known = splits.select(F.col("file").alias("_file"), F.col("split").alias("_split"), "inside")
    few = splits.count() <= broadcast_splits
    met = lines.join(F.broadcast(known) if few else known, (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split")), "left")
    if not few:
        met = met.repartition("file", "split").sortWithinPartitions("file", "split", "at")
    inside = F.coalesce("inside", F.raise_error(F.lit("the files or their splits changed while they were read")).cast("boolean"))
    # Pieces at the borders are written once; they and the whole records come from one more pass.
    pieces = met.select("file", "split", inside.alias("inside"), "odd", "value").mapInArrow(_cut, _PIECES)
    borders = write_and_read_back(pieces.where(F.col("kind") != _WHOLE), "csv-borders")
    ends_with_cr = splits.groupBy("file").agg(F.first("cr").alias("cr"))
    in_order = Window.partitionBy("file").orderBy("split", (F.col("kind") == _BEGIN).cast("int"))
    joined = (borders.withColumn("chain", F.count_if(F.col("kind") == _BEGIN).over(in_order))
              .groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("split", "text"))).alias("parts"),
                                            F.max("first").alias("first"))
              .select("file", "first", F.array_join(F.col("parts.text"), "\n").alias("text")))
    every = pieces.where(F.col("kind") == _WHOLE).select("file", "first", "text").unionByName(joined)
    # One row per file; files are few beside their lines, and a plain join moves only their records.
    cut = every.join(F.broadcast(ends_with_cr) if few else ends_with_cr, "file")
    plain = F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n"))
    plain = F.when(plain.endswith("\r"), F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(plain)
    record = F.when(F.col("cr"), plain).otherwise(F.col("text"))
    return cut.select(record.alias("record"), "first").where("record <> ''")
