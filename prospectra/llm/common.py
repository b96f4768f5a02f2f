"""What several operators of this subpackage share.

Words are maximal runs of anything but space, tab, line feed, vertical tab,
form feed and carriage return.  ``bytes.split()`` splits at exactly these six
and ``bytes.lower()`` changes A-Z only, so word work is done on UTF-8 bytes.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side may be broadcast up to so many rows; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
SLICE_BYTES = 2 << 20
# Texts that Arrow carries to or from Python at once.
BATCH_ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_remainder(name: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; a NULL counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def small_or_plain(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side``, a written table, hinted for broadcast where its counted rows allow it."""
    return F.broadcast(side) if side.count() <= rows else side


_shipped: set[str] = set()


def ready_for_python(df: DataFrame, rows: int = BATCH_ROWS) -> None:
    """Set the session up for operators that hand texts to Python.

    The package is sent to the workers, once per application, so that they can
    import it wherever the session was started.  The session's Arrow batches
    are lowered to ``rows`` rows, where they are larger: a batch of texts lies
    in memory several times, on both sides of the pipe to Python, and at the
    default of 10,000 rows that is hundreds of MB per task.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).parent.parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def in_slices(batches: Iterable[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts come to about ``size`` bytes; one row at least.

    Python objects made of a slice live as long as the slice, so a worker's
    memory is bounded by a few slices and the longest text.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        number = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def in_runs(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches put together to about ``rows`` rows each; for narrow rows only."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def row_keys() -> Iterator[int]:
    """Numbers that no other task gives out: the partition's number, then a running number.

    A retried task may number its rows anew, so the rows must be written to a
    table before anything is joined by these keys.
    """
    at = TaskContext.get().partitionId() << 34
    while True:
        yield at
        at += 1


def free_name(taken: Sequence[str], name: str) -> str:
    """``name``, with underscores in front until no given column has it."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name
