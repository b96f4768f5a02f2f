"""A decision tree with exact cuts, grown level by level from counts.

Every cut of every column is tried: no bins, no sample.  One pass per level
counts the rows of each class per (node, column, value) and stores the counts.
Tasks count column by column over runs of rows, so a value that occurs often
leaves a run as one row, and runs are combined before they move.  A number's cuts are the running totals of its values in
order, which ``ranks`` works out in buckets, so no task orders a whole column;
a level of a text column is a cut of its own (that level against the rest).
All that is compared between cuts is a function of whole-number counts, so the
tree does not depend on how rows are partitioned.  Of equal cuts the first
column, the smallest value and the first level win.

Only one row per open node reaches the driver.  The fitted tree is a small
table, and scoring with it is a nested built-in expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra import schema
from prospectra.functions.values import column, missing_to_zero, text_or_zero
from prospectra.operators.features import categorical_columns, numeric_columns, reject_untyped
from prospectra.operators.ranks import running_totals, stored

DEPTH = 5
LEAF_ROWS = 50
# Rows that a task counts at a time.
RUN_ROWS = 32_768
_COUNTS = "node long, pos int, value double, level string, n0 long, n1 long"


class Node(NamedTuple):
    """A node; its children, where it has a cut, are ``2 * node`` (left) and ``2 * node + 1``.

    Left are numbers up to ``threshold``, or rows without ``level``.
    """
    node: int
    depth: int
    rows: int
    positives: int
    weight: float
    impurity: float
    probability: float
    column_name: str | None = None
    level: str | None = None
    threshold: float | None = None
    gain: float | None = None


_SCHEMA = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("rows", T.LongType()),
    T.StructField("positives", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("impurity", T.DoubleType()),
    T.StructField("probability", T.DoubleType()), T.StructField("column_name", T.StringType()),
    T.StructField("level", T.StringType()), T.StructField("threshold", T.DoubleType()), T.StructField("gain", T.DoubleType())])


def _gini(a, b):
    """Impurity of two class weights; for columns and for numbers."""
    share_a, share_b = a / (a + b), b / (a + b)
    return 1.0 - share_a * share_a - share_b * share_b


def _node(number: int, depth: int, negatives: int, positives: int, weights: tuple[float, float]) -> Node:
    a, b = weights[0] * negatives, weights[1] * positives
    return Node(number, depth, negatives + positives, positives, a + b, _gini(a, b), b / (a + b))


def _count_cells(n_numeric: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of each class per (node, column, value) of a run of rows: a node, whether the class is 1, then the columns."""
    def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        run = pa.Table.from_batches(held).combine_chunks()
        nodes, at = np.unique(run.column(0).to_numpy(), return_inverse=True)
        is_one = run.column(1).fill_null(False).to_numpy()
        # A row without a class shows its value and counts for none.
        is_zero = ~is_one & run.column(1).is_valid().to_numpy()
        made = []
        for pos, cells in enumerate(run.columns[2:]):
            found = cells.combine_chunks().dictionary_encode()
            width = len(found.dictionary)
            cell = at * width + found.indices.to_numpy()
            seen = np.flatnonzero(np.bincount(cell))
            values, none = found.dictionary.take(pa.array(seen % width)), pa.nulls(len(seen))
            value, level = (values, none) if pos < n_numeric else (np.zeros(len(seen)), values)
            made.append(pa.RecordBatch.from_arrays(
                [pa.array(nodes[seen // width], pa.int64()), pa.array(np.full(len(seen), pos), pa.int32()), pa.array(value, pa.float64()),
                 level.cast(pa.string()), *(pa.array(np.bincount(cell[of], minlength=len(nodes) * width)[seen], pa.int64())
                                            for of in (is_zero, is_one))], ["node", "pos", "value", "level", "n0", "n1"]))
        return pa.concat_batches(made)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUN_ROWS:
                yield counted(held)
                held, rows = [], 0
        if rows:
            yield counted(held)
    return run


def value_counts(rows: DataFrame, n_numeric: int) -> DataFrame:
    """(node, pos, value, level, n0, n1) of rows of a node, whether the class is 1, the numbers, then the texts."""
    return (rows.mapInArrow(_count_cells(n_numeric), _COUNTS).groupBy("node", "pos", "value", "level")
            .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def fit(train: DataFrame, label: str = schema.LABEL, exclude: Sequence[str] = (schema.ID,), depth: int = DEPTH,
        leaf_rows: int = LEAF_ROWS) -> list[Node]:
    """The nodes of a tree of balanced class weights, in order of their numbers.

    ``train`` should be a stored table, since each level reads it once; its
    labels are 0 and 1.  A node is not cut if it is pure, at ``depth``, or has
    no cut that leaves ``leaf_rows`` rows on both sides; a cut that lowers no
    impurity is taken, since its children may have one that does.  Missing
    numbers count as 0, missing text as level '0'.
    """
    exclude = (*exclude, label)
    reject_untyped(train, exclude)
    numeric, text = numeric_columns(train, exclude), categorical_columns(train, exclude)
    names = [*numeric, *text]
    is_one = column(label) == 1
    total = train.agg(F.count_if(~is_one).alias("n0"), F.count_if(is_one).alias("n1")).first()
    if not total.n0 or not total.n1:
        raise ValueError(f"'{label}' has one class only")
    weights = tuple((total.n0 + total.n1) / (2 * n) for n in (total.n0, total.n1))
    nodes = {1: _node(1, 0, total.n0, total.n1, weights)}
    open_nodes = [1]
    cells = [f(column(c)).alias(f"c{i}") for i, (f, c) in enumerate(
        [*((missing_to_zero, c) for c in numeric), *((text_or_zero, c) for c in text)])]
    while open_nodes and names:
        place = place_of(nodes.values())
        rows = train.select(place.alias("node"), is_one.alias("y"), *cells).where(F.col("node").isin(open_nodes))
        counts = stored(value_counts(rows, len(numeric)))
        # At most one row per open node comes back.
        found = best_cuts(counts, len(numeric), [nodes[n] for n in open_nodes], weights, leaf_rows)
        open_nodes = []
        for cut in found:
            at = nodes[cut.node]
            nodes[at.node] = at._replace(column_name=names[cut.pos], level=cut.level, gain=cut.gain,
                                         threshold=None if cut.level is not None else _between(cut.value, cut.next_value))
            right = (at.rows - at.positives - cut.l0, at.positives - cut.l1)
            for number, negatives, positives in ((2 * at.node, cut.l0, cut.l1), (2 * at.node + 1, *right)):
                nodes[number] = child = _node(number, at.depth + 1, negatives, positives, weights)
                if child.depth < depth and 0 < positives < child.rows and child.rows >= 2 * leaf_rows:
                    open_nodes.append(number)
    return [nodes[n] for n in sorted(nodes)]


def _between(value: float, following: float) -> float:
    middle = (value + following) / 2
    return middle if middle < following else value


def best_cuts(counts: DataFrame, n_numeric: int, nodes: Sequence[Node], weights: tuple[float, float], leaf_rows: int) -> list:
    """(node, pos, value, next_value, level, gain, l0, l1) of the best cut of each node that has one."""
    totals = F.broadcast(counts.sparkSession.createDataFrame(
        [(n.node, n.rows - n.positives, n.positives, n.impurity) for n in nodes], "node long, t0 long, t1 long, impurity double"))
    numbers = counts.where(F.col("pos") < n_numeric)
    upto = running_totals(numbers.drop("level"), "value", ["n0", "n1"], ["node", "pos"])
    numeric_cuts = upto.select("node", "pos", "value", F.lit(None).cast("string").alias("level"),
                               F.col("upto_n0").alias("l0"), F.col("upto_n1").alias("l1")).join(totals, "node")
    # Without the level are the left rows.
    levels = counts.where(F.col("pos") >= n_numeric).join(totals, "node")
    level_cuts = levels.select("node", "pos", "value", "level", (F.col("t0") - F.col("n0")).alias("l0"),
                               (F.col("t1") - F.col("n1")).alias("l1"), "t0", "t1", "impurity")
    w0, w1 = map(F.lit, weights)
    left = (w0 * F.col("l0"), w1 * F.col("l1"))
    right = (w0 * (F.col("t0") - F.col("l0")), w1 * (F.col("t1") - F.col("l1")))
    weight = w0 * F.col("t0") + w1 * F.col("t1")
    gain = F.col("impurity") - (sum(left) / weight) * _gini(*left) - (sum(right) / weight) * _gini(*right)
    on_left, every = F.col("l0") + F.col("l1"), F.col("t0") + F.col("t1")
    best = (numeric_cuts.unionByName(level_cuts).where((on_left >= leaf_rows) & (every - on_left >= leaf_rows))
            .groupBy("node").agg(F.min(F.struct((-gain).alias("loss"), "pos", "value", "level", "l0", "l1")).alias("b"))
            .select("node", "b.*"))
    chosen = stored(best)
    # The next value in order: thresholds lie between the two.
    cut = F.broadcast(chosen.where("level is null").select("node", "pos", F.col("value").alias("_cut")))
    following = (numbers.join(cut, ["node", "pos"]).where(F.col("value") > F.col("_cut")).groupBy("node")
                 .agg(F.min("value").alias("next_value")))
    return (chosen.join(following, "node", "left").withColumn("gain", -F.col("loss")).orderBy("node")
            .select("node", "pos", "value", "next_value", "level", "gain", "l0", "l1").collect())


def _walk(nodes: dict[int, Node], number: int, end) -> Column:
    at = nodes[number]
    if at.column_name is None:
        return F.lit(end(at))
    value = column(at.column_name)
    goes_right = text_or_zero(value) == at.level if at.level is not None else missing_to_zero(value) > at.threshold
    return F.when(goes_right, _walk(nodes, 2 * number + 1, end)).otherwise(_walk(nodes, 2 * number, end))


def place_of(nodes) -> Column:
    """The number of the leaf that a row falls in."""
    return _walk({n.node: n for n in nodes}, 1, lambda n: n.node).cast("long")


def probability(nodes) -> Column:
    """The weighted share of class 1 in the row's leaf."""
    return _walk({n.node: n for n in nodes}, 1, lambda n: n.probability)


def node_table(spark: SparkSession, nodes: Sequence[Node]) -> DataFrame:
    """One row per node."""
    return spark.createDataFrame([tuple(n) for n in nodes], _SCHEMA)


def from_table(table: DataFrame) -> list[Node]:
    """The nodes of a stored node table; at most ``2 ** (depth + 1)`` rows."""
    return [Node(*r) for r in table.select(*_SCHEMA.names).orderBy("node").collect()]


def importances(table: DataFrame) -> DataFrame:
    """(feature, importance): each used slot's share of the impurity that all cuts take away, by weight."""
    feature = F.when(F.col("level").isNull(), F.col("column_name")).otherwise(F.concat_ws("_", "column_name", "level"))
    taken = (table.where(F.col("column_name").isNotNull()).groupBy(feature.alias("feature"))
             .agg(F.sum(F.col("weight") * F.col("gain")).alias("taken")))
    whole = F.sum("taken").over(Window.partitionBy())
    return taken.select("feature", F.when(whole > 0, F.col("taken") / whole).otherwise(F.lit(0.0)).alias("importance"))
