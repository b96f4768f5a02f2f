"""Second-order fit of the penalised logistic regression.

One pass over the rows gives the loss, its gradient and its matrix of second
derivatives at the current weights: every Arrow batch adds its weighted matrix
product, tasks are merged in groups and the groups on the driver.  Newton steps
follow, halved where the loss would rise.  Some ten passes reach the optimum to
rounding, so coefficients are the same however the rows are partitioned, and
raw values can be compared.

What a task sends is ``(slots + 1) ** 2`` numbers whatever its rows, and the
driver receives at most ``GROUPS`` of them.  Beyond ``MOST_SLOTS`` slots that
matrix is no longer small: such a table is refused by name, and
``model.fit`` is the way for it, whose cost is linear in the slots.

Defined results: rows without weight count nothing; a table without rows of
both classes is refused, because its intercept has no finite optimum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = 32
MOST_SLOTS = 2_000
MOST_PASSES = 60
TOLERANCE = 1e-9


class Fitted(NamedTuple):
    """Weights per slot, the intercept, the loss at each accepted step and the largest gradient left."""
    weights: np.ndarray
    intercept: float
    losses: list[float]
    gradient: float


def _second_order(theta: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's (rows of class 1, rows of class 0, loss, gradient, second derivatives) as one list."""
    d = len(theta)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, loss, gradient, second = np.zeros(2), 0.0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if not batch.num_rows:
                continue
            y, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = np.ones((batch.num_rows, d))
            x[:, :-1] = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d - 1)
            margin = x @ theta
            p = 0.5 * (1 + np.tanh(margin / 2))
            loss += float(weight @ (np.logaddexp(0, margin) - y * margin))
            gradient += x.T @ (weight * (p - y))
            second += (x * (weight * p * (1 - p))[:, None]).T @ x
            classes += weight @ (y > 0), weight @ (y <= 0)
        parts = np.concatenate([classes, [loss], gradient, second.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([parts], pa.list_(pa.float64()))],
            ["task", "parts"])
    return run


def _merge() -> Callable[[pa.Table], pa.Table]:
    """One group's sum, in the order of tasks, so that a retry adds up alike."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        total = 0.0
        for part in table.column("parts").to_pylist():
            total = total + np.asarray(part)
        return pa.table({"task": table.column("task")[:1], "parts": pa.array([total], pa.list_(pa.float64()))})
    return run


def _at(rows: DataFrame, theta: np.ndarray, penalty: float) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    d = len(theta)
    sums = rows.mapInArrow(_second_order(theta), "task int, parts array<double>")
    merged = sums.groupBy(F.col("task") % GROUPS).applyInArrow(_merge(), sums.schema).collect()
    total = np.zeros(3 + d + d * d)
    for r in sorted(merged, key=lambda r: r["task"]):
        total += r["parts"]
    shrink = np.r_[np.full(d - 1, penalty), 0.0]
    return (total[:2], float(total[2] + 0.5 * shrink @ theta ** 2), total[3:3 + d] + shrink * theta,
            total[3 + d:].reshape(d, d) + np.diag(shrink))


def fit(vectors: DataFrame, label: str, weight: str, features: str, penalty: float = 1.0) -> Fitted:
    """Minimise the summed weighted loss plus ``penalty / 2`` times the squared weights, without the intercept.

    ``vectors`` is read once per pass and should be stored.
    """
    rows = vectors.select(F.col(label).cast("double"), F.col(weight).cast("double"), vector_to_array(features))
    first = vectors.select(F.size(vector_to_array(features))).first()
    if first is None:
        raise ValueError("both classes are needed, there are no rows")
    if first[0] > MOST_SLOTS:
        raise ValueError(f"{first[0]} slots; the second-order fit takes {MOST_SLOTS}, use model.fit")
    theta = step = np.zeros(first[0] + 1)
    losses: list[float] = []
    for _ in range(MOST_PASSES):
        classes, loss, gradient, second = _at(rows, theta, penalty)
        if not classes.all():
            raise ValueError("both classes are needed")
        if losses and loss > losses[-1] * (1 + 1e-12):
            step = step / 2
            theta = theta - step
            continue
        losses.append(loss)
        left = float(np.abs(gradient).max())
        if left <= TOLERANCE * max(1.0, classes.sum()):
            return Fitted(theta[:-1], float(theta[-1]), losses, left)
        # Least squares, as columns that repeat the intercept leave the matrix without an inverse.
        step = -np.linalg.lstsq(second, gradient, rcond=None)[0]
        theta = theta + step
    raise RuntimeError(f"no optimum after {MOST_PASSES} passes")
