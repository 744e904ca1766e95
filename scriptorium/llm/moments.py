"""Sums over all rows of a table of vectors, worked out in tasks and added up in two levels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of tasks whose sums meet before the driver adds the groups'.
GROUPS = 32


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Lists of one length, without nulls, as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def finite(embedding: Column, most: float = float("inf")) -> Column:
    """Whether a vector has components, all of them numbers below most in absolute value."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < most)
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, good), F.lit(False))


def summed(rows: DataFrame, column: str, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of part(matrix of some rows), of this shape, over all rows; tasks' sums are added in the order of the tasks."""
    size = int(np.prod(shape))

    def run(batches):
        total = np.zeros(shape)
        for b in batches:
            if len(b):
                total += part(matrix(b.column(0)))
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["task", "total"])

    def add(some: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for blob in some.sort_values("task")["total"]:
            total += np.frombuffer(blob)
        return pd.DataFrame({"task": [int(some["task"].min())], "total": [total.tobytes()]})

    sums = rows.select(column).mapInArrow(run, "task long, total binary").groupBy(F.pmod("task", F.lit(GROUPS))).applyInPandas(add, "task long, total binary")
    out = np.zeros(size)
    for r in sorted(sums.collect()):
        out += np.frombuffer(r["total"])
    return out.reshape(shape)
