"""Sums over all rows of a table, for models that are fitted in rounds to the whole of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tasks of a round, at most; a sum for each reaches the driver, so that this doesn't grow with the table.
TASKS = 64


def in_few(frame: DataFrame) -> DataFrame:
    """The frame in no more partitions than there are cores, or TASKS."""
    return frame.coalesce(min(TASKS, frame.sparkSession.sparkContext.defaultParallelism))


def summed(frame: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of what `part` gives for each batch of the rows, an array of so many doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(batch).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return sum((np.frombuffer(r["total"]) for r in frame.mapInArrow(run, "total binary").collect()), np.zeros(size))


def numbers(column: pa.Array, kind) -> np.ndarray:
    """The numbers that the binary values of a column hold, one after another."""
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, kind)
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind)
