"""Fixed-size numeric tables summed over all partitions: counts, sketches, bitmaps.

A task emits its table as a fixed number of compressed blocks; blocks are reduced on the executors in two
levels, as a stream, so a task holds one table whatever the number of partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK_SCHEMA = "block int, salt int, data binary"


def row(block: int, values: np.ndarray) -> pa.RecordBatch:
    """One block of this task's table."""
    context = TaskContext.get()
    salt = context.partitionId() % 16 if context else 0
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(values.tobytes(), 1)], pa.binary())], ["block", "salt", "data"])


def _sum_blocks(dtype, op):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(2)):
                part = np.frombuffer(zlib.decompress(blob.as_buffer()), dtype=dtype)
                if block in sums:
                    op(sums[block], part, out=sums[block])
                else:
                    sums[block] = part.copy()
        for block, part in sums.items():
            yield row(block, part)

    return run


def reduce_blocks(parts: DataFrame, dtype, op) -> dict[int, np.ndarray]:
    """Blocks of fixed number and size, reduced on the executors in two levels; the driver gets one of each."""
    merge = _sum_blocks(dtype, op)
    rows = parts.repartition("block", "salt").mapInArrow(merge, BLOCK_SCHEMA).repartition("block").mapInArrow(merge, BLOCK_SCHEMA).collect()
    return {r["block"]: np.frombuffer(zlib.decompress(r["data"]), dtype=dtype) for r in rows}
