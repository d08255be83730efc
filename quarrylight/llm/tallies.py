"""Sums of one long integer vector over all tasks: each task sends its own, cut into blocks; a block is summed as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylight.llm.words import tidy

KIND = "block int, counts binary"
#: Blocks that a vector is cut into: their sums are spread over as many tasks.
BLOCKS = 128


def sent(tally: np.ndarray) -> pa.RecordBatch:
    """A task's vector as rows of KIND; blocks of zeros stay out."""
    step = max(1, -(-len(tally) // BLOCKS))
    parts = [(k, tally[k * step : (k + 1) * step].astype("<i8")) for k in range(-(-len(tally) // step))]
    parts = [(k, p.tobytes()) for k, p in parts if p.any()]
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["block", "counts"]
    )


def total(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of what `sent` gave in all tasks, for vectors of `size` integers. The caller's parameters bound that size."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, "<i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"]
        )

    step = max(1, -(-size // BLOCKS))
    out = np.zeros(size, np.int64)
    for row in rows.repartition("block").mapInArrow(tidy(summed), KIND).collect():  # one row a block
        out[row["block"] * step : (row["block"] + 1) * step] += np.frombuffer(row["counts"], "<i8")
    return out
