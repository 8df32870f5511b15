"""Sums of vectors and matrices over partitions.

Each partition adds up its own rows and returns one matrix; ``TASKS`` tasks add up these, one matrix
in memory each, and the driver adds up what they return: so many matrices, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TASKS = 4


def partition_sums(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``part(batch)``, a matrix of ``shape``, over all batches of ``df``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                value = part(batch)
                total = value if total is None else total + value
        if total is not None:
            yield as_rows(total)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(shape), False
        for batch in batches:
            if batch.num_rows:
                np.add.at(total, batch.column(0).to_numpy(), matrix(batch.column(1), shape[1]))
                seen = True
        if seen:
            yield as_rows(total)

    def as_rows(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"i": pa.array(range(shape[0]), pa.int32()), "v": pa.array(list(total), pa.list_(pa.float64()))})

    schema = "i int, v array<double>"
    summed = df.mapInArrow(add, schema).repartition(TASKS).mapInArrow(gather, schema)
    out = np.zeros(shape)
    for row in summed.collect():  # at most TASKS matrices
        out[row["i"]] += row["v"]
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An array column of equal lengths as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, float).reshape(-1, width)
