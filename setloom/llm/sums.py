"""Sums of fixed-size arrays over partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FAN = 8


def partition_sum(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray | None:
    """Add what ``partial`` gives for each partition: arrays of one shape that does not grow with the data.

    Partitions are added in a tree of fan ``FAN``, so the driver adds at most that many arrays. None without partitions.
    """
    def first(batches):
        total = np.ascontiguousarray(partial(batches), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.large_binary()).cast(pa.binary()),
                                          pa.array([list(total.shape)], pa.list_(pa.int64()))], names=["total", "shape"])

    def add(batches):
        total, shape = None, None
        for batch in batches:
            for raw, size in zip(batch.column(0), batch.column(1), strict=True):
                part = np.frombuffer(raw.as_py(), np.float64)
                total, shape = (part.copy() if total is None else total + part), size.as_py()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()),
                                              pa.array([shape], pa.list_(pa.int64()))], names=["total", "shape"])

    schema = "total binary, shape array<bigint>"
    parts = df.rdd.getNumPartitions()
    sums = df.mapInArrow(first, schema)
    while parts > FAN:
        parts = -(-parts // FAN)
        sums = sums.repartition(parts).mapInArrow(add, schema)
    found = [np.frombuffer(r[0], np.float64).reshape(r[1]) for r in sums.collect()]
    return sum(found[1:], found[0].copy()) if found else None
