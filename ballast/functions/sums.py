"""Sums of arrays over a whole table, for models whose fit is one aggregation a round."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK = 8192  # numbers sent as one value
FAN_IN = 64   # arrays added by one task of the tree
LAST = 8      # arrays of a key that the driver adds


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part")  # one order of the additions, so that a retried task gives the same bits
    total = np.sum([np.frombuffer(b, dtype=np.float64) for b in pdf["sums"]], axis=0)
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "block": [pdf["block"].iloc[0]],
                         "part": [pdf["part"].iloc[0] // FAN_IN], "sums": [total.tobytes()]})


def array_sums(data: DataFrame, fold: Callable[[Iterable[pa.RecordBatch]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The sum over all tasks of the arrays that ``fold`` makes of a task's batches, by their key.

    A task sends each array once, cut into blocks; blocks are added in a tree of tasks that take
    ``FAN_IN`` each.  The driver receives at most ``LAST`` arrays a key, whatever the number of
    partitions.  A key that no task names is missing from the result.
    """
    schema = "key INT, block INT, part INT, sums BINARY"

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for key, a in fold(batches).items():
            for lo in range(0, len(a), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([lo // BLOCK], pa.int32()), pa.array([part], pa.int32()),
                                                  pa.array([a[lo:lo + BLOCK].tobytes()], pa.binary())], names=["key", "block", "part", "sums"])

    parts = data.rdd.getNumPartitions()
    sums = data.mapInArrow(task, schema)
    while parts > LAST:
        sums = sums.groupBy("key", "block", (sums["part"] / FAN_IN).cast("int").alias("lane")).applyInPandas(_added, schema)
        parts = -(-parts // FAN_IN)
    found: dict[int, dict[int, list]] = {}
    for r in sorted(sums.collect(), key=lambda r: (r["key"], r["block"], r["part"])):
        found.setdefault(r["key"], {}).setdefault(r["block"], []).append(np.frombuffer(r["sums"], dtype=np.float64))
    return {key: np.concatenate([np.sum(blocks[b], axis=0) for b in sorted(blocks)]) for key, blocks in found.items()}
