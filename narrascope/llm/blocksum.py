"""Sums of fixed-size arrays that tasks have counted, block by block, without collecting any group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells in one block.
CELLS = 16384
#: Tasks whose rows are summed in one step.
FAN_IN = 64
SCHEMA = "block int, cells binary"


def to_rows(counts: np.ndarray):
    """(block numbers, little-endian bytes) of the blocks that are not all zero."""
    pad = -len(counts) % CELLS
    table = np.concatenate([counts, np.zeros(pad, counts.dtype)]).reshape(-1, CELLS)
    used = np.flatnonzero(table.any(axis=1))
    return used.astype(np.int32), [table[k].tobytes() for k in used]


def summed(df: DataFrame, size: int, dtype) -> np.ndarray:
    """The sum over all rows of ``df`` (block, cells) as one array of ``size`` cells on the driver.
    Rows are dealt by block; each task adds what it reads batch by batch, so it holds one copy of its blocks
    however many tasks have counted.  Beyond ``FAN_IN`` tasks their rows are summed in groups of about as many first, so
    that no task reads what all have written.  The result's size is fixed by ``size``.
    """
    dtype = np.dtype(dtype)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(cells.as_buffer(), dtype)
                if k in total:
                    total[k] += x
                else:
                    total[k] = x.copy()
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "cells"]
            )

    out = np.zeros(-(-size // CELLS) * CELLS, dtype)
    parts = max(1, min(16, -(-size // (4 * CELLS))))
    rows = df.select("block", "cells")
    groups = rows.rdd.getNumPartitions() // FAN_IN
    if groups > 1:
        rows = rows.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(groups))).repartition(parts * groups, "block", "group").mapInArrow(add, SCHEMA)
    for row in rows.repartition(parts, "block").mapInArrow(add, SCHEMA).collect():
        cells = np.frombuffer(row.cells, dtype)
        out[row.block * CELLS : row.block * CELLS + len(cells)] += cells
    return out[:size]
