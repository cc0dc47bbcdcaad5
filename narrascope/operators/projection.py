"""Principal components of vectors from one pass over them.

Each task adds its vectors up to a count, a mean and a matrix of centred products; such moments merge, so tables of any size
come down to one matrix of width by width on the driver, where its eigenvectors are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.functions.similarity import dot
from narrascope.session import share_code

#: Tasks whose moments are merged in one step.
FAN_IN = 32
_MOMENTS = "n long, mean binary, products binary"


@dataclass
class Components:
    """The vectors' mean, the components (one in a row, the largest first) and the variance along each."""

    mean: np.ndarray
    axes: np.ndarray
    variance: np.ndarray


def _merged(a: tuple, b: tuple) -> tuple:
    """The moments of both together."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _row(m: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m[0]], pa.int64()), pa.array([m[1].tobytes()], pa.binary()), pa.array([m[2].tobytes()], pa.binary())], ["n", "mean", "products"])


def _moments_of(n: int, mean: bytes, products: bytes) -> tuple:
    mean = np.frombuffer(mean)
    return n, mean, np.frombuffer(products).reshape(len(mean), -1)


def moments(rows: DataFrame, vector: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """(count, mean, centred products) of the vectors; null vectors and those with a null or non-finite component are left out."""
    share_code(rows.sparkSession)
    wide = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = rows.select(wide.alias("v")).where("v is not null").where(~F.exists("v", bad))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (0, None, None)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                mean = x.mean(axis=0)
                total = _merged(total, (len(x), mean, (x - mean).T @ (x - mean)))
        if total[0]:
            yield _row(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (0, None, None)
        for batch in batches:
            for row in batch.to_pylist():
                total = _merged(total, _moments_of(row["n"], row["mean"], row["products"]))
        if total[0]:
            yield _row(total)

    parts = good.mapInArrow(gather, _MOMENTS)
    tasks = good.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(merge, _MOMENTS)
    total = (0, np.zeros(0), np.zeros((0, 0)))
    for r in parts.collect():  # FAN_IN at most
        total = _merged(total, _moments_of(r.n, r.mean, r.products))
    return total


def components(rows: DataFrame, vector: str = "embedding", k: int = 2) -> Components:
    """The first ``k`` principal components; of each the entry of the largest size, the first of equals, is positive."""
    n, mean, products = moments(rows, vector)
    values, axes = np.linalg.eigh(products / max(n, 1)) if n else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[:k]
    axes = axes.T[order]
    signs = [1.0 if a[np.argmax(np.abs(a))] >= 0 else -1.0 for a in axes]
    return Components(mean, axes * np.array(signs).reshape(-1, 1), values[order])


def project(rows: DataFrame, found: Components, names: tuple[str, ...] = ("x", "y"), vector: str = "embedding") -> DataFrame:
    """With a column for each component; null for a vector that is or holds a null."""
    out = {}
    for name, axis in zip(names, found.axes):
        weights = F.array(*[F.lit(float(a)) for a in axis])
        out[name] = dot(F.col(vector), weights) - F.lit(float(found.mean @ axis))
    return rows.withColumns(out)
