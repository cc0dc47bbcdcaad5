"""A softmax regressor of graded scores, trained by rounds over distributed rows.

Each row has features and the shares of the grades 1 to k (``similarity.soft_label``).  The model is one linear layer under a
softmax; its loss is the mean squared error of the shares, and a row's score is the mean grade under them.  A round sends
the weights out and adds the rows' gradients up, one array for each task; steps are Adam's, on the driver, where only
weights are.  After some rounds the held-out rows' rank correlation is taken; the best weights are kept, and training
ends after some rounds without a better one.

Features and weights are whole multiples of powers of two, as are the residuals, so all sums are exact and the model is
the same however the rows are partitioned.  Rows with null features or shares are left out, and nulls and
non-finite numbers among the features are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.operators.stats import correlations
from narrascope.session import Scratch, share_code
from narrascope.sources.checkpoints import Checkpoints

#: Steps of features (as parts of the largest), of weights and of residuals.
FEATURE, WEIGHT, RESIDUAL = 2.0**-12, 2.0**-16, 2.0**-20
#: Rows of one product; sums over them stay exact in doubles.
ROWS = 4096


@dataclass
class Regressor:
    """Weights (features and a constant by grades), the largest feature, and the best held-out correlation."""

    weights: np.ndarray
    largest: float
    best: float = -1.0
    step: int = 0


def _whole(values: np.ndarray, step: float) -> np.ndarray:
    return np.rint(values / step)


def _features(column: pa.Array, largest: float) -> np.ndarray:
    """Features and a constant as whole numbers."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)
    x = np.where(np.isfinite(x), x, 0.0) / largest
    return np.concatenate([_whole(x, FEATURE), np.full((len(x), 1), 1 / FEATURE)], axis=1)


def _shares(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    logits = (x @ _whole(weights, WEIGHT)) * (FEATURE * WEIGHT)
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _packed(rows: DataFrame, largest: float) -> DataFrame:
    """(x, y): features as whole numbers of two bytes and shares, ``ROWS`` rows at most in one; a round reads these."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _features(part.column(0), largest).astype(np.int16)
                y = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), float)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["x", "y"])

    return rows.select("features", "shares").mapInArrow(pack, "x binary, y binary")


def _gradient(rows: DataFrame, model: Regressor) -> np.ndarray:
    """The gradient of the mean squared error over packed rows: sums of whole numbers by cell."""
    weights = model.weights

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(weights.shape, object)
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column(0)[k].as_py(), np.int16).reshape(-1, weights.shape[0]).astype(float)
                y = np.frombuffer(batch.column(1)[k].as_py()).reshape(len(x), -1)
                p = _shares(x, weights)
                away = p - y
                back = _whole(p * (away - (away * p).sum(axis=1, keepdims=True)), RESIDUAL)
                total += (x.T @ back).astype(np.int64).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array([str(v) for v in total.ravel()])], ["cell", "sum"])

    sums = rows.mapInArrow(add, "cell int, sum string")
    out = np.zeros(weights.size)
    for cell, value in sums.groupBy("cell").agg(F.sum(F.col("sum").cast("decimal(38,0)"))).collect():  # one row for each weight
        out[cell] = float(value) * (FEATURE * RESIDUAL)
    return out.reshape(weights.shape)


def predict(rows: DataFrame, model: Regressor, features: str = "features", out: str = "expected") -> DataFrame:
    """With ``out``: each row's mean grade; null where the features are."""
    share_code(rows.sparkSession)
    weights, largest = model.weights, model.largest
    grades = np.arange(1, weights.shape[1] + 1)

    @F.pandas_udf("double")
    def score(columns: pd.Series) -> pd.Series:
        known = columns.notna().to_numpy()
        got = np.full(len(columns), np.nan)
        if known.any():
            held = pa.array([np.asarray(v, float) for v in columns[known]], pa.list_(pa.float64()))
            got[known] = _shares(_features(held, largest), weights) @ grades
        return pd.Series(got).where(known, None)

    return rows.withColumn(out, score(F.col(features).cast("array<double>")))


def fit(train: DataFrame, dev: DataFrame, score: str = "score", each: int = 50, most: int = 1000, patience: int = 3, rate: float = 0.05, checkpoints: Checkpoints | None = None) -> Regressor:
    """A regressor from rows with ``features`` and ``shares``, held against the column ``score`` of ``dev`` after ``each`` steps.

    Training stops once more than ``patience`` checks were no better than the best before, or after ``most`` steps.  With
    ``checkpoints`` each check is committed, and a run that was cut short goes on from its last one.
    """
    work = Scratch(train.sparkSession, "regression")
    exact = lambda df: df.where("features is not null").withColumn("features", F.col("features").cast("array<double>"))
    rows = work.save(exact(train).where("shares is not null").select("features", F.col("shares").cast("array<double>").alias("shares")), "rows")
    held = work.save(exact(dev).select("features", F.col(score).cast("double").alias("score")), "dev")
    finite = lambda x: F.abs(F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))
    n, width, grades, largest = rows.agg(F.count("*"), F.max(F.size("features")), F.max(F.size("shares")), F.max(F.array_max(F.transform("features", finite)))).first()
    if not n:
        return Regressor(np.zeros((1, 1)), 1.0)
    state = _State.start(width + 1, grades, largest or 1.0)
    rows = work.save(_packed(rows, state.model.largest), "train")
    work.drop("rows")
    if checkpoints is not None and (found := checkpoints.last()) is not None:
        state = _State.read(found[2])
    while state.worse <= patience and state.model.step < most:
        for _ in range(each):
            state.move(_gradient(rows, state.model) * 2 / (n * grades), rate)
        r = correlations(predict(held, state.model), [], "expected", "score").first()["spearman"] or 0.0
        state.judge(r)
        if checkpoints is not None:
            checkpoints.commit(state.table(train.sparkSession), state.model.step, r)
    return Regressor(state.kept, state.model.largest, state.model.best, state.model.step)


@dataclass
class _State:
    """All that a run goes on from."""

    model: Regressor
    kept: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    worse: int = 0

    @classmethod
    def start(cls, width: int, grades: int, largest: float) -> _State:
        zero = np.zeros((width, grades))
        return cls(Regressor(zero, largest), zero, zero, zero)

    def move(self, gradient: np.ndarray, rate: float) -> None:
        """One of Adam's steps."""
        step = self.model.step = self.model.step + 1
        self.mean = 0.9 * self.mean + 0.1 * gradient
        self.square = 0.999 * self.square + 0.001 * gradient**2
        self.model.weights = self.model.weights - rate * (self.mean / (1 - 0.9**step)) / (np.sqrt(self.square / (1 - 0.999**step)) + 1e-8)

    def judge(self, r: float) -> None:
        if r > self.model.best:
            self.model.best, self.kept = r, self.model.weights
        else:
            self.worse += 1

    def table(self, spark) -> DataFrame:
        parts = {"weights": self.model.weights, "kept": self.kept, "mean": self.mean, "square": self.square}
        rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in parts.items()]
        rows.append(("rest", [1], [self.model.largest, self.model.best, float(self.model.step), float(self.worse)]))
        return spark.createDataFrame(rows, "name string, shape array<int>, cells array<double>").coalesce(1)

    @classmethod
    def read(cls, table: DataFrame) -> _State:
        found = {r.name: np.array(r.cells).reshape(r.shape if r.name != "rest" else -1) for r in table.collect()}
        largest, best, step, worse = found["rest"].tolist()
        return cls(Regressor(found["weights"], largest, best, int(step)), found["kept"], found["mean"], found["square"], int(worse))
