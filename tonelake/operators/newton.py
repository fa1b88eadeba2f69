"""Newton's method for logistic regression on narrow features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Widest features: a task's matrix of second derivatives has the square of it in doubles
MAX_WIDTH = 1024
# Partial sums that one task adds up
FAN_IN = 32
_ROWS = 4096


def _parts(at: np.ndarray):
    """A task's weight, loss, gradient and second derivatives at ``at``, as one row."""
    width = len(at) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = 0.0, 0.0
        gradient, square = np.zeros(width + 1), np.zeros((width + 1, width + 1))
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                x = np.hstack([x, np.ones((len(x), 1))])
                y, weight = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                margin = x @ at
                loss += float(weight @ (np.logaddexp(0, margin) - y * margin))
                p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                gradient += x.T @ (weight * (p - y))
                square += (x * (weight * p * (1 - p))[:, None]).T @ x
                total += float(weight.sum())
        packed = np.concatenate([[total, loss], gradient, square.ravel()])
        yield pa.RecordBatch.from_pydict({"packed": [packed.tobytes()]})

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for data in batch.column(0).to_pylist():
            values = np.frombuffer(data)
            total = values if total is None else total + values
    if total is not None:
        yield pa.RecordBatch.from_pydict({"packed": [total.tobytes()]})


def _sums(rows: DataFrame, at: np.ndarray, partitions: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Sums over all rows, added up in tasks until a few are left."""
    parts = rows.mapInArrow(_parts(at), "packed binary")
    while partitions > FAN_IN:
        partitions = -(-partitions // FAN_IN)
        parts = parts.repartition(partitions).mapInArrow(_add, "packed binary")
    packed = sum(np.frombuffer(bytes(r["packed"])) for r in parts.collect())
    width = len(at)
    return packed[0], packed[1], packed[2 : 2 + width], packed[2 + width :].reshape(width, width)


def newton_steps(
    df: DataFrame,
    features_col: str,
    label_col: str,
    weight_col: str,
    penalty: float,
    max_iter: int = 100,
    tol: float = 1e-6,
) -> np.ndarray:
    """Coefficients, then the intercept, that minimise the weighted mean loss plus
    ``penalty * |w|^2 / 2``, by Newton steps from sums that Spark adds up.

    ``df`` is stored; its labels are 0 and 1. A step that doesn't lower the objective is halved. Ends when the
    gradient is below ``tol`` everywhere. Each step is one pass.
    """
    first = df.select(F.size(vector_to_array(features_col))).first()
    width = first[0] if first else 0
    if not 0 < width <= MAX_WIDTH:
        raise ValueError(f"newton needs 1 to {MAX_WIDTH} features, got {width}")
    rows = df.select(
        vector_to_array(features_col).alias("x"),
        F.col(label_col).cast("double").alias("y"),
        F.col(weight_col).cast("double").alias("w"),
    )
    partitions = rows.rdd.getNumPartitions()
    ridge = np.append(np.full(width, penalty), 0.0)

    def at(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        total, loss, gradient, square = _sums(rows, point, partitions)
        value = loss / total + float(ridge @ point**2) / 2
        return value, gradient / total + ridge * point, square / total + np.diag(ridge)

    point = np.zeros(width + 1)
    value, gradient, square = at(point)
    for _ in range(max_iter):
        if np.abs(gradient).max() <= tol:
            break
        step = np.linalg.lstsq(square, gradient, rcond=None)[0]
        for _ in range(30):
            there = point - step
            found = at(there)
            if found[0] <= value:
                break
            step = step / 2
        else:
            break
        point, (value, gradient, square) = there, found
    return point


def as_model(point: np.ndarray, features_col: str, label_col: str, weight_col: str, spark) -> LogisticRegressionModel:
    """Spark's model with these coefficients."""
    context = spark.sparkContext
    made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        context._jvm.org.apache.spark.ml.util.Identifiable.randomUID("logreg"),
        _py2java(context, Vectors.dense(point[:-1])),
        float(point[-1]),
    )
    made.set(made.featuresCol(), features_col)
    made.set(made.labelCol(), label_col)
    made.set(made.weightCol(), weight_col)
    return LogisticRegressionModel(made)
