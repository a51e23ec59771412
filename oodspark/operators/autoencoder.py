"""Reconstruction by a linear autoencoder, fitted on second moments that tasks sum.

Encoder and decoder are one orthogonal matrix.  A turn of the fit multiplies it by the covariance of the training rows
and makes its columns orthogonal again, which leads to the principal components.  The moments are the only pass over the
rows; what the driver holds is the square of the dimensions, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of the moments that the driver takes, so vectors have 4,096 dimensions at most.
MOST_CELLS = 1 << 24


class AutoencoderError(ValueError):
    """Rows that no autoencoder can be fitted on."""


@dataclass(frozen=True)
class Autoencoder:
    """mean, axes (dimensions x rank, orthonormal columns) and losses: mean squared error on the training rows before the first turn and after each."""

    mean: np.ndarray
    axes: np.ndarray
    losses: tuple[float, ...]


def _stack(b: pa.RecordBatch, name: str) -> np.ndarray:
    x = b.column(b.schema.get_field_index(name))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(np.float64)


def _summed(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray], cells: int) -> np.ndarray:
    """Sum of make(vectors) over all rows: each task adds up its own batches, and the cells of all tasks are summed natively."""
    if cells > MOST_CELLS:
        raise AutoencoderError("vectors of so many dimensions are not supported")

    def run(batches):
        total = np.zeros(cells)
        for b in batches:
            if b.num_rows:
                total += make(_stack(b, "embedding")).ravel()
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(cells, dtype=np.int32)), "value": pa.array(total)})

    out = np.zeros(cells)
    for r in rows.select("embedding").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (centred first, divided by the number of rows) of the vectors of rows (embedding)."""
    shape = rows.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    n, dims = shape["n"], shape["most"]
    if not n:
        raise AutoencoderError("there are no in-distribution rows to fit on")
    if dims != shape["least"] or dims < 1:
        raise AutoencoderError("training vectors must have one length")
    mean = _summed(rows, lambda x: x.sum(axis=0), dims) / n
    return mean, _summed(rows, lambda x: (x - mean).T @ (x - mean), dims * dims).reshape(dims, dims) / n


def start(dims: int, rank: int) -> np.ndarray:
    """The fixed columns that a fit starts from: cosines of growing frequency."""
    return np.cos((2 * np.arange(dims)[:, None] + 1) * np.arange(rank)[None, :] * np.pi / (2 * dims))


def fitted(train: DataFrame, rank: int = 8, turns: int = 40) -> Autoencoder:
    """An autoencoder of the label-0 rows of train (label, embedding); other labels are never looked at."""
    if rank < 1 or turns < 1:
        raise AutoencoderError("rank and turns must be positive")
    mean, covariance = moments(train.filter("label = 0"))
    dims = len(mean)
    axes, _ = np.linalg.qr(start(dims, min(rank, dims)))
    loss = lambda q: float(np.trace(covariance) - np.trace(q.T @ covariance @ q)) / dims
    losses = [loss(axes)]
    for _ in range(turns):
        axes, _ = np.linalg.qr(covariance @ axes)
        losses.append(loss(axes))
    return Autoencoder(mean, axes, tuple(losses))


def scored(rows: DataFrame, model: Autoencoder) -> DataFrame:
    """rows without embedding, with score: the mean squared error of the reconstruction."""
    fields = [f for f in rows.schema if f.name != "embedding"]

    def run(batches):
        for b in batches:
            x = _stack(b, "embedding") - model.mean if b.num_rows else np.zeros((0, len(model.mean)))
            error = ((x - x @ model.axes @ model.axes.T) ** 2).mean(axis=1)
            kept = [b.column(i) for i, name in enumerate(b.schema.names) if name != "embedding"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(error)], names=[*[f.name for f in fields], "score"])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "score double"]))


def saved(model: Autoencoder, spark: SparkSession, path: str, config: dict[str, str] | None = None) -> None:
    """Write the model, its losses and a configuration; no training rows."""
    spark.createDataFrame([(i, float(m), [float(v) for v in a]) for i, (m, a) in enumerate(zip(model.mean, model.axes, strict=True))], "dim int, mean double, axes array<double>").write.mode("overwrite").parquet(f"{path}/weights")
    spark.createDataFrame([([float(v) for v in model.losses], config or {})], "losses array<double>, config map<string,string>").write.mode("overwrite").parquet(f"{path}/training")


def loaded(spark: SparkSession, path: str) -> tuple[Autoencoder, dict[str, str]]:
    rows = spark.read.parquet(f"{path}/weights").orderBy("dim").collect()  # a row for each dimension
    training = spark.read.parquet(f"{path}/training").first()
    return Autoencoder(np.array([r["mean"] for r in rows]), np.array([r["axes"] for r in rows]), tuple(training["losses"])), training["config"]
