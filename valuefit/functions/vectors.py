"""Vector columns: normalisation, projection and prediction.

Column expressions suit short vectors and stay in the JVM; the batch versions (``batch_map``) hand Arrow batches to
numpy, for wide vectors and matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once: inside the lambda of another function it would be for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def vector_sum(x: Column) -> Column:
    return F.aggregate(doubles(x), F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, w: Column) -> Column:
    return vector_sum(F.zip_with(doubles(x), doubles(w), lambda a, b: a * b))


def mean_square(x: Column) -> Column:
    return F.aggregate(doubles(x), F.lit(0.0), lambda a, v: a + v * v) / F.size(x)


def rms_coordinates(x: Column, eps: float = 1e-6) -> Column:
    """x / sqrt(mean(x^2) + eps)."""
    return bound(F.sqrt(mean_square(x) + F.lit(eps)), lambda scale: F.transform(doubles(x), lambda v: v / scale))


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """rows to mean 0 and biased variance 1, without weights."""
    mean = vector_sum(x) / F.size(x)
    centred = lambda m: F.transform(doubles(x), lambda v: v - m)
    scaled = lambda c, s: F.transform(c, lambda v: v / s)
    root = lambda c: F.sqrt(mean_square(c) + F.lit(eps))
    return bound(bound(mean, centred), lambda c: bound(root(c), lambda s: scaled(c, s)))


def center_scale(x: Column, mean: Column, scale: Column) -> Column:
    """(x - mean) / scale with frozen training statistics."""
    return F.zip_with(doubles(x), doubles(mean), lambda v, m: (v - m) / scale)


def with_intercept(x: Column) -> Column:
    """append a constant 1."""
    return F.concat(doubles(x), F.array(F.lit(1.0)))


def finite(x: Column, size: int | None = None) -> Column:
    """A vector of the expected size without nulls, NaN or infinities."""
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v) < float("inf")))
    if size is not None:
        ok = ok & (F.size(x) == size)
    return F.coalesce(ok, F.lit(False))


def layer_slice(x: Column, start: int, length: int) -> Column:
    """Coordinates start, start + 1, ... (from 0)."""
    return F.slice(x, start + 1, length)


def select_layers(n: int, base: int, count: int) -> list[int]:
    """layers from the last one backwards, at distances base^0, base^1, ...; base 1 takes neighbours."""
    steps = [k if base == 1 else base**k - 1 for k in range(count)]
    layers = [n - 1 - s for s in steps]
    if min(layers, default=0) < 0:
        raise ValueError("more layers asked for than there are")
    return layers


def concat_layers(df: DataFrame, columns: list[str], out: str = "x") -> DataFrame:
    """the selected layers' vectors, final one first, as one vector."""
    return df.withColumn(out, F.concat(*columns))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def vectors(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column of doubles."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows, np.float64).reshape(-1)))


def batch_map(df: DataFrame, outputs: dict[str, Callable[[np.ndarray], np.ndarray]], column: str = "x") -> DataFrame:
    """Add array columns, each a function of the matrix of a batch's vectors; the other columns pass through."""
    kept = [f for f in df.schema.fields if f.name not in outputs]
    schema = T.StructType([*kept, *(T.StructField(k, T.ArrayType(T.DoubleType())) for k in outputs)])
    at = df.columns.index(column)
    keep = [i for i, c in enumerate(df.columns) if c not in outputs]
    names = [*(df.columns[i] for i in keep), *outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(at)) if batch.num_rows else np.zeros((0, 0))
            made = [vectors(f(x)) if batch.num_rows else pa.array([], pa.list_(pa.float64())) for f in outputs.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], names)

    return df.mapInArrow(run, schema)


def projector(weight: np.ndarray, bias: np.ndarray, mean: np.ndarray | float = 0.0, scale: float = 1.0, relu: bool = True):
    """standardise, project by rows of unit length, add a bias, and clip at 0 if ``relu``."""
    unit = weight / np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-12)

    def run(x: np.ndarray) -> np.ndarray:
        z = (x - mean) / scale @ unit.T + bias
        return np.maximum(z, 0) if relu else z

    return run


def np_rms(x: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    return x / np.sqrt((x * x).mean(1, keepdims=True) + eps)


def np_layer_norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + eps)


def representations(final: int) -> dict[str, Callable[[np.ndarray], np.ndarray]]:
    """F8: the rest of a vector by RMS, its first ``final`` coordinates by row normalisation, and these unchanged."""
    return {"rms_rest": lambda x: np_rms(x[:, final:]), "first_layernorm": lambda x: np_layer_norm(x[:, :final]), "first": lambda x: x[:, :final]}


def representation_arms(df: DataFrame, final: int, column: str = "x") -> DataFrame:
    """F8: the three representations as columns, in one pass."""
    return batch_map(df, representations(final), column)


def mlp_forward(w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float):
    """sigmoid(w2 relu(w1 z + b1) + b2), one value a row."""
    return lambda z: 1 / (1 + np.exp(-(np.maximum(z @ w1.T + b1, 0) @ w2 + b2)))[:, None]


def predict_many(df: DataFrame, weights: np.ndarray, column: str = "x", out: str = "values") -> DataFrame:
    """M2 for many heads at once: rows of ``weights`` end with the intercept; ``out`` has a value for each."""
    w = np.atleast_2d(weights)
    return batch_map(df, {out: lambda x: x @ w[:, :-1].T + w[:, -1]}, column)


def predict(x: Column, weights: list[float] | Column) -> Column:
    """M2: w . [x, 1], unclipped."""
    w = weights if isinstance(weights, Column) else F.array(*(F.lit(float(v)) for v in weights))
    return dot(with_intercept(x), w)
