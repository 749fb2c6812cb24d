"""Whitening of vectors: principal components of exact integer covariances, found by contour integration.

Spark adds up integers: the number and sums of the distinct vectors, then the products of their entries around the nearest
whole mean.  Both are exact, whatever the order of partitions, so the covariance is rounded once, at the end.  The
driver holds one matrix of dims x dims; its components come from ``feast``.  A last pass over the distinct vectors checks
that the whitened ones have the identity as covariance, and another projects all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table
from .feast import largest
from .vectors import matrix, summed, whole

#: products of integers up to here add up exactly in double precision
EXACT = 1 << 53


@dataclass
class Whitening:
    """``mean`` is the nearest whole mean and ``rest`` what the sums are above n times it."""

    n: int
    sums: list[int]
    mean: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, z: np.ndarray) -> np.ndarray:
        """Whitened components of vectors from which ``mean`` is taken."""
        return (z - np.array([r / self.n for r in self.rest])) @ (self.vectors / np.sqrt(self.values))


def integers(vectors: np.ndarray, scale: int, shift: int) -> np.ndarray:
    x = np.floor(vectors * float(scale))
    if x.size and np.abs(x).max() > 1 << 52:
        raise ValueError("components beyond 2^52 after scaling are not exact integers")
    return x.astype(np.int64) + shift


def _list(rows: list[list[int]]) -> pa.Array:
    return pa.array([[Decimal(v) for v in r] for r in rows], pa.list_(pa.decimal128(38, 0)))


def _totals(dims: int, scale: int, shift: int):
    """The number of a task's vectors and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, object)
        for batch in batches:
            x = integers(matrix(batch.column(0), dims)[1], scale, shift)
            total += np.array([*(int(v) for v in (x - shift).sum(axis=0)), 0], object)
            total += np.array([len(x) * shift] * dims + [len(x)], object)
        yield pa.RecordBatch.from_arrays([_list([total.tolist()])], ["sums"])

    return run


def products(z: np.ndarray) -> np.ndarray:
    """z'z exactly, as Python's integers."""
    dims = z.shape[1]
    out = np.zeros((dims, dims), object)
    most = int(np.abs(z).max(initial=0))
    if most == 0:
        return out
    if most * most > EXACT:
        return z.astype(object).T @ z.astype(object)
    step = EXACT // (most * most)
    for i in range(0, len(z), step):
        part = z[i : i + step].astype(float)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def _products(mean: np.ndarray, scale: int, shift: int):
    """Of each row of the matrix of a task's products: its place and its entries."""
    dims = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for batch in batches:
            total += products(integers(matrix(batch.column(0), dims)[1], scale, shift) - mean)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), _list(total.tolist())], ["row", "sums"])

    return run


def _check(model: Whitening, scale: int, shift: int):
    """Sums and products of a task's whitened vectors, one row a component."""
    dims, k = model.vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            w = model.project(integers(matrix(batch.column(0), dims)[1], scale, shift) - model.mean)
            total[:, :k] += w.T @ w
            total[:, k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["row", "sums"])

    return run


def distinct_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """One row for each distinct vector of integers, as floor(scale * x)."""
    x = F.transform("vector", lambda e: F.floor(e.cast("double") * float(scale)).cast("long"))
    return vectors.where(F.size("vector") == dims).select(x.alias("x")).dropDuplicates(["x"])


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000) -> Whitening | None:
    """Components of the distinct vectors; None for a table without vectors."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    kept = vectors.where(whole(F.col(vector))).select(F.col(vector).alias("vector")).where(F.size("vector") > 0)
    sizes = kept.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not sizes:
        return None
    dims = sizes[0]["dims"]
    listed = scratch.keep(distinct_vectors(kept, dims, scale), "distinct")
    partials = listed.mapInArrow(_totals(dims, 1, shift), "sums array<decimal(38,0)>")
    found = {r["at"]: int(r["total"]) for r in summed(partials, [], "sums").collect()}
    n, sums = found[dims], [found[i] for i in range(dims)]
    mean = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = [s - n * int(m) for s, m in zip(sums, mean)]
    partials = listed.mapInArrow(_products(mean, 1, shift), "row int, sums array<decimal(38,0)>")
    entries = {(r["row"], r["at"]): int(r["total"]) for r in summed(partials, ["row"], "sums").collect()}  # dims x dims
    exact = [[n * entries[i, j] - rest[i] * rest[j] for j in range(dims)] for i in range(dims)]
    covariance = np.array([[v / (n * n) for v in row] for row in exact])  # a quotient of integers is rounded once
    trace = sum(exact[i][i] for i in range(dims)) / (n * n)
    model = Whitening(n, sums, mean, rest, *largest(covariance, components), trace)
    k = len(model.values)
    if k:
        partials = listed.mapInArrow(_check(model, 1, shift), "row int, sums array<double>")
        opened = partials.select("row", F.posexplode("sums").alias("at", "x")).groupBy("row", "at").agg(F.sum("x").alias("total"))
        seen = np.zeros((k, k + 1))
        for r in opened.collect():
            seen[r["row"], r["at"]] = r["total"] / n
        model.identity_error = float(np.abs(seen[:, :k] - np.outer(seen[:, k], seen[:, k]) - np.eye(k)).max())
    scratch.drop("distinct")
    return model


def _project(model: Whitening, scale: int, shift: int):
    n, rest = model.n, model.rest
    squares = sum(r * r for r in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = matrix(batch.column(1), len(rest))
            z = integers(vectors, scale, shift) - model.mean
            # (n z - rest)^2 as three sums, the first two in 64 bits where they fit
            most = int(np.abs(z).max(initial=0))
            narrow = max(most * most * len(rest), most * sum(map(abs, rest)), max(map(abs, rest))) < 1 << 63
            y = z if narrow else z.astype(object)
            own, cross = (y * y).sum(axis=1).tolist(), (y @ np.array(rest, y.dtype)).tolist()
            deviation = [Decimal(n * n * a - 2 * n * b + squares) for a, b in zip(own, cross)]
            white = model.project(z)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * white.shape[1]), pa.array(white.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(deviation, pa.decimal128(38, 0)), lists], ["id", "deviation", "whitened"])

    return run


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000
) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each vector and component.

    Entries c become integers x = floor(scale * c) + shift.  Means and covariances (divisor n) are those of the n distinct
    vectors.  Components are unit eigenvectors of the covariance, numbered from 1 by falling eigenvalue e, of any sign, as
    many as asked for and as have an eigenvalue above rounding (fewer than n).  ``deviation`` is the exact sum of
    (n x - S)^2 over dimensions, S being the sums; ``whitened`` is x - S/n on the component, over sqrt(e); ``explained``
    is e over the covariance's trace; ``identity_error`` the largest entry of the whitened distinct vectors' covariance,
    less the identity.

    Vectors that are null, empty or have null, NaN or infinite components have no row, nor do those of another length
    than the most frequent one (of equally frequent ones the longest).  Repeated rows come back as often as they came;
    a row without a key counts and comes back too.  An empty table, a single distinct vector and one without components
    give an empty result.  Other columns do not matter.  Components beyond 2^52 after scaling are an error.
    """
    rows = vectors.select(F.col(key), F.col(vector))
    kind = rows.schema[key].dataType.simpleString()
    model = fit(rows, vector, components, scale, shift)
    if model is None or len(model.values) == 0:
        schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", key)
    share = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    out = rows.mapInArrow(_project(model, scale, shift), f"id {kind}, deviation decimal(38,0), whitened array<double>")
    out = out.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it does not fit a long; ``whiten`` has it as a decimal."""
    return whiten(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {"op13_whitening": op13_whitening}
