"""Vectors of Arrow batches as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the column, vectors in double precision) of its vectors of ``dims`` components, none null, NaN or infinite."""
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    rows = np.flatnonzero(np.diff(offsets) == dims)
    if column.null_count:
        rows = rows[column.is_valid().to_numpy(zero_copy_only=False)[rows]]
    if len(rows) == len(column):
        found = values[offsets[0] : offsets[-1]].reshape(len(rows), dims)
    else:
        found = values[offsets[rows][:, None] + np.arange(dims)]
    finite = np.isfinite(found).all(axis=1)
    return rows[finite], found[finite]


def whole(vector: Column) -> Column:
    """True for a vector that is not null and has no null, NaN or infinite component."""
    return F.coalesce(F.forall(vector, lambda e: F.coalesce(F.abs(e.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def summed(partials, keys: list[str], values: str):
    """Entries (keys, at, total) of the sums of array columns, by keys and place; each task adds up its own first."""
    opened = partials.select(*keys, F.posexplode(values).alias("at", "x"))
    return opened.groupBy(*keys, "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("total"))
