"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _check(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``edges`` (columns u, v) with the smallest node that it reaches.

    Alternating large-star and small-star steps: each hooks neighbours to the least node around, until nothing
    changes.  Every step is written to the shared folder.  A hub's neighbours are never gathered: the least neighbour is
    a partial aggregation, written, and joined back by a join whose hot partitions Spark can split.
    """
    now = scratch.keep(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0",
    )
    seen = _check(now)
    for k in range(rounds):
        if seen[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{name}-l{k}")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.distinct(), f"{name}-b{k}")
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-m{k}")
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        after = scratch.keep(small.distinct(), f"{name}-{k + 1}")
        for old in (f"{name}-{k}", f"{name}-l{k}", f"{name}-b{k}", f"{name}-m{k}"):
            scratch.drop(old)
        found = _check(after)
        now = after
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) that connect what a matrix of links between two lists of ids connects: the links themselves while
    they are few, else an edge from each id to the least of its component, so that their number is that of the ids."""
    a, b = np.nonzero(linked)
    if len(a) <= len(left) + len(right):
        return left[a], right[b]
    most = np.iinfo(np.int64).max
    x, y = left.copy(), right.copy()
    while True:
        low = np.minimum(x, np.where(linked, y[None], most).min(1, initial=most))
        up = np.minimum(y, np.where(linked, low[:, None], most).min(0, initial=most))
        if (low == x).all() and (up == y).all():
            break
        x, y = low, up
    u, v = np.concatenate([left, right]), np.concatenate([x, y])
    return u[u != v], v[u != v]
