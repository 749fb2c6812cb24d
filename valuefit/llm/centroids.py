"""Clusters of integer vectors around k centroids, with exact results.

Nearest centroids come from the threshold algorithm.  In every dimension the centroids stand in a sorted list, and a
vector's own value has a place in it.  The lists of all dimensions are walked outward from there, nearest value first, in
step: after each step the centroids that came up are compared in full, and the squared distances at the frontiers of
all lists are added.  No centroid that has not come up is nearer than that sum, so a vector is done as soon as it is
strictly above its best distance; while it is equal, one with a smaller number could still tie.

A round is one scan of the vectors.  Centroids (k vectors) go out with the tasks; each task returns one sum a centroid, and
Spark adds these by centroid and dimension, so that the driver gets k x dims numbers.  Nothing is shuffled by vector, so
neither copies nor hot labels meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .vectors import matrix, summed, whole

#: vectors that walk at a time
BLOCK = 1024
#: integers up to this keep squared distances of 64 dimensions, and sums of 2^36 vectors, within 64 bits
MOST = 1 << 27
FAR = np.iinfo(np.int64).max


class Lists:
    """The sorted lists of centroids by dimension, and the walk through them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.k, self.dims = centroids.shape
        order = np.argsort(centroids, axis=0, kind="stable")
        # a sentinel at either end of each list
        self.order = np.pad(order.T, ((0, 0), (1, 1)))
        self.values = np.take_along_axis(centroids, order, axis=0).T

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row; of equal ones the smallest number."""
        found = [self._walk(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)]
        return tuple(np.concatenate(z) if found else np.zeros(0, np.int64) for z in (zip(*found) if found else ((), ())))

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.stack([np.searchsorted(self.values[d], x[:, d]) for d in range(self.dims)], axis=1)  # one before it, with the sentinel
        high, dim = low + 1, np.arange(self.dims)
        values = np.pad(self.values, ((0, 0), (1, 1)))
        best, who = np.full(len(x), FAR), np.full(len(x), self.k)
        seen = np.zeros((len(x), self.k), bool)
        rows = np.arange(len(x))
        for _ in range(self.k):
            own, at, up = x[rows], low[rows], high[rows]
            below = np.where(at > 0, own - values[dim, at], FAR)
            above = np.where(up <= self.k, values[dim, up] - own, FAR)
            down = below <= above
            came = self.order[dim, np.where(down, at, up)]
            new = np.zeros((len(rows), self.k), bool)
            new[np.arange(len(rows))[:, None], came] = True
            new &= ~seen[rows]
            seen[rows] |= new
            r, c = np.nonzero(new)  # by row, then number: of equal distances the smaller number stays
            gap = own[r] - self.centroids[c]
            distance = np.einsum("ij,ij->i", gap, gap)
            full = np.full((len(rows), self.k), FAR)
            full[r, c] = distance
            number = full.argmin(axis=1)
            least = full[np.arange(len(rows)), number]
            better = (least < best[rows]) | (least == best[rows]) & (number < who[rows])
            best[rows[better]], who[rows[better]] = least[better], number[better]
            low[rows] = at - down
            high[rows] = up + ~down
            frontier = np.minimum(below, above)
            rows = rows[np.einsum("ij,ij->i", frontier, frontier) <= best[rows]]
            if len(rows) == 0:
                break
        return who, best


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(vectors * float(scale))
    if x.size and np.abs(x).max() > MOST:
        raise ValueError(f"components beyond {MOST} after scaling: squared distances might not fit a long")
    return x.astype(np.int64)


def _sums(centroids: np.ndarray, scale: int):
    """Of each centroid that has vectors: the sums of their components, their number and the sum of their distances."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, total = Lists(centroids), np.zeros((k, dims + 2), object)
        for batch in batches:
            x = integers(matrix(batch.column(0), dims)[1], scale)
            who, best = lists.nearest(x)
            for c in np.unique(who):
                own = who == c
                total[c] += np.array([*x[own].sum(axis=0).tolist(), int(own.sum()), sum(best[own].tolist())], object)
        full = [c for c in range(k) if total[c, dims]]
        sums = pa.array([[Decimal(v) for v in total[c]] for c in full], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), sums], ["cluster", "sums"])

    return run


def _labels(centroids: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch in batches:
            rows, vectors = matrix(batch.column(1), centroids.shape[1])
            who, best = lists.nearest(integers(vectors, scale))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(who.astype(np.int32)), pa.array(best)], ["id", "cluster", "distance"])

    return run


def seeds(vectors: DataFrame, key: str, vector: str, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The k vectors whose keys have the smallest hashes, in that order; of equal keys the smaller vector, no key last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    first = vectors.where((F.size(vector) == dims) & whole(F.col(vector))).select(name.alias("name"), F.col(vector).alias("v"))
    rows = first.orderBy(F.col("name").asc_nulls_last(), "v").limit(k).collect()
    return integers(np.array([r["v"] for r in rows], float).reshape(len(rows), dims), scale)


def step(vectors: DataFrame, vector: str, centroids: np.ndarray, scale: int) -> dict[int, list[int]]:
    """The sums of all clusters that have vectors: k x (dims + 2) numbers at most."""
    partials = vectors.select(vector).mapInArrow(_sums(centroids, scale), "cluster int, sums array<decimal(38,0)>")
    out: dict[int, list[int]] = {}
    for r in summed(partials, ["cluster"], "sums").collect():
        out.setdefault(r["cluster"], [0] * (centroids.shape[1] + 2))[r["at"]] = int(r["total"])
    return out


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector of ``dims`` finite components.

    Components are the integers floor(scale * x).  Centroids start as the k vectors whose sha256 of ``seed:key`` is
    smallest; each round takes every vector to its nearest centroid (squared distance; of equal ones the smaller number) and
    every centroid with vectors to the floor of their mean; one without vectors stays.  Rounds after one that moves no
    centroid would change nothing and are left out.  All sums are exact.

    Vectors that are null, of another length or with null, NaN or infinite components have no row.  Repeated rows count and
    come back as often as they came.  With fewer than k vectors there are as many centroids as vectors; an empty table
    gives an empty result.  Other columns do not matter.  Components beyond 2^27 after scaling are an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key), F.col(vector))
    kind = rows.schema[key].dataType.simpleString()
    centroids = seeds(rows, key, vector, k, dims, scale, seed)
    named = f"`id` {kind}, cluster int, distance long"
    if len(centroids) == 0:
        none = spark.createDataFrame([], f"{named}, cluster_inertia long, inertia long, centroid_sha256 string")
        return none.withColumnRenamed("id", key)
    for _ in range(rounds):
        sums = step(rows, vector, centroids, scale)
        after = centroids.copy()
        for c, (*total, n, _distance) in sums.items():
            after[c] = [t // n for t in total]
        settled = (after == centroids).all()
        centroids = after
        if settled:
            break
    sums = step(rows, vector, centroids, scale)
    inertia = sum(s[-1] for s in sums.values())
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(c, s[-1], inertia, digest[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    labels = rows.select(key, vector).mapInArrow(_labels(centroids, scale), named)
    return labels.join(F.broadcast(about), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    near = """select v.row, any_value(v.x) as x, min(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint * {k} + c.c) as best
  from vectors v cross join {of} c group by v.row"""
    parts = [f"""vectors as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda e: floor({scale} * e::double)::bigint) as x
  from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda e: isfinite(e))) = {dims}
), c0 as materialized (
  select (row_number() over (order by name)) - 1 as c, x from (select sha256('{seed}:' || vec_id) as name, x from vectors order by name limit {k})
)"""]
    for i in range(rounds):
        parts.append(f"""n{i} as materialized ({near.format(k=k, of=f"c{i}")}),
o{i} as (select best % {k} as c, unnest(x) as e, generate_subscripts(x, 1) as place from n{i}),
m{i} as (select c, place, sum(e)::bigint as s, count(*) as n from o{i} group by c, place),
f{i} as (select c, list((s - ((s % n) + n) % n) // n order by place) as x from m{i} group by c),
c{i + 1} as materialized (select c{i}.c, coalesce(f{i}.x, c{i}.x) as x from c{i} left join f{i} using (c))""")
    last = near.format(k=k, of=f"c{rounds}")
    return f"""with {", ".join(parts)},
ends as materialized ({last})
select v.vec_id, (best % {k})::int as cluster, best // {k} as distance, (sum(best // {k}) over (partition by best % {k}))::bigint as cluster_inertia,
  (sum(best // {k}) over ())::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from ends join vectors v using (row) join c{rounds} c on c.c = best % {k}"""


QUERIES = {"op12_centroids": op12_centroids}
SQL = {"op12_centroids": _sql()}
