"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut into halves with a codebook each; a pair of codewords is a cell of the product grid, and each
vector lies in the cell of its two nearest codewords.  A vector visits cells in the order of how near they can be, by
traversing the two sorted sequences of lower bounds until the target recall is met.  Visits are lists of cells beside
their vector; a vector is copied only for the blocks that compare it, and of two cells that could visit each other one does.  The lower bound of a codeword is
the distance to the plane that halves the way from the own nearest codeword to it.  Links of cosine t can lie sqrt(2 - 2t)
away, and visiting that far loses none; but few differences point straight at a plane, so the traversal stops where, for
a sample of vectors moved by that distance in random directions, the target share has been met.  All visits are verified
by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, maybe_broadcast, read_table
from .graph import components, forest

SLACK = 1e-9


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles, shorter vectors padded with zeros."""
    out = np.zeros((len(column), width))
    ends = np.cumsum([0, *(len(x) for x in column)]) if len(column) else np.zeros(1, int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and (np.diff(ends) == width).all():
        return flat.reshape(len(column), width)
    for i in range(len(column)):
        out[i, : ends[i + 1] - ends[i]] = flat[ends[i] : ends[i + 1]]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # squares of huge values stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def codebook(x: np.ndarray, size: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's codewords of a bounded sample."""
    if len(x) == 0:
        return np.zeros((1, x.shape[1]))
    c = x[np.random.default_rng(seed).choice(len(x), min(size, len(x)), replace=False)]
    for _ in range(rounds):
        own = _far(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's own codeword, and for each codeword the squared least distance to any vector that has it."""
    far = _far(x, c)
    own = far.argmin(1)
    apart = np.sqrt(_far(c, c))[own]
    step = (far - far[np.arange(len(x)), own][:, None]) / np.where(apart > 1e-12, 2 * apart, np.inf)
    return own, step**2


def visits(t1: np.ndarray, t2: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, codeword, codeword) of all cells whose two bounds sum to ``most`` or less, nearest codewords first."""
    o1, o2 = t1.argsort(1, kind="stable"), t2.argsort(1, kind="stable")
    s1, s2 = np.take_along_axis(t1, o1, 1), np.take_along_axis(t2, o2, 1)
    found: list[list[np.ndarray]] = [[], [], []]
    live = np.arange(len(t1))
    for i in range(t1.shape[1]):  # a row of the grid; it ends with the vectors that reach no cell of it
        live = live[s1[live, i] <= most]
        if len(live) == 0:
            break
        at = live
        for j in range(t2.shape[1]):
            at = at[s1[at, i] + s2[at, j] <= most]
            if len(at) == 0:
                break
            for out, v in zip(found, (at, o1[at, i], o2[at, j])):
                out.append(v)
    return tuple(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in found)


def reach(x: np.ndarray, c1: np.ndarray, c2: np.ndarray, threshold: float, recall: float, margin: float = 1.3, seed: int = 0) -> float:
    """How far, squared, to visit: the ``recall`` quantile over sampled vectors of what finds a neighbour of just the
    threshold's cosine in a random direction, times a margin; never more than what loses no link at all."""
    most = 2 - 2 * threshold + SLACK
    if recall >= 1 or len(x) == 0:
        return most
    half = x.shape[1] // 2
    x = x[np.random.default_rng(seed).integers(len(x), size=20000)]
    g = np.random.default_rng(seed + 1).normal(size=x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    y = threshold * x + np.sqrt(max(1 - threshold**2, 0)) * g / np.maximum(np.sqrt((g * g).sum(1, keepdims=True)), 1e-300)
    need = np.zeros(len(x))
    for part, c in ((slice(None, half), c1), (slice(half, None), c2)):
        need += bounds(x[:, part], c)[1][np.arange(len(x)), _far(y[:, part], c).argmin(1)]
    return float(min(most, np.quantile(need, recall) * margin**2 + SLACK))


def _assign(c1: np.ndarray, c2: np.ndarray, width: int, most: float):
    """Each vector's own cell and, as one list, the others that it visits.  Of two cells each within reach of the other's
    vectors only one is visited, by a rule that gives every cell about half of its neighbours."""
    half = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                x = _unit(_matrix(part.column(4), width))
                (h1, t1), (h2, t2) = bounds(x[:, :half], c1), bounds(x[:, half:], c2)
                at, i, j = visits(t1, t2, most)
                home, cell = h1 * len(c2) + h2, i * len(c2) + j
                own = home[at]
                goes = (own != cell) & ((own < cell) == ((own + cell) % 2 == 0))
                order = at[goes].argsort(kind="stable")
                ends = np.cumsum([0, *np.bincount(at[goes], minlength=len(x))]).astype(np.int32)
                visited = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell[goes][order]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(home), visited], ["id", "times", "label", "dim", "vector", "home", "visited"]
                )

    return run


def _compare(width: int, least: float):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        """Members of a block against its visitors, and against each other where no other block holds their cell's members."""
        probe, home = (table.column(c).to_numpy().astype(bool) for c in ("probe", "home"))
        alone = (table.column("members").to_numpy() == 1) & (table.column("pb").to_numpy() == 0)
        ids, times = table.column("id").to_numpy(), table.column("times").to_numpy()
        x = _unit(_matrix(table.column("vector").combine_chunks(), width))
        probe_too = probe | (alone & ~probe)
        p, m = ids[probe_too], ids[~probe]
        linked = x[probe_too] @ x[~probe].T >= least
        linked &= ~(home | ~probe)[probe_too][:, None] | (p[:, None] < m[None])  # in its own cell a pair is found by its smaller id
        n = np.concatenate([linked @ times[~probe], linked.T @ times[probe_too]])
        ids = np.concatenate([p, m])[n > 0]
        u, v = forest(linked, p, m)
        return pa.table(
            [pa.array(np.concatenate([ids, u])), pa.array(np.concatenate([ids, v])), pa.array([*n[n > 0].tolist(), *[None] * len(u)], pa.int64())],
            schema=schema,
        )

    return run


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9999, per_cell: int = 2048, sample: int = 8192, most_words: int = 512, block: int = 1024
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Rows of equal, non-null label and equal length are linked if their cosine, in double precision, is ``threshold``
    or more.  Rows whose embedding is null, empty or zero, or holds null or non-finite values, or whose id is null,
    link with nothing (n_links 0, component_id their own id, kept).  ``n_links`` counts other rows, so repeated rows
    link with each other; ``component_id`` is the smallest vec_id reachable.

    ``recall`` is the share of links at the threshold itself that the index aims at, 1 for all whatever the cost; links
    above the threshold are nearer.  Equal vectors of a label are one class from the start, so copies never meet in
    pairs.  The codebooks, of at most
    ``most_words`` words each, are fitted on at most ``sample`` vectors, with ``per_cell`` vectors of all labels to a cell
    while they suffice; all vectors are indexed.  Cells are cut into
    blocks of about ``block`` members and visitors; a block emits a count for each visitor and a tree of links.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(
        finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("embedding", lambda v: v != 0), F.lit(False)
    )
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")
    ).withColumn("usable", usable)
    keys = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(7), "embedding").alias("k2")]
    classes = rows.where("usable").groupBy("label", *keys).agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("times"), F.any_value("embedding").alias("vector")
    )
    classes = scratch.keep(classes.withColumn("dim", F.size("vector")), "classes")
    n, width = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    width = max(2, width or 2)
    some = classes.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()  # bounded by ``sample``
    some = _unit(_matrix(some.column(0).combine_chunks(), width)) if some.num_rows else np.zeros((0, width))
    words = int(min(most_words, max(1, np.ceil(np.sqrt(n / per_cell)))))
    c1, c2 = (codebook(x, words, seed=i) for i, x in enumerate((some[:, : width // 2], some[:, width // 2 :])))
    placed = classes.select("id", "times", "label", "dim", "vector").mapInArrow(
        _assign(c1, c2, width, reach(some, c1, c2, threshold, recall)),
        f"id long, times long, label string, dim int, vector array<{kind}>, home long, visited array<long>",
    )
    placed = scratch.keep(placed, "placed")
    cell = ["label", "dim", "cell"]
    members = placed.groupBy("label", "dim", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("members"))
    probes = placed.select("label", "dim", F.explode("visited").alias("cell")).groupBy(*cell).agg(F.count(F.lit(1)).alias("probes"))
    sizes = members.join(probes, cell, "left").na.fill(0, ["probes"]).where("probes > 0 or members > 1")
    lots = lambda n: F.ceil(n / block).cast("int")
    many = F.col("members") > block  # then members visit their own cell's other blocks too
    sizes = sizes.select(
        *cell, lots(F.col("members")).alias("members"),
        F.greatest(F.lit(1), lots(F.col("probes") + F.when(many, F.col("members")).otherwise(0))).alias("probes"),
    )
    sizes = scratch.keep(sizes, "sizes")
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    lot = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    # vectors leave the table only after the cells without a partner are gone, one copy for each block that compares them
    roles = F.concat(
        F.array(F.struct(F.col("home").alias("cell"), F.lit(False).alias("probe"), F.lit(True).alias("home"))),
        F.array(F.struct(F.col("home").alias("cell"), F.lit(True).alias("probe"), F.lit(True).alias("home"))),
        F.transform("visited", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("probe"), F.lit(False).alias("home"))),
    )
    dealt = placed.select("id", "times", "label", "dim", "vector", F.explode(roles).alias("role")).select(
        "id", "times", "label", "dim", "vector", "role.*"
    )
    dealt = dealt.join(maybe_broadcast(sizes, sizes.count(), 1_000_000), cell).where("not (probe and home and members = 1)")
    dealt = dealt.withColumn("mb", F.explode(F.when(F.col("probe"), spread(F.col("members"))).otherwise(F.array(lot(F.col("members"))))))
    dealt = dealt.withColumn("pb", F.explode(F.when(F.col("probe"), F.array(lot(F.col("probes")))).otherwise(spread(F.col("probes")))))
    dealt = dealt.drop("probes")
    found = scratch.keep(
        dealt.groupBy(*cell, "mb", "pb").applyInArrow(_compare(width, threshold), "u long, v long, n long"), "found"
    )
    edges = found.where("n is null").select("u", "v")
    of = scratch.keep(components(edges, scratch), "components")
    links = found.where("n is not null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("links"))
    named = classes.select("label", "k1", "k2", "id", "times").join(links, "id", "left").join(
        of.withColumnRenamed("node", "id"), "id", "left"
    ).select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    # one vector may be a third of all rows: Spark splits the partitions of hot keys
    named = scratch.keep(named.withColumn("usable", F.lit(True)), "named")
    out = rows.select("vec_id", "label", *keys, "usable").join(named, ["label", "k1", "k2", "usable"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


SQL = {
    "op4_multi_index": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.y, vec_id)) AS component_id,
  vec_id <= coalesce(c.y, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
}
QUERIES = {"op4_multi_index": op4_multi_index}
