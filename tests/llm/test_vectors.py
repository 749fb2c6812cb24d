import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuefit.llm import feast
from valuefit.llm.centroids import Lists, cluster
from valuefit.llm.whitening import products, whiten

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("k,dims,spread", [(1, 3, 9), (2, 1, 3), (8, 64, 400), (8, 2, 2), (30, 5, 4), (5, 4, 0)])
def test_threshold_walk_finds_the_nearest_and_smallest(k, dims, spread):
    rng = np.random.default_rng(k * dims)
    centroids, x = rng.integers(-spread, spread + 1, (k, dims)), rng.integers(-spread - 2, spread + 3, (3000, dims))
    who, distance = Lists(centroids).nearest(x)
    full = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (who == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()  # argmin takes the first of equal ones


def clusters(rows, k=8, rounds=10):
    rows = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in rows if i is not None)
    centroids = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in rows]
        for j in range(len(centroids)):
            mine = [x for (_, x), c in zip(rows, own) if c == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *near(x)) for i, x in rows]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(d for _, d, _ in found)
    return sorted((str(i), c, d, sum(e for _, e, g in found if g == c), total, sha[c]) for i, d, c in found)


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_clusters_by_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, 2.0]) + i % 3 for _ in range(64)]) for i in range(n)]
    rows += [rows[k % n] for k in range(n // 3)] if n else []
    rows += [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 63 + [NAN]), (1004, [1.0] * 63 + [INF]), (1005, [1.0] * 63 + [None])]
    rows += [(None, rows[0][1])] if n > 8 else []
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("own")).repartition(3)
    out = cluster(table)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = sorted((str(r[0]), *list(r)[1:]) for r in out.collect())
    assert got == clusters(rows)


def matrices():
    rng = np.random.default_rng(1)
    turn = lambda d: np.linalg.qr(rng.standard_normal((d, d)))[0]
    for values in (
        rng.uniform(1, 2, 64), 10.0 ** np.linspace(6, -6, 40), [5.0] * 30, [9.0] * 3 + [4.0] * 20 + [1.0], [7.0] + [0.0] * 20, [3.0], [2.0, 1.0],
        np.repeat(rng.uniform(1, 2, 10), 3), 1 + 1e-9 * np.arange(30), np.arange(1.0, 101.0),
    ):
        q = turn(len(values))
        a = q * np.asarray(values, float) @ q.T
        yield (a + a.T) / 2


@pytest.mark.parametrize("a", list(matrices()))
def test_contours_find_the_largest_eigenvalues(a):
    full = np.linalg.eigvalsh(a)[::-1]
    for shift in (0.0, full[0] * 1.1, full[len(full) // 2] * 1.0001 + 1e-5):
        assert feast.above(a, shift) == (full > shift).sum() or shift == 0
    values, vectors = feast.largest(a, 16)
    k = min(16, int((full > len(a) * 2.3e-16 * np.abs(a).sum(axis=1).max()).sum()))
    assert len(values) == k and (np.diff(values) <= 1e-12).all()
    assert np.abs(values - full[:k]).max() < 1e-13 * len(a) * full[0]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * len(a) * full[0]


def test_nothing_to_find():
    assert feast.largest(np.zeros((4, 4)), 16)[0].size == 0 == feast.largest(np.zeros((0, 0)), 3)[0].size


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for most in (0, 5, 1 << 20, 1 << 26, 1 << 40):
        z = rng.integers(-most, most + 1, (50, 3))
        assert (products(z) == z.astype(object).T @ z.astype(object)).all()


def whitened(rows, components=16):
    rows = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    distinct = sorted({tuple(x) for _, x in rows})
    n, dims = len(distinct), len(distinct[0])
    sums = [sum(c) for c in zip(*distinct)]
    y = np.array([[n * a - s for a, s in zip(x, sums)] for x in distinct], float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, n - 1, dims)
    out = {}
    for i, x in rows:
        exact = [n * a - s for a, s in zip(x, sums)]
        w = np.array(exact, float) / n @ vectors[:, :k] / np.sqrt(values[:k])
        out[i] = (sum(e * e for e in exact), np.abs(w))
    return n, values[:k] / values.sum(), out


@pytest.mark.parametrize("n,dims", [(400, 64), (7, 20), (60, 5), (2, 3)])
def test_whitening_by_brute_force(spark, n, dims):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 1 + 3 * d / dims) + 0.3 for d in range(dims)]) for i in range(n)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    again = [(i, rows[k][1]) for i, k in ((9000, 0), (9001, 0), (9002, 1), (9000, 0))]
    bad = [(8000, None), (8001, []), (8002, [1.0] * (dims - 1) + [NAN]), (8003, [-INF] + [1.0] * (dims - 1)), (8004, [None] + [1.0] * (dims - 1)), (8005, [1.0] * (dims + 1))]
    table = spark.createDataFrame(rows + again + bad, "vec_id long, embedding array<float>").withColumn("n", F.lit("own")).repartition(3)
    size, share, want = whitened(rows + again)
    got = {}
    for r in whiten(table).collect():
        got.setdefault(r["vec_id"], []).append(r)
    k = len(share)
    assert {i: len(v) for i, v in got.items()} == {i: k * (2 if i == 9000 else 1) for i in want}
    for i, (deviation, w) in want.items():
        for r in got[i]:
            c = r["component"] - 1
            assert r["n"] == size and int(r["deviation"]) == deviation
            assert abs(abs(r["whitened"]) - w[c]) < 1e-8 and abs(r["explained"] - share[c]) < 1e-12 and r["identity_error"] < 1e-9
    signs = {(r["component"], round(r["whitened"], 9)) for r in got[9000]}
    assert len(signs) == k  # copies have the same sign


def test_whitening_of_nothing(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    for t in (table, table.limit(0), table.withColumn("embedding", F.lit(None).cast("array<double>"))):
        assert whiten(t).count() == 0
    assert whiten(table.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
