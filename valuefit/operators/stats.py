"""Sufficient statistics of linear heads, accumulated in partitions and added up in a tree.

A partition sends one partial a key, never a matrix a row; partials are added ``fan`` at a time, so no task and no
driver meets more than a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuefit.functions.vectors import matrix, vectors

PARTIAL = "lot int, key string, n double, answers double, v array<double>"


def eligibility(phi: np.ndarray, decay: float, previous: np.ndarray | None = None) -> np.ndarray:
    """z_t = decay * z_{t-1} + phi_t along the rows."""
    z = np.empty_like(phi, dtype=np.float64)
    now = np.zeros(phi.shape[1]) if previous is None else np.asarray(previous, float)
    for i, row in enumerate(phi):
        now = decay * now + row
        z[i] = now
    return z


def trajectory_statistics(states: np.ndarray, outcome: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """A = sum z (phi - phi')^T and b = z_T * outcome of one answer; the state after the last is 0."""
    phi = np.hstack([states, np.ones((len(states), 1))])
    z = eligibility(phi, decay)
    after = np.vstack([phi[1:], np.zeros((1, phi.shape[1]))])
    return z.T @ (phi - after), z[-1] * outcome


def add_partials(partials: DataFrame, fan: int = 16, lots: int | None = None) -> DataFrame:
    """Sum of ``v`` by key, ``fan`` partials at a time; ``lots``, if it is known, is a bound above all lots."""
    lots = lots or (partials.agg(F.max("lot")).first()[0] or 0) + 1
    while lots > 1:
        near = partials.withColumn("lot", F.floor(F.col("lot") / fan).cast("int")).repartition("key", "lot")
        partials = near.sortWithinPartitions("key", "lot").mapInArrow(_summed, PARTIAL)
        lots = -(-lots // fan)
    return partials


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partial for each run of equal (lot, key); a run may go on in the next batch, and widths differ by key."""
    now: list = []  # lot, key, n, answers, v
    for batch in batches:
        if not batch.num_rows:
            continue
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        n, answers, v = (batch.column(i) for i in (2, 3, 4))
        n, answers, flat, ends = n.to_numpy(), answers.to_numpy(), v.flatten().to_numpy(), np.append(0, np.cumsum(v.value_lengths().to_numpy()))
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        done = []
        for a, b in zip(cuts, cuts[1:]):
            own = [n[a:b].sum(), answers[a:b].sum(), flat[ends[a] : ends[b]].reshape(b - a, -1).sum(axis=0)]
            if now and tuple(now[:2]) == names[a]:
                now[2:] = [x + y for x, y in zip(now[2:], own)]
                continue
            if now:
                done.append(now)
            now = [*names[a], *own]
        if done:
            yield _batch(done)
    if now:
        yield _batch([now])


def _batch(rows: list[list]) -> pa.RecordBatch:
    lot, key, n, answers, v = zip(*rows)
    ends = np.cumsum([0, *map(len, v)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(v)))
    return pa.RecordBatch.from_arrays([pa.array(lot, pa.int32()), pa.array(key, pa.string()), pa.array(n, pa.float64()), pa.array(answers, pa.float64()), lists], ["lot", "key", "n", "answers", "v"])


def _emit(lot: int, sums: dict[str, list]) -> pa.RecordBatch:
    keys = list(sums)
    width = len(sums[keys[0]][2]) if keys else 0
    rows = np.array([sums[k][2] for k in keys]).reshape(len(keys), width)
    return pa.RecordBatch.from_arrays(
        [pa.array([lot] * len(keys), pa.int32()), pa.array(keys, pa.string()), pa.array([float(sums[k][0]) for k in keys], pa.float64()),
         pa.array([float(sums[k][1]) for k in keys], pa.float64()), vectors(rows)],
        ["lot", "key", "n", "answers", "v"],
    )


def ridge_partials(df: DataFrame, key: str | None = None, x: str = "x", y: str = "y", shift: np.ndarray | None = None) -> DataFrame:
    """By key, n and v = [A row by row, b] of phi = [x - shift, 1].  Sums are raw, in double precision."""
    rows = df.select((F.col(key).cast("string") if key else F.lit("")).alias("key"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            phi = matrix(batch.column(1))
            phi = np.hstack([phi if shift is None else phi - shift, np.ones((len(phi), 1))])
            y_, keys = batch.column(2).to_numpy(zero_copy_only=False), np.array(batch.column(0).to_pylist())
            for k in np.unique(keys):
                at = keys == k
                v = np.concatenate([(phi[at].T @ phi[at]).ravel(), phi[at].T @ y_[at]])
                now = sums.setdefault(str(k), [0, 0, np.zeros_like(v)])
                now[0] += int(at.sum())
                now[2] += v
        if sums:
            yield _emit(TaskContext.get().partitionId(), sums)

    return rows.mapInArrow(run, PARTIAL)


def trajectory_rows(phi: np.ndarray, starts: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """z and phi - phi' of the rows of many answers that begin at ``starts``: all answers take a step at once, the longest
    ones first, so that those which go on stand in front."""
    size = np.diff(np.append(starts, len(phi)))
    order = np.argsort(-size, kind="stable")
    first, falling = starts[order], -size[order]
    z, d = phi.copy(), phi.copy()
    for p in range(1, int(size.max())):
        at = first[: np.searchsorted(falling, -p)] + p
        z[at] += decay * z[at - 1]
    d[:-1] -= phi[1:]
    last = starts + size - 1
    d[last] = phi[last]
    return z, d


def lstd_partials(
    df: DataFrame, decay: float, key: str | None = None, answer: list[str] = ["question", "response"], partitions: int | None = None, dealt: bool = False  # noqa: B006
) -> DataFrame:
    """By key, transitions, answers and v = [A, b] over whole answers (rows: x, y, position, the answer's columns).

    Rows are dealt by a hash of the answer, so hot questions do not meet in one task, sorted by position, and streamed;
    ``dealt``: the rows of an answer are in one partition as they are.
    """
    rows = df.select(
        (F.col(key).cast("string") if key else F.lit("")).alias("key"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"),
        F.col("position").cast("long").alias("position"), F.concat_ws("\x1f", *(F.col(c).cast("string") for c in answer)).alias("answer"),
    )
    if not dealt:
        rows = rows.repartition(partitions, "answer") if partitions else rows.repartition("answer")
    rows = rows.sortWithinPartitions("answer", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        held: list = []  # name, key, states and outcome of the answer that may go on in the next batch

        def add(states: np.ndarray, starts: np.ndarray, keys: list, outcome: np.ndarray) -> None:
            phi = np.hstack([states, np.ones((len(states), 1))])
            z, d = trajectory_rows(phi, starts, decay)
            ends = np.append(starts[1:], len(phi))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                a, b = starts[i], ends[j - 1]
                v = np.concatenate([(z[a:b].T @ d[a:b]).ravel(), z[ends[i:j] - 1].T @ outcome[i:j]])
                now = sums.setdefault(keys[i], [0, 0, np.zeros_like(v)])
                now[0] += b - a
                now[1] += j - i
                now[2] += v

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, names = matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False), batch.column(4)
            starts = np.flatnonzero(np.append(True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)))
            keys, outcome, goes_on = batch.column(0).take(pa.array(starts)).to_pylist(), y[np.append(starts[1:], len(y)) - 1], bool(held) and held[0] == names[0].as_py()
            if goes_on and len(starts) == 1:
                held[2].append(x)
                held[3] = outcome[0]
                continue
            if held:
                before = sum(map(len, held[2]))
                x = np.vstack([*held[2], x])
                starts = np.append(0, starts[goes_on:] + before)
                keys, outcome = [held[1], *keys[goes_on:]], outcome if goes_on else np.append(held[3], outcome)
            last = starts[-1]
            held = [names[-1].as_py(), keys[-1], [x[last:].copy()], outcome[-1]]
            if len(starts) > 1:
                add(x[:last], starts[:-1], keys[:-1], outcome[:-1])
        if held:
            add(np.vstack(held[2]), np.array([0]), [held[1]], np.array([held[3]]))
        if sums:
            yield _emit(TaskContext.get().partitionId(), sums)

    return rows.mapInArrow(run, PARTIAL)


def each_statistics(sums: DataFrame) -> Iterator[tuple[str, dict]]:
    """(key, {A, b, n, answers}) of partials that are added up, a partition at a time."""
    for row in sums.toLocalIterator():
        v = np.array(row["v"])
        k = int((np.sqrt(1 + 4 * len(v)) - 1) / 2)
        yield row["key"], {"a": v[: k * k].reshape(k, k), "b": v[k * k :], "n": int(row["n"]), "answers": int(row["answers"])}


def collect_statistics(partials: DataFrame) -> dict[str, dict]:
    """{key: A, b, n, answers}: one small system a key, on the driver."""
    return dict(each_statistics(add_partials(partials)))


def isotropic_normalization(df: DataFrame, x: str = "x") -> tuple[np.ndarray, float]:
    """Mean vector and one scale, sqrt(mean((x - mean)^2)), at least 1e-8, in two passes."""

    def partial(center: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, None
            for batch in batches:
                if batch.num_rows:
                    m = matrix(batch.column(0))
                    v = m.sum(0) if center is None else np.array([((m - center) ** 2).sum()])
                    n, total = n + len(m), v if total is None else total + v
            if n:
                yield _emit(TaskContext.get().partitionId(), {"": [n, 0, total]})

        return df.select(F.col(x).cast("array<double>")).mapInArrow(run, PARTIAL)

    row = add_partials(partial(None)).first()
    if row is None:
        raise ValueError("no training rows")
    mean = np.array(row["v"]) / row["n"]
    square = add_partials(partial(mean)).first()["v"][0]
    return mean, max(float(np.sqrt(square / (row["n"] * len(mean)))), 1e-8)


def gram_entries(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """A5 as entries (i, j, a) of A, and of b with j behind A's last column: the partials' sum, opened once it is one row."""
    w, k = F.col("w"), F.col("k")
    total = add_partials(ridge_partials(df, x=x, y=y)).select(((F.sqrt(1 + 4 * F.size("v")) - 1) / 2).cast("int").alias("w"), "v")
    entries = total.select("w", F.posexplode("v").alias("k", "a"))
    inside = k < w * w
    return entries.select(
        F.when(inside, F.floor(k / w)).otherwise(k - w * w).cast("int").alias("i"), F.when(inside, k % w).otherwise(w).cast("int").alias("j"), "a"
    )
