"""Data-parallel training of small networks: gradient partials on the executors, the update on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuefit.functions.vectors import batch_map, matrix, mlp_forward, projector
from valuefit.operators import heads, stats, study
from valuefit.operators.curate import pool_two
from valuefit.operators.metrics import prediction_metrics, question_brier

Params = dict[str, np.ndarray]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def compressor_gradients(p: Params, x: np.ndarray, y: np.ndarray, sparsity: float) -> tuple[float, Params]:
    """Loss and gradient sums of log loss + sparsity * mean(z), z = relu(x W^T + b) with unit rows of W, logit v z + c."""
    norm = np.linalg.norm(p["w"], axis=1, keepdims=True)
    unit = p["w"] / np.maximum(norm, 1e-12)
    pre = x @ unit.T + p["b"]
    z = np.maximum(pre, 0)
    logit = z @ p["v"] + p["c"]
    loss = float((np.logaddexp(0, logit) - y * logit).sum() + sparsity * z.mean(1).sum())
    d = _sigmoid(logit) - y
    dz = (d[:, None] * p["v"] + sparsity / z.shape[1]) * (pre > 0)
    du = dz.T @ x
    dw = (du - (du * unit).sum(1, keepdims=True) * unit) / np.maximum(norm, 1e-12)
    return loss, {"w": dw, "b": dz.sum(0), "v": z.T @ d, "c": np.array(d.sum())}


def value_gradients(p: Params, x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, Params]:
    """Squared error of sigmoid(w2 relu(w1 x + b1) + b2) + penalty on the weights."""
    pre = x @ p["w1"].T + p["b1"]
    h = np.maximum(pre, 0)
    out = _sigmoid(h @ p["w2"] + p["b2"])
    d = 2 * (out - y) * out * (1 - out)
    dh = d[:, None] * p["w2"] * (pre > 0)
    return float(((out - y) ** 2).sum()), {
        "w1": dh.T @ x + penalty * len(x) * p["w1"], "b1": dh.sum(0), "w2": h.T @ d + penalty * len(x) * p["w2"], "b2": np.array(d.sum())
    }


def joint_gradients(p: Params, x: np.ndarray, y: np.ndarray, sparsity: float) -> tuple[float, Params]:
    """Squared error of a value network on the features of a compressor, z = relu(x W^T + b) with unit rows of W, plus
    sparsity * mean(z): gradients of the network and, through the unit rows, of the compressor."""
    norm = np.maximum(np.linalg.norm(p["w"], axis=1, keepdims=True), 1e-12)
    unit = p["w"] / norm
    pre = x @ unit.T + p["b"]
    z = np.maximum(pre, 0)
    inner = z @ p["w1"].T + p["b1"]
    h = np.maximum(inner, 0)
    out = _sigmoid(h @ p["w2"] + p["b2"])
    d = 2 * (out - y) * out * (1 - out)
    dh = d[:, None] * p["w2"] * (inner > 0)
    dz = (dh @ p["w1"] + sparsity / z.shape[1]) * (pre > 0)
    du = dz.T @ x
    return float(((out - y) ** 2).sum() + sparsity * z.mean(1).sum()), {
        "w": (du - (du * unit).sum(1, keepdims=True) * unit) / norm, "b": dz.sum(0),
        "w1": dh.T @ z, "b1": dh.sum(0), "w2": h.T @ d, "b2": np.array(d.sum()),
    }


def affine_gradients(p: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Log loss of a linear compressor without clipping: logit v (W x + b) + c."""
    z = x @ p["w"].T + p["b"]
    logit = z @ p["v"] + p["c"]
    d = _sigmoid(logit) - y
    dz = d[:, None] * p["v"]
    return float((np.logaddexp(0, logit) - y * logit).sum()), {"w": dz.T @ x, "b": dz.sum(0), "v": z.T @ d, "c": np.array(d.sum())}


def clipped(g: Params, most: float | None) -> Params:
    """Gradients of all parameters together are at most ``most`` long; one that is not finite is an error."""
    size = float(np.sqrt(sum((v**2).sum() for v in g.values())))
    if not np.isfinite(size):
        raise ValueError("gradients are not finite")
    return g if most is None or size <= most else {k: v * (most / size) for k, v in g.items()}


def adamw(p: Params, g: Params, state: dict, rate: float | dict[str, float], decay: float) -> Params:
    """One step; ``rate`` may differ by parameter, and a parameter without one stays as it is."""
    state["t"] = t = state.get("t", 0) + 1
    rates = rate if isinstance(rate, dict) else dict.fromkeys(p, rate)
    out = dict(p)
    for k, r in rates.items():
        m = state[f"m{k}"] = 0.9 * state.get(f"m{k}", 0) + 0.1 * g[k]
        v = state[f"v{k}"] = 0.999 * state.get(f"v{k}", 0) + 0.001 * g[k] ** 2
        out[k] = p[k] * (1 - r * decay) - r * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return out


def train(
    df: DataFrame, params: Params, gradients, val_score, epochs: int, steps: int, rate: float | dict[str, float], decay: float, patience: int | None, warm: bool,
    clip: float | None = None,
) -> dict:
    """Steps over hash buckets of the rows (x, y); each epoch is scored on validation and the first best is kept.

    Rows are persisted once, sorted by bucket within their partitions, so that a step passes over cached batches of other
    buckets by their bounds.  A step is one job: tasks sum their gradients, which are added up in a tree.
    """
    data = df.select(
        F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("x"), F.lit(steps)).cast("int").alias("bucket")
    ).sortWithinPartitions("bucket").persist(StorageLevel.MEMORY_AND_DISK)
    shapes = {k: v.shape for k, v in params.items()}
    try:
        lots = data.rdd.getNumPartitions()
        state: dict = {}
        history, best = [], None
        if warm:
            score = val_score(params)
            history.append((0, None, score))
            best = (score, 0, params)
        for epoch in range(1, epochs + 1):
            objective = 0.0
            for bucket in range(steps):
                held = df.sparkSession.sparkContext.broadcast(params)

                def partial(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                    n, total = 0, None
                    for batch in batches:
                        if batch.num_rows:
                            loss, g = gradients(held.value, matrix(batch.column(0)), batch.column(1).to_numpy())
                            v = np.concatenate([[loss], *(np.asarray(g[k], float).ravel() for k in held.value)])
                            n, total = n + batch.num_rows, v if total is None else total + v
                    if n:
                        yield stats._emit(TaskContext.get().partitionId(), {"": [n, 0, total]})

                row = stats.add_partials(data.where(F.col("bucket") == bucket).select("x", "y").mapInArrow(partial, stats.PARTIAL), lots=lots).first()
                if row is None:
                    continue
                v = np.array(row["v"]) / row["n"]
                objective += row["v"][0]
                g, at = {}, 1
                for k, s in shapes.items():
                    size = int(np.prod(s))
                    g[k] = v[at : at + size].reshape(s)
                    at += size
                params = adamw(params, clipped(g, clip), state, rate, decay)
                held.unpersist()
            score = val_score(params)
            history.append((epoch, objective, score))
            if best is None or score < best[0]:
                best = (score, epoch, params)
            if patience is not None and epoch - best[1] >= patience:
                break
        return {"params": best[2], "epoch": best[1], "score": best[0], "history": history}
    finally:
        data.unpersist()


def _scored(val: DataFrame, value) -> float:
    """Question-mean Brier of a function of the matrix of vectors."""
    out = batch_map(val.select("question", "y", F.col("x").cast("array<double>").alias("x")), {"v": lambda x: value(x)[:, None]})
    return question_brier(out.withColumn("value", F.get("v", F.lit(0)))).first()[0]


def fit_compressor(
    tr: DataFrame, val: DataFrame, width: int, epochs: int = 5, steps: int = 2, rate: float = 0.02, seed: int = 0, sparsity: float = 0.01, affine: bool = False, clip: float | None = None
) -> dict:
    """M9: mean, scale and projection, the readout's best validation epoch.  ``affine``: features are linear, not clipped at
    0, of rows of any length, and not kept sparse."""
    mean, scale = stats.isotropic_normalization(tr)
    rng = np.random.default_rng(seed)
    start = {"w": rng.normal(size=(width, len(mean))), "b": np.zeros(width), "v": rng.normal(size=width) * 0.1, "c": np.array(0.0)}
    if affine:
        start["w"] /= np.sqrt(len(mean))
    norm = lambda x: (x - mean) / scale
    gradients = (lambda p, x, y: affine_gradients(p, norm(x), y)) if affine else (lambda p, x, y: compressor_gradients(p, norm(x), y, sparsity))

    def score(p: Params) -> float:
        z = features({"params": p, "mean": mean, "scale": scale, "affine": affine})
        return _scored(val, lambda x: _sigmoid(z(x) @ p["v"] + p["c"]))

    found = train(tr, start, gradients, score, epochs, steps, rate, 0.01, None, False, clip)
    return {**found, "mean": mean, "scale": scale, "affine": affine}


def features(fit: dict):
    """a fitted compressor as a function of matrices."""
    p, mean, scale = fit["params"], fit["mean"], fit["scale"]
    if fit.get("affine"):
        return lambda x: (x - mean) / scale @ p["w"].T + p["b"]
    return projector(p["w"], p["b"], mean, scale)


def transform(fit: dict, df: DataFrame, column: str = "x") -> DataFrame:
    """F4 with a fitted compressor: ``x`` becomes its features."""
    return mapped(df, features(fit), column)


def mapped(df: DataFrame, f, column: str = "x") -> DataFrame:
    return batch_map(df, {"_z": f}, column).drop(column).withColumnRenamed("_z", column)


def fit_mlp(tr: DataFrame, val: DataFrame, hidden: int = 8, epochs: int = 5, steps: int = 2, rate: float = 0.02, penalty: float = 1e-4, patience: int | None = 3,
            seed: int = 0, warm: Params | None = None) -> dict:
    """A value head on fixed features; with ``warm`` parameters epoch 0 can win."""
    width = len(tr.select("x").first()[0])
    rng = np.random.default_rng(seed)
    start = warm or {"w1": rng.normal(size=(hidden, width)) / np.sqrt(width), "b1": np.zeros(hidden), "w2": rng.normal(size=hidden) / np.sqrt(hidden), "b2": np.array(0.0)}

    value = lambda p: lambda x: mlp_forward(p["w1"], p["b1"], p["w2"], float(p["b2"]))(x)[:, 0]
    return train(tr, start, lambda p, x, y: value_gradients(p, x, y, penalty), lambda p: _scored(val, value(p)), epochs, steps, rate, 0.0, patience, warm is not None)


def joint_values(fit: dict):
    """Values of a network trained together with its compressor, as a function of matrices."""
    p = fit["params"]
    z, head = projector(p["w"], p["b"], fit["mean"], fit["scale"]), mlp_forward(p["w1"], p["b1"], p["w2"], float(p["b2"]))
    return lambda x: head(z(x))[:, 0]


def fit_joint(
    tr: DataFrame, val: DataFrame, compressor: dict, hidden: int = 8, epochs: int = 5, steps: int = 2, head_rate: float = 0.02, compressor_rate: float = 0.005,
    decay: float = 0.001, sparsity: float = 0.01, clip: float | None = 1.0, patience: int | None = 3, seed: int = 0, warm: Params | None = None,
) -> dict:
    """A value network and the compressor below it, trained together from a fitted compressor.

    The compressor has a rate of its own and keeps its mean and scale; rate 0 leaves it frozen.  Gradients of both together
    are clipped by their common length, which is that of the sums over all tasks.  With ``warm`` parameters, of the network
    and the compressor, epoch 0 can win.
    """
    mean, scale, width = compressor["mean"], compressor["scale"], len(compressor["params"]["b"])
    rng = np.random.default_rng(seed)
    head = {"w1": rng.normal(size=(hidden, width)) / np.sqrt(width), "b1": np.zeros(hidden), "w2": rng.normal(size=hidden) / np.sqrt(hidden), "b2": np.array(0.0)}
    start = warm or {"w": compressor["params"]["w"], "b": compressor["params"]["b"], **head}
    rates = dict.fromkeys(head, head_rate) | (dict.fromkeys(("w", "b"), compressor_rate) if compressor_rate else {})

    def gradients(p: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
        loss, g = joint_gradients(p, (x - mean) / scale, y, sparsity)
        return loss, {k: v if k in rates else np.zeros_like(v) for k, v in g.items()}  # what is frozen does not count in the length

    as_fit = lambda p: {"params": p, "mean": mean, "scale": scale}
    found = train(tr, start, gradients, lambda p: _scored(val, joint_values(as_fit(p))), epochs, steps, rates, decay, patience, warm is not None, clip)
    return {**found, "mean": mean, "scale": scale}


ARMS = ("full_transfer", "feature_transfer", "target", "pooled", "combined", "wide", "raw")


def transfer_arms(
    source: dict[str, DataFrame], target: dict[str, DataFrame], width: int, budget: int, seed: int = 0, epochs: int = 3, grid=heads.GRID, wide: int | None = None, raw=None, **fitting
) -> dict[str, dict]:
    """The seven arms, each with ``represent`` (a function of matrices), ``width`` and a ridge ``head``.

    Compressors are fitted once and shared: on the source (``full_transfer``, whose head is the source's too, and
    ``feature_transfer``, whose head is fitted anew), on the target, on a pool of both at the same number of questions
    (``pooled``, and ``wide`` with ``wide`` features, twice as many by default), and, for ``combined``, a linear one on the
    features of the source's and the target's side by side.  ``raw`` has none; it may be given as a function of matrices.

    ``source`` and ``target`` have train and val rows; no test table is taken, so none can leak.  All that is passed over many
    times is persisted once, and the heads of all arms on the same rows come from one pass over them.
    """
    held: list[DataFrame] = []

    def once(df: DataFrame) -> DataFrame:
        held.append(df.select("question", F.col("x").cast("array<double>").alias("x"), "y").persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    try:
        return _transfer_arms(*({s: once(t[s]) for s in ("train", "val")} for t in (source, target)), once, width, budget, seed, epochs, grid, wide, raw, fitting)
    finally:
        for df in held:
            df.unpersist()


def _transfer_arms(source: dict, target: dict, once, width: int, budget: int, seed: int, epochs: int, grid, wide: int | None, raw, fitting: dict) -> dict[str, dict]:
    fit = lambda tr, va, w=width, **more: fit_compressor(tr, va, w, epochs, seed=seed, **fitting, **more)
    pooled = {s: once(pool_two(source[s], target[s], budget, seed)) for s in ("train", "val")}
    from_source, from_target = fit(source["train"], source["val"]), fit(target["train"], target["val"])
    beside = lambda x: np.hstack([features(from_source)(x), features(from_target)(x)])
    joined = {s: once(mapped(target[s], beside)) for s in ("train", "val")}
    both = fit(joined["train"], joined["val"], affine=True)
    over_both = features(both)
    plans = {
        "full_transfer": (features(from_source), source), "feature_transfer": (features(from_source), target), "target": (features(from_target), target),
        "pooled": (features(fit(pooled["train"], pooled["val"])), target), "combined": (lambda x: over_both(beside(x)), target),
        "wide": (features(fit(pooled["train"], pooled["val"], wide or 2 * width)), target), "raw": (raw or (lambda x: x), target),
    }
    found = {}
    for rows in (source, target):
        found |= study.whole_study(rows["train"], rows["val"], {k: f for k, (f, own) in plans.items() if own is rows}, grid)
    return {k: {"represent": plans[k][0], "width": len(found[k]["weights"]) - 1, "head": found[k]} for k in ARMS}


def evaluate_arms(test: DataFrame, arms: dict[str, dict]) -> DataFrame:
    """(arm, metrics) of all arms in one pass over test rows."""
    names = list(arms)

    def values(x: np.ndarray) -> np.ndarray:
        return np.stack([arms[k]["represent"](x) @ arms[k]["head"]["weights"][:-1] + arms[k]["head"]["weights"][-1] for k in names], axis=1)

    rows = batch_map(test.select("question", "y", "x"), {"values": values}).drop("x")
    arm = F.array(*(F.lit(k) for k in names)).alias("arm")
    long = rows.select("question", "y", F.explode(F.arrays_zip(arm, F.col("values").alias("value"))).alias("z")).select("question", "y", "z.arm", "z.value")
    return prediction_metrics(long, ["arm"])
