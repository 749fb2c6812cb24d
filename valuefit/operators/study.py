"""Learning curves over budgets, representation arms, domains and seeds from one scan of the training rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from valuefit.functions import text as t
from valuefit.functions.vectors import matrix
from valuefit.operators import heads, metrics, stats

Arms = dict[str, Callable[[np.ndarray], np.ndarray]]
Key = tuple[str, int, str, int]  # domain, seed, arm, budget
SEP = "\x1f"


def memberships(train: DataFrame, budgets: list[int], seeds: list[int]) -> DataFrame:
    """(domain, question, bands): the seeds whose order puts the question within a budget, each with the least such budget.

    Only the first ``max(budgets)`` questions of a domain and seed are ranked and kept, so the table has at most domains x
    seeds x that many rows, whatever the number of questions.
    """
    asked = train.select("domain", "question").distinct()
    order = [F.struct(F.lit(s).alias("seed"), t.order_key(s, F.col("question")).alias("order")) for s in seeds]
    first = W.partitionBy("domain", "seed").orderBy("order", "question")
    top = asked.select("domain", "question", F.inline(F.array(*order))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= max(budgets))
    band = F.coalesce(*(F.when(F.col("rank") <= b, F.lit(b)) for b in sorted(budgets)))
    return top.groupBy("domain", "question").agg(F.collect_list(F.concat_ws(SEP, "seed", band)).alias("bands"))  # as many as seeds


def arm_partials(rows: DataFrame, arms: Arms, shifts: dict[str, np.ndarray]) -> DataFrame:
    """Ridge partials of rows (domain, bands, x, y) by domain, seed, band and arm, whose widths differ by arm: every vector
    is read once, goes through each arm once, and is added to the sums of all its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False)
            owners: dict[str, list[int]] = {}
            for i, (d, bands) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                for b in bands:
                    owners.setdefault(f"{d}{SEP}{b}", []).append(i)
            for arm, f in arms.items():
                phi = f(x) - shifts[arm]
                phi = np.hstack([phi, np.ones((len(phi), 1))])
                for k, at in owners.items():
                    v = np.concatenate([(phi[at].T @ phi[at]).ravel(), phi[at].T @ y[at]])
                    now = sums.setdefault(f"{k}{SEP}{arm}", [0, np.zeros_like(v)])
                    now[0] += len(at)
                    now[1] += v
        if sums:
            lot, n = TaskContext.get().partitionId(), len(sums)
            ends = np.cumsum([0, *(len(s[1]) for s in sums.values())]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([s[1] for s in sums.values()])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lot] * n, pa.int32()), pa.array(list(sums)), pa.array([float(s[0]) for s in sums.values()]), pa.array([0.0] * n), lists],
                ["lot", "key", "n", "answers", "v"],
            )

    return rows.select("domain", "bands", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y")).mapInArrow(run, stats.PARTIAL)


def whole_study(train: DataFrame, val: DataFrame, arms: Arms, grid=heads.GRID) -> dict[str, dict]:
    """M3 for many arms: by arm the ridge head of the best penalty on all training rows, as ``heads.ridge_fit`` gives it, from
    one pass over them and one over validation rows for all arms."""
    one = lambda df: df.withColumn("domain", F.lit(""))
    found = _fitted(one(train).withColumn("bands", F.array(F.lit(f"0{SEP}0"))), one(val), arms, [0], grid)
    out = {}
    for (_, _, arm, _), s in found.items():
        e = s["best"]
        out[arm] = {"w": s["u"] @ (s["turned"] / (s["eig"] + e)), "mean": s["mean"], "scale": s["scale"], "epsilon": e, "condition": (s["eig"][-1] + e) / (s["eig"][0] + e),
                    "per_prefix": e / s["n"], "weights": s["weights"][e], "score": s["scores"][e]}
    return out


def arm_study(train: DataFrame, val: DataFrame, arms: Arms, budgets: list[int], seeds: list[int], grid=heads.GRID, sample: int = 1024) -> dict[Key, dict]:
    """For each domain, seed, arm and budget of questions the ridge heads of all penalties and the best on validation.

    Budgets of a seed are nested.  Sums are taken once a band, around a fixed shift (the mean of up to ``sample`` rows, which
    only guards against cancellation), added up over bands and standardised for each budget by algebra.  All heads are
    scored in one pass over validation rows, and once more for penalties that are added while the largest one is best.
    """
    bands = F.broadcast(memberships(train, budgets, seeds))  # at most domains x seeds x max(budgets) rows
    return _fitted(train, val, arms, budgets, grid, sample, bands)


def _fitted(train: DataFrame, val: DataFrame, arms: Arms, budgets: list[int], grid, sample: int = 1024, bands: DataFrame | None = None) -> dict[Key, dict]:
    """The study of training rows that have their ``bands``, or get them from a table of questions."""
    some = matrix(train.select(F.col("x").cast("array<double>")).limit(sample).toArrow().column(0))
    shifts = {k: f(some).mean(axis=0) for k, f in arms.items()}
    parts = stats.collect_statistics(arm_partials(train if bands is None else train.join(bands, ["domain", "question"]), arms, shifts))
    study: dict[Key, dict] = {}
    for start in sorted({(d, int(s), a) for d, s, _, a in (k.split(SEP) for k in parts)}):
        d, s, arm = start
        total = None
        for b in sorted(budgets):
            p = parts.get(SEP.join((d, str(s), str(b), arm)))
            if p is not None:
                total = p if total is None else {"a": total["a"] + p["a"], "b": total["b"] + p["b"], "n": total["n"] + p["n"]}
            mean, scale = heads.moments(total, shifts[arm])
            a, rhs = heads.standardised(mean, scale, total, shifts[arm])
            eig, u = np.linalg.eigh(a)
            study[d, s, arm, b] = {"mean": mean, "scale": scale, "n": total["n"], "eig": eig.clip(0), "u": u, "turned": u.T @ rhs, "weights": {}, "scores": {}}
    todo = {k: list(map(float, grid)) for k in study}
    while todo:
        for k, penalties in todo.items():
            s = study[k]
            for e in penalties:
                s["weights"][e] = heads.unscale(s["u"] @ (s["turned"] / (s["eig"] + e)), s["mean"], s["scale"])
        for (k, e), score in _scores(val, study, todo, arms).items():
            study[k]["scores"][e] = score
        for k, s in study.items():
            s["best"] = min(sorted(s["scores"]), key=s["scores"].get)
        todo = {k: [s["best"] * 10] for k, s in study.items() if s["best"] == max(s["scores"])}
        if any(e > [heads.CEILING] for e in todo.values()):
            raise ValueError("the penalty ceiling 1e10 is still best")
    return study


def _predictor(study: dict[Key, dict], chosen: dict[Key, list[float]], arms: Arms):
    """By domain, the heads (key, penalty) in the order of the columns that the function of a matrix gives."""
    order: dict[str, list[tuple[Key, float]]] = {}
    for k, penalties in chosen.items():
        order.setdefault(k[0], []).extend((k, e) for e in penalties)
    for heads_ in order.values():
        heads_.sort(key=lambda h: list(arms).index(h[0][2]))  # heads of an arm side by side
    stacked = {d: {a: np.array([study[k]["weights"][e] for k, e in hs if k[2] == a]) for a in arms} for d, hs in order.items()}

    def run(d: str, x: np.ndarray) -> np.ndarray:
        made = []
        for a, f in arms.items():
            w = stacked[d][a]
            if len(w):
                z = f(x)
                made.append(z @ w[:, :-1].T + w[:, -1])
        return np.hstack(made)

    return order, run


def _scores(val: DataFrame, study: dict[Key, dict], chosen: dict[Key, list[float]], arms: Arms) -> dict[tuple[Key, float], float]:
    """Question-mean Brier of many heads in one pass: tasks send sums of squared errors by question."""
    order, predict = _predictor(study, chosen, arms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            domain, question = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(1).to_pylist(), object)
            x, y = matrix(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False)
            out = []
            for d in sorted(set(domain) & set(order)):
                at = np.flatnonzero(domain == d)
                e = (predict(d, x[at]) - y[at][:, None]) ** 2
                asked, own = np.unique(question[at], return_inverse=True)
                sums = np.zeros((len(asked), e.shape[1]))
                np.add.at(sums, own, e)
                out += zip([d] * len(asked), asked.tolist(), np.bincount(own).tolist(), sums.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64())))], ["d", "q", "n", "e"])

    rows = val.select("domain", "question", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"))
    part = rows.mapInArrow(run, "d string, q string, n long, e array<double>").select("d", "q", "n", F.posexplode("e").alias("at", "e"))
    per = part.groupBy("d", "q", "at").agg((F.sum("e") / F.sum("n")).alias("e")).groupBy("d", "at").agg(F.avg("e").alias("e"))
    return {order[r["d"]][r["at"]]: r["e"] for r in per.collect()}  # a number a head


def evaluate_study(test: DataFrame, study: dict[Key, dict], arms: Arms) -> DataFrame:
    """E5: (domain, seed, arm, budget, epsilon, metrics) of the selected heads in one pass over test rows."""
    order, predict = _predictor(study, {k: [s["best"]] for k, s in study.items()}, arms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            domain = np.array(batch.column(0).to_pylist(), object)
            for d in sorted(set(domain) & set(order)):
                at = np.flatnonzero(domain == d)
                values = predict(d, matrix(batch.column(2))[at])
                ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * values.shape[1])
                kept = [batch.column(i).take(pa.array(at)) for i in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(ends, pa.array(values.reshape(-1)))], ["d", "question", "y", "values"])

    rows = test.select("domain", "question", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"))
    long = rows.mapInArrow(run, "d string, question string, y double, values array<double>").select("d", "question", "y", F.posexplode("values").alias("at", "value"))
    scored = metrics.prediction_metrics(long, ["d", "at"])
    known = [(d, i, *k, e, study[k]["scores"][e], study[k]["n"]) for d, hs in order.items() for i, (k, e) in enumerate(hs)]
    named = test.sparkSession.createDataFrame(known, "d string, at int, domain string, seed int, arm string, budget int, epsilon double, val_brier double, train_rows long")
    return scored.join(F.broadcast(named), ["d", "at"]).drop("d", "at")  # a row a head


def study_tables(spark, study: dict[Key, dict]) -> dict[str, DataFrame]:
    """A study as tables to lock: ``selection`` (domain, seed, arm, budget, epsilon, val_brier, train_rows) and ``heads``
    (the same keys, weights of the selected penalty)."""
    key = "domain string, seed int, arm string, budget int"
    chosen = [(*k, float(s["best"]), float(s["scores"][s["best"]]), int(s["n"])) for k, s in study.items()]
    weights = [(*k, s["weights"][s["best"]].tolist()) for k, s in study.items()]
    return {
        "selection": spark.createDataFrame(chosen, f"{key}, epsilon double, val_brier double, train_rows long"),
        "heads": spark.createDataFrame(weights, f"{key}, weights array<double>"),
    }


def from_tables(tables: dict[str, DataFrame]) -> dict[Key, dict]:
    """What ``evaluate_study`` needs of a study, from its tables (a row a head)."""
    key = ["domain", "seed", "arm", "budget"]
    rows = tables["selection"].join(tables["heads"], key).collect()
    return {
        tuple(r[c] for c in key): {"best": r["epsilon"], "scores": {r["epsilon"]: r["val_brier"]}, "weights": {r["epsilon"]: np.array(r["weights"])}, "n": r["train_rows"]}
        for r in rows
    }
