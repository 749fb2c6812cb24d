"""Paired comparison of runs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations
from math import ceil, exp, factorial
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuefit.operators.curate import ranked


def pairing_problems(runs: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, problem): expected (id, ground_truth) that a run lacks, and rows of a run that nobody expects."""
    names = runs.select(*by).distinct().collect()  # a row a run
    if not names:
        return runs.select(*by, "id", F.lit(None).cast("string").alias("problem")).limit(0)
    each = F.array(*(F.struct(*(F.lit(r[c]).cast(runs.schema[c].dataType).alias(c) for c in by)) for r in names))
    grid = expected.select("id", "ground_truth", F.inline(each))
    have = runs.select(*by, "id", "ground_truth").withColumn("have", F.lit(True))
    both = grid.withColumn("want", F.lit(True)).join(have, [*by, "id", "ground_truth"], "full_outer")
    return both.where("have is null or want is null").select(*by, "id", F.when(F.col("have").isNull(), "missing").otherwise("unexpected").alias("problem"))


def base_score_conflicts(runs: DataFrame) -> DataFrame:
    """Ids whose base scores differ between runs."""
    return runs.groupBy("id").agg(F.min("score").alias("low"), F.max("score").alias("high")).where("low <> high")


def feature_conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Prefixes that only one table has, or with another label."""
    key = ["question", "response", "position"]
    x = a.select(*key, F.col("y").alias("ya"), F.lit(True).alias("a"))
    y = b.select(*key, F.col("y").alias("yb"), F.lit(True).alias("b"))
    problem = F.when(F.col("a").isNull(), "only_second").when(F.col("b").isNull(), "only_first").when(~F.col("ya").eqNullSafe(F.col("yb")), "label")
    return x.join(y, key, "full_outer").select(*key, problem.alias("problem")).where("problem is not null")


def combine_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two representations of the same prefixes side by side."""
    key = ["question", "response", "position"]
    return a.join(b.select(*key, F.col("x").alias("x2")), key).withColumn("x", F.concat("x", "x2")).drop("x2")


def differences(df: DataFrame, methods: list[str], keys=("seed", "id"), score: str = "score") -> DataFrame:
    """(keys, pair, delta) of all pairs of methods, from one pivot."""
    wide = df.groupBy(*keys).pivot("method", methods).agg(F.avg(score))
    pairs = [F.struct(F.lit(f"{a}-{b}").alias("pair"), (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("delta")) for a, b in combinations(methods, 2)]
    return wide.select(*keys, F.inline(F.array(*pairs))).where("delta is not null")


def draw_hash(*parts: Column | str | int) -> Column:
    """52 bits that seed, draw and whatever else name, the same in any engine."""
    named = (p if isinstance(p, Column) else F.lit(p) for p in parts)
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(c.cast("string") for c in named))), 1, 13), 16, 10).cast("long")


#: places of a block, and slots that a task counts before it hands their counts on
BLOCK, SLOTS = 1 << 14, 1 << 22


def _counted(slots: DataFrame) -> DataFrame:
    """(block, draw, counts) of rows (draw, place): how often each place of a block is taken, a byte a place.

    Slots of a draw lie together, so a task counts ``SLOTS`` of a draw at a time; a place taken more than 255 times has its
    rest in further rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw, held, n = None, [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            places = np.concatenate(held)
            places.sort()
            blocks = places // BLOCK
            cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
            made: list[tuple[int, bytes]] = []
            for i, j in zip(cuts, np.append(cuts[1:], len(places))):
                counts = np.bincount(places[i:j] % BLOCK, minlength=BLOCK)
                while counts.any():
                    made.append((int(blocks[i]), zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)))
                    counts = np.maximum(counts - 255, 0)
            for i in range(0, len(made), 256):
                some = made[i : i + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in some], pa.int64()), pa.array([draw] * len(some), pa.int64()), pa.array([c for _, c in some], pa.binary())],
                    ["block", "draw", "counts"],
                )

        for batch in batches:
            draws, places = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, draws[1:] != draws[:-1])) if len(draws) else []
            for i, j in zip(cuts, np.append(cuts[1:], len(draws))):
                if n and (draws[i] != draw or n >= SLOTS):
                    yield from emit()
                    held, n = [], 0
                draw = int(draws[i])
                held.append(places[i:j])
                n += j - i
        if n:
            yield from emit()

    return slots.mapInArrow(run, "block long, draw long, counts binary")


def bootstrap_draws(delta: DataFrame, draws: int, seed: int, partitions: int | None = None) -> DataFrame:
    """Means over resampled seeds and questions of (seed, id, delta), a row (draw, value) a draw.

    A slot of a draw takes the question at a hashed place of their order, so the result depends on no partitioning and is
    the same in SQL.  Slots are hashed and counted where they are made; only counts, by draw and block of places, move to
    the block's deltas, and sums by draw and seed from there.  Work grows with draws times questions, what moves with under
    a byte for each.  Each seed has to have each question, else it is an error.
    """
    by_seed = F.transform(F.array_sort(F.collect_list(F.struct("seed", "delta"))), lambda x: x["delta"])  # as long as there are runs
    per = ranked(delta.groupBy("id").agg(by_seed.alias("deltas")), "id", out="place")
    q, least, most = per.agg(F.count(F.lit(1)), F.min(F.size("deltas")), F.max(F.size("deltas"))).first()
    if not q or least != most or most != delta.agg(F.count_distinct("seed")).first()[0]:
        raise ValueError("runs are not paired")
    partitions = partitions or int(max(16, min(2000, draws * q // SLOTS)))
    slots = delta.sparkSession.range(0, draws * q, 1, partitions).select(F.floor(F.col("id") / q).alias("draw"), F.pmod("id", F.lit(q)).alias("slot"))
    taken = _counted(slots.select("draw", (draw_hash(seed, "q", F.col("draw"), F.col("slot")) % q).alias("place")))

    def block_sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        d = np.zeros((BLOCK, most))
        d[right["place"].to_numpy() % BLOCK] = np.stack(right["deltas"].to_numpy()) if len(right) else 0
        sums = [np.frombuffer(zlib.decompress(c), np.uint8).astype(float) @ d for c in left["counts"]]
        return pd.DataFrame({"draw": left["draw"], "s": sums})

    blocks = per.select(F.floor(F.col("place") / BLOCK).alias("block"), "place", "deltas")
    parts = taken.groupBy("block").cogroup(blocks.groupBy("block")).applyInPandas(block_sums, "draw long, s array<double>")
    sums = parts.groupBy("draw").agg(F.array(*(F.sum(F.get("s", F.lit(k))) for k in range(most))).alias("sums"))
    seeds = (F.get("sums", (draw_hash(seed, "s", F.col("draw"), k) % most).cast("int")) for k in range(most))
    return sums.select("draw", (reduce(add, seeds) / F.lit(float(most * q))).alias("value"))


def poisson_levels() -> list[float]:
    """The shares of a Poisson number of mean 1 that are 0, at most 1, at most 2, ... as far as 52 bits tell them apart."""
    return list(accumulate(exp(-1) / factorial(k) for k in range(18)))


def poisson_draws(df: DataFrame, draws: int, seed: int, value: str = "delta", ident: str = "id") -> DataFrame:
    """A22 for any number of questions: each draw weights a question by a Poisson number that depends on seed, draw and id.

    Null values weigh nothing; a draw that weights no question has a null value.  Questions are few bytes but ``draws`` hashes
    each, so they are dealt to all cores before that.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    dealt = df.where(F.col(value).isNotNull()).select(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")).alias("i"), F.col(value).cast("double").alias("v"))
    rows = dealt.repartition(max(16, 4 * cores), "i").select("i", "v", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    # hex digits compare like the 52 bits of draw_hash that they name; a level that rounds to 1 is never reached
    levels = [f"{n:013x}" for c in poisson_levels() if (n := ceil(c * 2**52)) < 2**52]
    weight = reduce(lambda w, kc: w.when(F.col("h") < kc[1], kc[0]), enumerate(levels[1:], 1), F.when(F.col("h") < levels[0], 0)).otherwise(len(levels))
    rows = rows.select("draw", "v", F.md5(F.concat_ws(":", "i", F.col("draw").cast("string"))).alias("h")).select("draw", "v", weight.alias("w"))
    return rows.groupBy("draw").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0))).alias("value"))


def interval(draws: DataFrame, mean: float | None = None, comparisons: int = 1, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Exact quantiles at 0.05 / (2 m) in each tail."""
    tail = 0.05 / (2 * comparisons)
    q = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    out = draws.groupBy(*(by or [])).agg(F.get(q, F.lit(0)).alias("low"), F.get(q, F.lit(1)).alias("high"))
    return out if mean is None else out.withColumn("mean", F.lit(float(mean)))


def reverse_interval(df: DataFrame) -> DataFrame:
    """The interval of the opposite difference."""
    return df.withColumns({"low": -F.col("high"), "high": -F.col("low"), **({"mean": -F.col("mean")} if "mean" in df.columns else {})})


def compare(df: DataFrame, a: str, b: str, draws: int = 4000, seed: int = 2026, comparisons: int = 1) -> DataFrame:
    """Mean difference of two methods and its interval over seeds and questions; the pairing has to be complete."""
    delta = differences(df.where(F.col("method").isin(a, b)), [a, b])
    return interval(bootstrap_draws(delta, draws, seed), delta.agg(F.avg("delta")).first()[0], comparisons)


def seed_statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation over seeds."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("seeds"))
