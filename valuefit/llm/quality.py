"""Quality classifier: a byte-level convolutional network in numpy.

A text is a row of bytes, in steps of eight.  Each byte is embedded, and each step also tells how many of its bytes
repeat the byte some way back.  Learned filters look at windows of four steps, overlapping by three; chunks of 64
windows share their edges' bytes, and together they cover the whole text.  Filters are max-pooled in each chunk; the
largest and the mean of the chunks' values are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, read_table
from .kernels import chunks
from .toxicity import fold

STEP, TAPS, CHUNK = 8, 4, 64
LAGS = range(2, 26)
EMBED, FILTERS = 6, 24
#: bytes of the texts that are scored together, and of a text that is scored in parts
LONG = 1 << 18
WIDTH = STEP * EMBED + len(LAGS)


class Steps:
    """Texts laid out in steps, each followed by empty steps so that no window meets two texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        self.steps = np.maximum(-(-size // STEP), 1)
        first = np.cumsum(self.steps + TAPS) - (self.steps + TAPS) + TAPS
        total = int((self.steps + TAPS).sum()) + TAPS
        flat = np.zeros(total * STEP, np.uint8)
        to = np.repeat(first * STEP - offsets[:-1], size) + np.arange(len(data))
        flat[to] = data
        self.bytes = flat.reshape(total, STEP)
        real = (flat != 0).view(np.uint64)
        self.repeat = np.empty((total, len(LAGS)), np.float32)
        same = np.zeros(len(flat), bool)
        for k, lag in enumerate(LAGS):
            np.equal(flat[lag:], flat[:-lag], out=same[lag:])
            self.repeat[:, k] = np.bitwise_count(same.view(np.uint64) & real)
        self.repeat /= STEP
        # windows start at each step of a text; chunks are runs of windows
        self.at = np.repeat(first - (np.cumsum(self.steps) - self.steps), self.steps) + np.arange(self.steps.sum())
        per = -(-self.steps // CHUNK)
        self.per = per
        inner = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        self.chunk = np.repeat(np.cumsum(self.steps) - self.steps, per) + inner * CHUNK
        self.doc = np.cumsum(per) - per


def start(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "e": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "w": rng.normal(0, 1 / np.sqrt(TAPS * WIDTH), (TAPS, WIDTH, FILTERS)).astype(np.float32),
        "b": np.zeros(FILTERS, np.float32),
        "v": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "c": np.zeros(1, np.float32),
    }


def forward(s: Steps, p: dict[str, np.ndarray]):
    x = np.concatenate([p["e"][s.bytes].reshape(len(s.bytes), -1), s.repeat], axis=1)
    z = np.zeros((len(x) - TAPS + 1, FILTERS), np.float32)
    for t in range(TAPS):
        z += x[t : t + len(z)] @ p["w"][t]
    z = np.maximum(z[s.at] + p["b"], 0)
    top = np.maximum.reduceat(z, s.chunk, axis=0)
    largest = np.maximum.reduceat(top, s.doc, axis=0)
    mean = np.add.reduceat(top, s.doc, axis=0) / s.per[:, None]
    pooled = np.concatenate([largest, mean], axis=1)
    return x, z, top, pooled, pooled @ p["v"] + p["c"][0]


def forward_long(data: np.ndarray, p: dict[str, np.ndarray], chunks_: int = 512) -> np.ndarray:
    """``forward``'s logit of one text, ``chunks_`` chunks at a time, so that memory does not grow with the text."""
    n, before = max(-(-len(data) // STEP), 1), -(-LAGS[-1] // STEP)
    largest, total, count = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS), 0
    for first in range(0, n, chunks_ * CHUNK):
        last, low = min(first + chunks_ * CHUNK, n), max(first - before, 0)
        part = data[low * STEP : (last + TAPS - 1) * STEP]  # with the bytes that lags and windows reach
        z = forward(Steps(part, np.array([0, len(part)])), p)[1][first - low : last - low]
        top = np.maximum.reduceat(z, np.arange(0, len(z), CHUNK), axis=0)
        largest, total, count = np.maximum(largest, top.max(0)), total + top.sum(0), count + len(top)
    return np.concatenate([largest, (total / count).astype(np.float32)]) @ p["v"] + p["c"][0]


def predict(data: np.ndarray, offsets: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    if len(offsets) == 2 and len(data) > LONG:
        logit = np.array([forward_long(data, p)])
    else:
        logit = forward(Steps(data, offsets), p)[4]
    return 1 / (1 + np.exp(-np.clip(logit.astype(float), -30, 30)))


def gradients(s: Steps, y: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    x, z, top, pooled, logit = forward(s, p)
    d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)).astype(np.float32)
    g = {"v": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
    dp = d[:, None] * p["v"][None]
    owner = np.repeat(np.arange(len(s.per)), s.per)
    dtop = (dp[:, FILTERS:] / s.per[:, None])[owner]
    best = (top == pooled[owner, :FILTERS]) & (top > 0)
    share = np.maximum(np.add.reduceat(best.astype(np.float32), s.doc, axis=0), 1)
    dtop = (dtop + best * (dp[:, :FILTERS] / share)[owner]) * (top > 0)
    # of each chunk and filter only the window with the largest value has a gradient
    chunk = np.repeat(np.arange(len(s.chunk)), np.diff(np.append(s.chunk, len(z))))
    hit, f = np.nonzero((z == top[chunk]) & (z > 0))
    key = chunk[hit] * FILTERS + f
    _, one = np.unique(key, return_index=True)
    hit, f = hit[one], f[one]
    value = dtop[chunk[hit], f]
    live = np.abs(value) > 1e-7
    at, f, value = s.at[hit[live]], f[live], value[live]
    g["b"] = np.bincount(f, value, FILTERS).astype(np.float32)
    g["w"], g["e"] = np.zeros_like(p["w"]), np.zeros_like(p["e"])
    for t in range(TAPS):
        part = x[at + t] * value[:, None]
        for k in range(FILTERS):
            g["w"][t, :, k] = part[f == k].sum(0)
        back = (p["w"][t].T[f, : STEP * EMBED] * value[:, None]).reshape(-1, EMBED)
        letters = s.bytes[at + t].reshape(-1)
        for k in range(EMBED):
            g["e"][:, k] += np.bincount(letters, back[:, k], 256).astype(np.float32)
    return g


def train(texts: list[bytes], y: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 0.01, seed: int = 0) -> dict[str, np.ndarray]:
    """Adam on the mean log loss."""
    p = start(seed)
    if len(texts) == 0 or y.min() == y.max():
        p["v"][:] = 0
        p["c"][0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0
        return p
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    n, steps = 0, epochs * -(-len(texts) // batch)
    p["c"][0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            offsets = np.cumsum([0, *(len(texts[r]) for r in rows)])
            s = Steps(np.frombuffer(b"".join(texts[r] for r in rows), np.uint8), offsets)
            n += 1
            now = rate * (1 - n / (steps + 1)) + 1e-4
            for k, g in gradients(s, y[rows].astype(np.float32), p).items():
                g = g + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] = p[k] - now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
    return p


def _score(p: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2), LONG):
                score = predict(data, offsets, p)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), pa.array(score)], ["r1", "r2", "score"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 2000, longest: int = 1 << 16, broadcast_rows: int = 2_000_000) -> dict[str, np.ndarray]:
    """The network, trained on at most ``sample`` labelled texts, drawn by hash.

    A text of more than ``longest`` characters is learnt from in parts of that length, each with its label, which count as
    texts of the sample.  Rows with a null id or text, unlabelled rows and rows of fold 2 are not learnt from; a doc_id labelled twice counts
    as good only if all its labels say so.  Without labels of both classes the network gives their share.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.where(fold(F.col("doc_id")) != 2).select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality_label"))
    n = marks.count()
    share = min(1.0, sample / max(1, n))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    drawn = docs.select(F.col("doc_id").cast("long"), "text").join(maybe_broadcast(marks, min(n, sample), broadcast_rows), "doc_id")
    count = F.greatest(F.floor((F.length("text") - 1) / longest), F.lit(0)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count), lambda i: F.substr("text", i * longest + 1, F.lit(longest)))
    drawn = drawn.where("text is not null").select("doc_id", "quality_label", F.posexplode(parts).alias("part", "text"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "part", F.xxhash64("text")).limit(sample).select("text", "quality_label").toArrow()
    texts = [t.encode() for t in drawn.column("text").to_pylist()]
    return train(texts, drawn.column("quality_label").to_numpy().astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; ``labels`` has doc_id and quality (0 or 1).

    ``held_out``: fold 2 of the id's crc32, never learnt from; false for a null id.  The score is a function of the
    whole text's bytes alone, very long ones in parts with the same result; a null text scores as an empty one, an empty
    table gives an empty result.  Repeated rows come back as often as they came; other columns are not read, so names
    cannot clash.
    """
    p = fit_quality(docs, labels, **fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score(p)(batches)

    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    scored = docs.select(F.col("doc_id").cast("long").alias("r1"), held.alias("r2"), "text").mapInArrow(run, "r1 long, r2 boolean, score double")
    return scored.select(
        F.col("r1").alias("doc_id"), F.col("r2").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, that the network predicts to be good; see ``score_quality``.

    Null and empty texts are judged like any other, repeated rows stay or go together.
    """
    p = fit_quality(docs, labels, **fit)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [predict(data, offsets, p) for _, _, data, offsets in chunks(batch.column(at), LONG)]
            if score:
                yield batch.filter(pa.array(np.concatenate(score) >= threshold))

    return docs.mapInArrow(run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op5_quality": op5_quality}
