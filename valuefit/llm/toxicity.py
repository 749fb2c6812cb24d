"""Toxicity by class-conditional Kneser-Ney language models over words.

For a class c (ordinary or toxic), a word w after a word v, and D(n) = min(n, D), the discount of a count n:

    P_c(w | v) = (n_c(v w) - D(n_c(v w)) + sum over words x of D(n_c(v x)) * P_c(w)) / n_c(v)
    P_c(w)     = (k_c(w) - D(k_c(w)) + sum over words x of D(k_c(x)) * P_c(s) * n(w) / n(s)) / K_c
    P_c(s)     = (k_c(s) - D(k_c(s)) + sum over stems x of D(k_c(x)) * P(s)) / K_c
    P(s)       = n(s) / all words

n_c are counts in the class's documents; k_c(w) is the continuation count, the number of distinct words that w follows
in them, k_c(s) that of the distinct pairs of words that end in a word of the stem s (its first bytes), K_c their sum;
n(w) and n(s) are counts over all documents, labelled or not, which both classes share.  Each of the four sums to 1.  Discounts are larger than the usual ones below 1: a share of the labels is wrong and documents come in copies, so
what a class shows a few times goes to the shared counts, where it favours neither class.  Both classes are compared at
the highest order that both know: P_c(w | v) where each has seen v at least ``both`` times, else P_c(w).

A document's words have the mean log-ratio of the two likelihoods, over the whole text, over its best run of words and
over its most telling words; few words may make a long text toxic, so the whole text's mean alone would drown them.

Counts are rows keyed by 64-bit hashes, of which the upper half is that of the stem, exact, and grow with the corpus.
Pairs are dealt by their second word and a salt of the first, so that continuation counts need no further shuffle of them.
  Words that neither class shows often enough
have the same ratio, so the table of ratios is much smaller than the counts; it goes to the executors if its counted
bytes fit a bound, else lots of documents ask for their own distinct keys in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, maybe_broadcast, read_table
from .kernels import ALNUM, U, Words, chunks, mix, slices

WORD_DISCOUNT, STEM_DISCOUNT, PAIR_DISCOUNT, BOTH, STEM_BYTES = 4, 8, 8, 1000, 6
WORD, STEM, CONTEXT, PAIR = range(4)
START = U(0x2545F4914F6CDD1D)
WINDOW, TOP = 8, (2, 3)
FEATURES = 2 + len(TOP)
#: rows of the memory-bounded tables of partial counts, bytes of text of a lot, bytes of a row of ratios
WORD_ROWS, PAIR_ROWS, LOT, RATIO_BYTES = 1 << 19, 1 << 17, 1 << 24, 16


def keys_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The key of the word before each word, and of each word; a text's first word follows the start."""
    stems = slices(words.data, words.start, np.minimum(words.end, words.start + STEM_BYTES))
    w = stems >> U(32) << U(32) | words.hash >> U(32)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    first = words.first[:-1]
    v[first[first < len(v)]] = START
    return v, w


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Values added by key, in the order of the keys; keys and values are lists of columns."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


class _Partial:
    """Counts by key, added up before they leave a task whenever ``most`` rows have come together."""

    def __init__(self, names: list[str], n_keys: int, most: int):
        self.names, self.n_keys, self.most, self.parts, self.rows = names, n_keys, most, [], 0

    def add(self, keys: list[np.ndarray], values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, values = _summed(keys, values)
        self.parts.append((*keys, *values))
        self.rows += len(keys[0])
        if self.rows >= 2 * self.most:
            self.fold()
            if self.rows >= self.most:
                yield from self.flush()

    def fold(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        keys, values = _summed(columns[: self.n_keys], columns[self.n_keys :])
        self.parts, self.rows = [(*keys, *values)], len(keys[0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.fold()
            columns = self.parts[0]
            for i in range(0, self.rows, 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)].view(np.int64)) for c in columns], self.names)
        self.parts, self.rows = [], 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _Partial(["a", "n"], 1, WORD_ROWS)
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            words = Words(data, offsets, ALNUM)
            yield from found.add([keys_of(words)[1]], [np.ones(len(words.hash), np.int64)])
    yield from found.flush()


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _Partial(["v", "w", "n0", "n1"], 2, PAIR_ROWS)
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, _, data, offsets in chunks(batch.column(0)):
            words = Words(data, offsets, ALNUM)
            y = toxic[a + words.doc]
            yield from found.add([*keys_of(words)], [1 - y, y])
    yield from found.flush()


def ratios(
    docs: DataFrame, marks: DataFrame, scratch: Scratch, word_discount: int = WORD_DISCOUNT, stem_discount: int = STEM_DISCOUNT,
    pair_discount: int = PAIR_DISCOUNT, both: int = BOTH,
) -> tuple[DataFrame, float]:
    """Rows (kind, a, b, r) of log-ratios, toxic to ordinary, and the ratio of words without a row.

    Words (a) have log P_1(w) / P_0(w); stems (a) that of their words without a row; pairs (a, b) log P_1(b | a) /
    P_0(b | a); contexts (a) that both classes know what a word after them gets besides its own ratio if the pair has
    no row.  ``marks``: (doc_id, toxic).
    """
    shared = docs.select("text").mapInArrow(_count_words, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    shared = scratch.keep(shared, "shared")
    # a context that both classes know is a word of at least so many occurrences
    known = scratch.keep(shared.where(F.col("n") >= 2 * both).select(F.col("a").alias("v"), F.lit(True).alias("known")), "known")
    train = docs.select(F.col("doc_id").cast("long"), "text").join(marks, "doc_id").select("text", "toxic")
    pairs = train.mapInArrow(_count_pairs, "v long, w long, n0 long, n1 long")
    salts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a hot second word may fill all tasks, however many
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts))).repartition("w", "salt").groupBy("w", "salt", "v").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    pairs = pairs.join(maybe_broadcast(known, known.count(), 2_000_000), "v", "left")
    row = lambda kind, a, b, *x: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), *(v.cast("long").alias(n) for v, n in zip(x, ("x0", "x1", "d0", "d1"))))
    none, n = F.lit(0).cast("long"), [F.col("n0"), F.col("n1")]
    kept = F.col("known") & ((F.col("n0") > pair_discount) | (F.col("n1") > pair_discount))
    counted = F.array(
        row(WORD, F.col("w"), none, *(x > 0 for x in n), none, none),
        F.when(F.col("known"), row(CONTEXT, F.col("v"), none, *n, *(F.least(x, F.lit(pair_discount)) for x in n))),
        F.when(kept, row(PAIR, F.col("v"), F.col("w"), *n, none, none)),
    )
    counts = pairs.select(F.inline(F.array_compact(counted))).groupBy("kind", "a", "b").agg(*(F.sum(c).alias(c) for c in ("x0", "x1", "d0", "d1")))
    counts = scratch.keep(counts.where((F.col("kind") != CONTEXT) | ((F.col("x0") >= both) & (F.col("x1") >= both))), "counts")
    k = counts.where(F.col("kind") == WORD).agg(F.sum("x0"), F.sum("x1")).first()
    k0, k1 = (float(x or 0) for x in k)
    if k0 == 0 or k1 == 0:
        return docs.sparkSession.createDataFrame([], "kind int, a long, b long, r double"), 0.0
    stem = F.shiftrightunsigned("a", 32)
    words = counts.where(F.col("kind") == WORD).select("a", "x0", "x1")
    by_stem = shared.groupBy(stem.alias("s")).agg(F.sum("n").alias("n_s")).join(words.groupBy(stem.alias("s")).agg(F.sum("x0").alias("s0"), F.sum("x1").alias("s1")), "s", "left")
    by_stem = scratch.keep(by_stem.na.fill(0, ["s0", "s1"]), "stems")
    least = lambda frame, c, d: [F.sum(F.least(F.col(f"{c}{i}"), F.lit(d))) for i in (0, 1)]
    l0, l1 = (float(x) for x in words.agg(*least(words, "x", word_discount)).first())
    total, m0, m1 = (float(x) for x in by_stem.agg(F.sum("n_s"), *least(by_stem, "s", stem_discount)).first())
    of_class = lambda x, d, k, l, p: (F.greatest(F.col(x) - d, F.lit(0)) + F.lit(l) * p) / F.lit(k)
    shares = (of_class(f"s{i}", stem_discount, k, m, F.col("n_s") / F.lit(total)).alias(f"q{i}") for i, (k, m) in enumerate(((k0, m0), (k1, m1))))
    by_stem = by_stem.select("s", "n_s", "s0", "s1", *shares)
    words = words.join(shared, "a").withColumn("s", stem).join(by_stem, "s")
    backed = ((k, l, F.col(f"q{i}") * F.col("n") / F.col("n_s")) for i, (k, l) in enumerate(((k0, l0), (k1, l1))))
    words = words.select("a", "x0", "x1", *(of_class(f"x{i}", word_discount, *x).alias(f"p{i}") for i, x in enumerate(backed)))
    rest = float(np.log(l1 / k1 * k0 / l0))
    telling = words.where((F.col("x0") > word_discount) | (F.col("x1") > word_discount))
    of_stem = by_stem.where((F.col("s0") > stem_discount) | (F.col("s1") > stem_discount))
    contexts = counts.where(F.col("kind") == CONTEXT)
    given = lambda c: (F.greatest(F.col(f"n{c}") - pair_discount, F.lit(0)) + F.col(f"d{c}") * F.col(f"p{c}")) / F.col(f"x{c}")
    twos = counts.where(F.col("kind") == PAIR).select(F.col("a").alias("v"), F.col("b").alias("a"), F.col("x0").alias("n0"), F.col("x1").alias("n1"))
    twos = twos.join(contexts.select(F.col("a").alias("v"), "x0", "x1", "d0", "d1"), "v").join(words.select("a", "p0", "p1"), "a")
    out = (
        telling.select(F.lit(WORD).alias("kind"), "a", none.alias("b"), F.ln(F.col("p1") / F.col("p0")).alias("r"))
        .unionByName(of_stem.select(F.lit(STEM).alias("kind"), F.col("s").alias("a"), none.alias("b"), (F.ln(F.col("q1") / F.col("q0")) + rest).alias("r")))
        .unionByName(contexts.select("kind", "a", "b", F.ln(F.col("d1") / F.col("x1") * F.col("x0") / F.col("d0")).alias("r")))
        .unionByName(twos.select(F.lit(PAIR).alias("kind"), F.col("v").alias("a"), F.col("a").alias("b"), F.ln(given(1) / given(0)).alias("r")))
    )
    return scratch.keep(out, "ratios"), rest + float(np.log(m1 / k1 * k0 / m0))


def key_of(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(w * U(3) + v * U(0x9E3779B97F4A7C15))


class Ratios:
    """Log-ratios of some keys, looked up by sorted hashes."""

    def __init__(self, default: float, kind: np.ndarray, a: np.ndarray, b: np.ndarray, r: np.ndarray):
        self.default = default
        a, b = (np.ascontiguousarray(x).view(U) for x in (a, b))
        self.tables = []
        for k in (WORD, STEM, CONTEXT, PAIR):
            of = kind == k
            key = key_of(a[of], b[of]) if k == PAIR else a[of]
            order = np.argsort(key)
            self.tables.append((key[order], r[of][order].astype(np.float32)))

    def get(self, kind: int, key: np.ndarray) -> np.ndarray:
        """NaN for keys without a row."""
        keys, r = self.tables[kind]
        if len(keys) == 0:
            return np.full(len(key), np.nan, np.float32)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, r[at], np.float32(np.nan))

    def of(self, words: Words) -> np.ndarray:
        """The log-ratio of each word."""
        v, w = keys_of(words)
        out = self.get(WORD, w)
        none = np.isnan(out)
        out[none] = self.get(STEM, w[none] >> U(32))
        out[np.isnan(out)] = self.default
        more = self.get(CONTEXT, v)
        some = np.flatnonzero(~np.isnan(more))
        if len(some):
            pair = self.get(PAIR, key_of(v[some], w[some]))
            out[some] = np.where(np.isnan(pair), more[some] + out[some], pair)
        return out


def features(words: Words, m: Ratios) -> np.ndarray:
    """For each text the mean log-ratio of all its words, of its best run of words and of its most telling words."""
    out = np.zeros((words.n_docs, FEATURES))
    if len(words.hash) == 0:
        return out
    ratio = m.of(words).astype(float)
    size = np.diff(words.first)
    some = np.flatnonzero(size)
    a, b = words.first[:-1][some], words.first[1:][some]
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    out[some, 0] = out[some, 1] = (sums[b] - sums[a]) / size[some]
    long_ = np.flatnonzero(size[some] > WINDOW)
    if len(long_):
        mean = np.full(len(ratio), -np.inf)
        ok = words.doc[: len(ratio) - WINDOW + 1] == words.doc[WINDOW - 1 :]
        mean[: len(ok)][ok] = ((sums[WINDOW:] - sums[:-WINDOW]) / WINDOW)[ok]
        out[some[long_], 1] = np.maximum.reduceat(mean, a)[long_]
    order = np.lexsort((-ratio, words.doc))
    best = np.concatenate([[0.0], np.cumsum(ratio[order])])
    for k, n in enumerate(TOP, 2):
        out[some, k] = (best[a + np.minimum(n, size[some])] - best[a]) / n
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 40) -> dict[str, np.ndarray]:
    """A logistic model whose labels may be flipped, each way at a rate of its own, by expectation maximisation."""
    flip = np.array([0.05, 0.05])
    if len(x) == 0 or y.min() == y.max():
        base = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
        return {"mean": np.zeros(x.shape[1]), "scale": np.ones(x.shape[1]), "w": np.append(np.zeros(x.shape[1]), base), "flip": np.zeros(2)}
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    w[-2], w[-1] = 2, -2
    sigmoid = lambda: 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    for _ in range(rounds):
        p = sigmoid()
        yes, no = np.where(y == 1, 1 - flip[1], flip[1]), np.where(y == 1, flip[0], 1 - flip[0])
        q = p * yes / (p * yes + (1 - p) * no)
        for _ in range(4):
            p = sigmoid()
            w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (q - p) - ridge * w)
        flip = np.array([((1 - q) * y).sum() + 1, (q * (1 - y)).sum() + 1]) / np.array([(1 - q).sum() + 20, q.sum() + 20])
    return {"mean": mean, "scale": scale, "w": w, "flip": flip}


def probability(x: np.ndarray, fit: dict[str, np.ndarray]) -> np.ndarray:
    z = (x - fit["mean"]) / fit["scale"] @ fit["w"][:-1] + fit["w"][-1]
    return fit["flip"][0] + (1 - fit["flip"].sum()) / (1 + np.exp(-np.clip(z, -30, 30)))


FEATURED = "doc_id long, x array<double>"
ROWS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _featured(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES)
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], ["doc_id", "x"])


def _with(model):
    """Features of rows (doc_id, text), by ratios that Spark has brought to the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Ratios(*model.value)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                yield _featured(batch.column(0).slice(a, b - a), features(Words(data, offsets, ALNUM), m))

    return run


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in lots of about ``LOT`` bytes of text, each packed as one value."""
    part, n, size, rows = TaskContext.get().partitionId(), 0, 0, []

    def packed() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ROWS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for r in rows:
                out.write_batch(r)
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["lot", "docs"])

    for batch in batches:
        batch = pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in ROWS], schema=ROWS)
        for a, b, data, _ in chunks(batch.column("text")):
            if rows and size + len(data) > LOT:
                yield packed()
                n, size, rows = n + 1, 0, []
            rows.append(batch.slice(a, b - a))
            size += len(data)
    if rows:
        yield packed()


def _unpacked(docs: bytes) -> Iterator[tuple[pa.Array, Words]]:
    for batch in pa.ipc.open_stream(docs):
        for a, b, data, offsets in chunks(batch.column("text")):
            yield batch.column("doc_id").slice(a, b - a), Words(data, offsets, ALNUM)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words, contexts and pairs of each lot."""
    for batch in batches:
        for lot, docs in zip(batch.column("lot"), batch.column("docs")):
            found: dict[int, list] = {WORD: [], STEM: [], CONTEXT: [], PAIR: []}
            for _, words in _unpacked(docs.as_py()):
                v, w = keys_of(words)
                for kind, keys in ((WORD, [w]), (STEM, [w >> U(32)]), (CONTEXT, [v]), (PAIR, [v, w])):
                    found[kind].append(_summed(keys, [])[0])
            for kind, parts in found.items():
                keys, _ = _summed([np.concatenate(c) for c in zip(*parts)], [])
                b = keys[1] if len(keys) > 1 else np.zeros(len(keys[0]), U)
                columns = [np.full(len(b), lot.as_py(), np.int64), np.full(len(b), kind, np.int32), keys[0].view(np.int64), b.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lot", "kind", "a", "b"])


def _answered(default: float):
    def run(lots: pa.Table, found: pa.Table) -> pa.Table:
        m = Ratios(default, *(found.column(c).to_numpy() for c in ("kind", "a", "b", "r")))
        out = [_featured(ids, features(words, m)) for docs in lots.column("docs") for ids, words in _unpacked(docs.as_py())]
        return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))]))

    return run


def featured(docs: DataFrame, table: DataFrame, default: float, scratch: Scratch, broadcast_bytes: int) -> DataFrame:
    """(doc_id, x) for each row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    if table.count() * RATIO_BYTES <= broadcast_bytes:
        rows = table.toArrow()
        model = docs.sparkSession.sparkContext.broadcast((default, *(rows.column(c).to_numpy() for c in ("kind", "a", "b", "r"))))
        return texts.mapInArrow(_with(model), FEATURED)
    lots = scratch.keep(texts.mapInArrow(_lots, "lot long, docs binary"), "lots")
    answers = lots.mapInArrow(_asked, "lot long, kind int, a long, b long").join(table, ["kind", "a", "b"]).select("lot", "kind", "a", "b", "r")
    return lots.groupBy("lot").cogroup(answers.groupBy("lot")).applyInArrow(_answered(default), FEATURED)


def _score(fit: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probability(x, fit)), pa.array(x[:, 0])], ["doc_id", "score", "log_ratio"])

    return run


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def score_toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, calibration: int = 6000, broadcast_rows: int = 2_000_000, broadcast_bytes: int = 64 << 20
) -> DataFrame:
    """(doc_id, held_out, score, predicted, log_ratio) for each row of ``docs``; ``labels`` has doc_id and toxic (0 or 1).

    Labels are learnt only from rows whose ``fold`` is not 2.  Of fold 3 about ``calibration`` rows at most, drawn by
    hash, turn ratios into probabilities; all others are counted into their class.  The shared counts take all
    documents.  ``log_ratio`` is the difference of the length-normalised log-likelihoods.  Ratios are looked up where
    they fit ``broadcast_bytes``, else joined; the results are the same.

    A null or empty text gets the score of ratios of 0.  Very long texts are read whole, in blocks.  Rows with a null id
    are scored, as not held out, and learn nothing; a doc_id labelled twice is toxic if one label says so; labels other
    than 0 and 1 are ignored.  Repeated rows come back as often as they came, and a labelled row that is there twice
    counts twice; no other column of ``docs`` is read, so names cannot clash.  Equal ratios are ties of no effect.
    Empty tables give an empty result; without labels of both classes all scores are the same.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    docs = docs.select("doc_id", "text")
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(fold(F.col("doc_id")) != 2).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    third = marks.where(fold(F.col("doc_id")) == 3).count()
    share = min(1.0, calibration / max(1, third))
    drawn = (fold(F.col("doc_id")) == 3) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    marks = scratch.keep(marks.select("*", drawn.alias("drawn")), "labels")
    train = marks.where("not drawn").select("doc_id", "toxic")
    table, default = ratios(docs, maybe_broadcast(train, train.count(), broadcast_rows), scratch)
    # about ``calibration`` rows
    some = docs.join(F.broadcast(marks.where("drawn").select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))), F.col("doc_id").cast("long") == F.col("id"))
    some = scratch.keep(some.select("doc_id", "text", "y"), "drawn")
    y_of = some.select(F.col("doc_id").cast("long"), "y").distinct()
    fitted = featured(some, table, default, Scratch(spark, "toxicity"), broadcast_bytes).join(F.broadcast(y_of), "doc_id").select("y", "x").toArrow()
    x = fitted.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES) if fitted.num_rows else np.zeros((0, FEATURES))
    y = fitted.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order in which rows come
    fit = fit_logistic(x[order], y[order])
    scored = featured(docs, table, default, scratch, broadcast_bytes).mapInArrow(_score(fit), "doc_id long, score double, log_ratio double")
    for name in ("shared", "known", "stems", "counts", "labels", "drawn"):
        scratch.drop(name)
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "log_ratio")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
