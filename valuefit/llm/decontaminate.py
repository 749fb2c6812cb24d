"""Benchmark decontamination by winnowing.

Of the hashes of all runs of K words, the least of every window of consecutive runs is kept.  A span of ``window``
words that a document shares with an item holds a whole window of runs, so both keep the same fingerprint in it: every
such span is found.  Fingerprints that meet are extended to all windows of words around them, which an equality join
on the words themselves confirms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table, row_hashes, spare
from .kernels import ALNUM, Words, chunks

K = 5


def winnow(words: Words, window: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the runs of k words that are the least in some window of ``window`` words."""
    span = window - k + 1
    at, grams = words.grams(k)
    m = len(at) - span + 1
    if m <= 0:
        return at[:0], grams[:0]
    whole = at[span - 1 :] - at[:m] == span - 1
    whole &= words.doc[at[:m]] == words.doc[at[span - 1 :]]
    least = grams[:m].copy()
    for i in range(1, span):
        np.minimum(least, grams[i : i + m], out=least)
    kept = np.zeros(len(at), bool)
    for i in range(span):
        kept[i : i + m] |= whole & (grams[i : i + m] == least)
    return at[kept], grams[kept]


def _short_grams(words: Words, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for n in sizes:
        yield (n, *words.grams(n))


def item_windows(window: int):
    """Rows (item_id, win, size, fps): the windows of an item, each with its fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                at, fps = winnow(words, window)
                out: list[list] = [[], [], [], []]
                for d in range(a, b):
                    first, last = int(words.first[d - a]), int(words.first[d - a + 1])
                    n = last - first
                    if n == 0:
                        continue
                    if n < window:
                        found = [(first, n, words.mixed(np.array([first]), n).view(np.int64).tolist())]
                    else:
                        found = []
                        for s in range(first, last - window + 1):
                            lo, hi = np.searchsorted(at, [s, s + window - K + 1])
                            found.append((s, window, fps[lo:hi].view(np.int64).tolist()))
                    for s, size, f in found:
                        for column, v in zip(out, (ids[d], words.text(s, size), size, f)):
                            column.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64()))],
                    ["item_id", "win", "size", "fps"],
                )

    return run


def document_prints(window: int, short: list[int]):
    """Rows (r1, r2, fp): all fingerprints of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1, r2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, _, data, offsets in chunks(batch.column(2)):
                words = Words(data, offsets, ALNUM)
                for at, fps in [winnow(words, window), *(x[1:] for x in _short_grams(words, short))]:
                    rows = a + words.doc[at]
                    yield pa.RecordBatch.from_arrays([pa.array(r1[rows]), pa.array(r2[rows]), pa.array(fps.view(np.int64))], ["r1", "r2", "fp"])

    return run


FOUND = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("win", pa.string())]))


def document_windows(window: int, short: list[int], known: np.ndarray | None):
    """Rows (doc_id, r1, r2, n_words, windows): windows around the fingerprints that items hold too.

    ``known``: the items' fingerprints, sorted; None: each row brings those that it shares, in a column ``fps``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.zeros(1 << 20, bool)
        if known is not None:
            sieve[known & np.uint64((1 << 20) - 1)] = True

        def shared(words: Words, at: np.ndarray, fps: np.ndarray, own: list | None, a: int) -> np.ndarray:
            if own is None:
                maybe = np.flatnonzero(sieve[fps & np.uint64((1 << 20) - 1)])
                return at[maybe[np.isin(fps[maybe], known)]]
            hit = np.zeros(len(at), bool)
            for d in np.unique(words.doc[at]):
                if own[a + d]:
                    lo, hi = np.searchsorted(words.doc[at], [d, d + 1])
                    hit[lo:hi] = np.isin(fps[lo:hi].view(np.int64), own[a + d])
            return at[hit]

        for batch in batches:
            own = None if known is not None else batch.column(4).to_pylist()
            for a, b, data, offsets in chunks(batch.column(3)):
                words = Words(data, offsets, ALNUM)
                starts = []
                hits = shared(words, *winnow(words, window), own, a)
                if len(hits):
                    around = (hits[:, None] - np.arange(window - K + 1)).ravel()
                    around = np.unique(around[(around >= 0) & (around + window <= len(words.doc))])
                    around = around[words.doc[around] == words.doc[around + window - 1]]
                    starts += [(int(s), window) for s in around]
                for n, at, fps in _short_grams(words, short):
                    starts += [(int(s), n) for s in shared(words, at, fps, own, a)]
                found: list[list] = [[] for _ in range(b - a)]
                for s, n in starts:
                    d = int(words.doc[s])
                    found[d].append({"start": s - int(words.first[d]), "size": n, "win": words.text(s, n)})
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(np.diff(words.first)), pa.array(found, FOUND)],
                    ["doc_id", "r1", "r2", "n_words", "windows"],
                )

    return run


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, broadcast_prints: int = 4_000_000, broadcast_windows: int = 200_000, broadcast_bytes: int = 64 << 20
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, r1, r2 (two hashes of doc_id and text), n_words, n_hit, n_items,
    items (array<string>, sorted).

    Words are runs of a-z, 0-9 and non-ASCII characters after A-Z is lower-cased.  A window is ``window`` consecutive
    words of an item; an item of fewer words, but not none, is one window.  A word is hit inside any occurrence of a
    window.  Null and empty texts have no words and no hits; an item without words, or a null item, has no windows;
    without items nothing is hit.  Repeated rows come back as often as they came; items with the same text all
    count; an item without an id adds hits but is not listed.

    The items' fingerprints go to the executors if a count shows that they fit ``broadcast_prints``; more are joined
    with those of the documents by a shuffle.  Windows are confirmed by a join, whose windows and lists of items are
    broadcast if counts show that they fit ``broadcast_windows`` rows and ``broadcast_bytes`` bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "windows")
    windows = items.select(F.col("item_id").cast("long"), "text").mapInArrow(
        item_windows(window), "item_id long, win string, size int, fps array<long>"
    )
    windows = scratch.keep(
        windows.groupBy("win").agg(
            F.first("size").alias("size"), F.first("fps").alias("fps"), F.collect_set(F.col("item_id").cast("string")).alias("items")
        ),
        "items",
    )
    prints = windows.select(F.explode("fps").alias("fp")).distinct()
    width = F.octet_length("win") + F.aggregate("items", F.lit(0), lambda n, i: n + F.octet_length(i) + 16) + 64
    n_windows, n_bytes = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    n_prints = prints.count()
    small = n_windows <= broadcast_windows and n_bytes <= broadcast_bytes
    short = sorted(r[0] for r in windows.where(F.col("size") < window).select("size").distinct().collect())  # < window
    rows = docs.select(
        F.col("doc_id").cast("long"), *(h.alias(n) for h, n in zip(row_hashes("doc_id", "text"), ("r1", "r2"))), "text"
    )
    schema = "doc_id long, r1 long, r2 long, n_words long, windows array<struct<start:int,size:int,win:string>>"
    if n_prints <= broadcast_prints:
        known = np.sort(prints.toPandas()["fp"].to_numpy(np.int64).view(np.uint64)) if n_prints else np.zeros(0, np.uint64)
        found = rows.mapInArrow(document_windows(window, short, known), schema)
    else:
        own = rows.select("r1", "r2", "text").mapInArrow(document_prints(window, short), "r1 long, r2 long, fp long")
        own = own.distinct().join(prints, "fp", "left_semi").groupBy("r1", "r2").agg(F.collect_list("fp").alias("fps"))
        rows = rows.join(own, ["r1", "r2"], "left").select("doc_id", "r1", "r2", "text", "fps")
        found = rows.mapInArrow(document_windows(window, short, None), schema)
    opened = found.select("doc_id", "r1", "r2", "n_words", F.size("windows").alias("rows"), F.explode_outer("windows").alias("w"))
    opened = opened.select("doc_id", "r1", "r2", "n_words", "rows", "w.start", "w.size", "w.win")
    of = windows.select("win", "items")
    met = opened.join(F.broadcast(of) if small else of.hint("merge"), "win", "left")
    spans = F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))
    return (
        met.groupBy("doc_id", "r1", "r2", "n_words", "rows")
        .agg(
            F.collect_set(F.when(F.col("items").isNotNull(), F.struct("start", "size"))).alias("spans"),
            F.collect_set("items").alias("items"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("items", F.array_sort(F.array_distinct(F.flatten("items"))))
        .withColumn("times", F.explode(F.array_repeat(F.lit(1), (F.col("n") / F.greatest("rows", F.lit(1))).cast("int"))))
        .select(
            "doc_id", "r1", "r2", "n_words",
            F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("n_hit"),
            F.size("items").cast("long").alias("n_items"), "items",
        )
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, broadcast_rows: int = 4_000_000) -> DataFrame:
    """``docs`` without the rows that hold a window of an item, all columns; see ``find_contamination``.

    Rows with a null or empty text stay, repeated rows stay or go together, and columns may have any names.
    """
    hit = find_contamination(docs, items, window).where("n_hit > 0").select("r1", "r2").distinct()
    hit = Scratch(docs.sparkSession, "contaminated").keep(hit, "rows")
    meet = F.broadcast(hit) if hit.count() <= broadcast_rows else hit
    r1, r2 = spare(docs, "r1", "r2")
    marked = docs.select("*", *(h.alias(n) for h, n in zip(row_hashes("doc_id", "text"), (r1, r2))))
    return marked.join(meet.select(F.col("r1").alias(r1), F.col("r2").alias(r2)), [r1, r2], "left_anti").select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op3_decontaminate": rf"""
WITH d AS (SELECT doc_id, coalesce({WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT DISTINCT doc_id, i, dw.size, item_id FROM dw JOIN bw USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
}
QUERIES = {"op3_decontaminate": op3_decontaminate}
