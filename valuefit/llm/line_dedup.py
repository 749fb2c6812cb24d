"""Line dedup over levelled sorted runs of line hashes.

A run holds line hashes and in how many documents of their batch they are, in hash buckets, sorted.  A batch is counted and
merge-anti-joined with the runs: hashes that no run has become its own run at level 0, counts of those that one has are
set aside.  So runs are disjoint, and once a level holds ``fanout`` of them they become one run of the next level, bucket
by bucket.  A line is frequent if the count of its run and the counts set aside add up.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, read_table, row_hashes, spare

SPACE = " \t\n\x0b\f\r"
HASH = ["h1", "h2"]


def line_keys(text: Column) -> Column:
    """The keys of all lines of a text: stripped of ASCII white space, A-Z lower-cased.  Null is one empty line."""
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.btrim(x, F.lit(SPACE)))


def hashes(key: Column) -> list[Column]:
    """128 bits of a line key, as two independent longs."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x9E3779B9), key).alias("h2")]


class LineRuns:
    """The levelled runs.  ``add`` takes batches, ``frequent`` reads what at least ``min_docs`` documents hold.

    All tables are bucketed by hash alike, so batches meet runs, and runs are merged, without a shuffle: the only one is
    that of a batch's own counts.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = 4, min_key: int = 1, buckets: int | None = None):
        self.spark, self.scratch, self.fanout, self.min_key = spark, scratch, fanout, min_key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.again: list[str] = []
        self.made = 0
        self.prefix = f"lines_{scratch.root.rpartition('-')[2]}"

    def _save(self, rows: DataFrame, name: str, *by: str) -> DataFrame:
        """A bucketed table in the shared folder; only its name is the catalogue's."""
        out = rows.write.format("parquet").mode("overwrite").option("path", self.scratch.path(name)).bucketBy(self.buckets, *HASH).sortBy(*HASH)
        (out.partitionBy(*by) if by else out).saveAsTable(f"{self.prefix}_{name}")
        return self._read(name)

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}_{name}")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {self.prefix}_{name}")
        self.scratch.drop(name)

    def close(self) -> None:
        for name in [*(n for level in self.levels for n in level), *self.again]:
            self._drop(name)
        self.levels, self.again = [], []

    def _place(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            self.compact(level)

    def compact(self, level: int) -> None:
        """Put all runs of a level together as one of the next; they have no hash in common."""
        names, self.levels[level] = self.levels[level], []
        merged = f"run_{level + 1}_{self.made}"
        self._save(functools.reduce(DataFrame.unionByName, map(self._read, names)), merged)
        for name in names:
            self._drop(name)
        self._place(merged, level + 1)

    def counts(self, docs: DataFrame, batch: Column, batches: int) -> DataFrame:
        """(batch, h1, h2, n): documents by line hash; a line counts once for each row of ``docs``.  Batches are counted side
        by side, in one pass; partial sums come before the shuffle."""
        keys = F.filter(F.array_distinct(line_keys(F.col("text"))), lambda k: F.length(k) >= self.min_key)
        lines = docs.select(batch.alias("batch"), F.explode(keys).alias("key")).select("batch", *hashes(F.col("key")))
        own = [F.sum((F.col("batch") == b).cast("long")).alias(f"n{b}") for b in range(batches)]
        side = F.array(*(F.struct(F.lit(b).alias("batch"), F.col(f"n{b}").alias("n")) for b in range(batches)))
        return lines.groupBy(*HASH).agg(*own).select(*HASH, F.inline(side)).where("n > 0")

    def add(self, docs: DataFrame) -> None:
        self.add_batches(docs, F.lit(0), 1)

    def add_batches(self, docs: DataFrame, batch: Column, batches: int) -> None:
        """Count ``batches`` batches (numbers from 0) in one pass over the documents, then take them one after the other."""
        name = f"counts_{self.made}"
        self.made += 1
        counts = self._save(self.counts(docs, batch, batches), name, "batch")
        for b in range(batches):
            self._take(counts.where(F.col("batch") == b).select(*HASH, "n"))
        self._drop(name)

    def _take(self, batch: DataFrame) -> None:
        """Anti-join a batch with all runs; the rest is its run, and counts of what is in a run are set aside."""
        fresh = batch
        for run in [n for level in self.levels for n in level]:
            fresh = fresh.join(self._read(run).select(*HASH).hint("merge"), HASH, "left_anti")
        known = len(self.again) + sum(map(len, self.levels)) > 0
        name = f"run_0_{self.made}"
        self.made += 1
        fresh = self._save(fresh, name)
        if known:
            self.again.append(f"again_{self.made}")
            self._save(batch.join(fresh.select(*HASH).hint("merge"), HASH, "left_anti"), self.again[-1])
            if len(self.again) >= self.fanout:
                self._join_again()
        self._place(name, 0)

    def _join_again(self) -> None:
        """One table of counts set aside instead of many."""
        names, merged = self.again, f"again_{self.made}_sum"
        self._save(self._aside(), merged)
        for name in names:
            self._drop(name)
        self.again = [merged]

    def _aside(self) -> DataFrame | None:
        if not self.again:
            return None
        return functools.reduce(DataFrame.unionByName, map(self._read, self.again)).groupBy(*HASH).agg(F.sum("n").alias("n"))

    def all(self) -> DataFrame:
        """(h1, h2, n): every line hash so far, with the number of documents that hold it."""
        names, aside = [n for level in self.levels for n in level], self._aside()
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        runs = [self._read(n) for n in names]
        if aside is not None:
            aside = aside.withColumnRenamed("n", "more")
            runs = [r.join(aside, HASH, "left").select(*HASH, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")) for r in runs]
        return functools.reduce(DataFrame.unionByName, runs)

    def frequent(self, min_docs: int) -> DataFrame:
        return self.all().where(F.col("n") >= min_docs).select(*HASH)


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_key: int = 1,
    batches: int = 4,
    fanout: int = 4,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """All columns of ``docs``, its text without frequent lines, and ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased.  Keys of at least
    ``min_key`` code points found in at least ``min_docs`` rows lose all their lines in every row; the others stay,
    joined by a newline.  Each row is a document of its own, also where rows or ids repeat or an id is null.  A null
    or empty text is one empty line, which stays: it comes back as an empty text.  If all lines go, the text is
    empty.  Very long texts are split like any other, an empty table gives an empty result.  Columns of ``docs`` named
    ``n_lines`` or ``n_dropped`` are replaced.

    Frequent lines are broadcast if a count shows that they fit ``broadcast_rows``, else merge-joined by hash, where
    Spark splits the partitions of hot lines.  Texts are shuffled once at most, by (doc_id, text), never by line.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    runs = LineRuns(spark, scratch, fanout, min_key)
    runs.add_batches(docs, F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"), batches)
    # what is frequent is known after the last batch only, and then goes from all of them
    frequent = scratch.keep(runs.frequent(min_docs), "frequent")
    runs.close()
    n_frequent = frequent.count()
    mine = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*mine)
    r1, r2, gone_at = spare(docs, "r1", "r2", "gone")
    row = [h.alias(n) for h, n in zip(row_hashes("doc_id", "text"), (r1, r2))]
    lines = docs.select(*row, F.posexplode(line_keys(F.col("text"))).alias("at", "key")).select(
        r1, r2, "at", F.length("key").alias("size"), *hashes(F.col("key"))
    )
    meet = F.broadcast(frequent) if n_frequent <= broadcast_rows else frequent.hint("merge")
    # what the anti-join with the runs removes; rows that lose nothing need no list
    gone = lines.where(F.col("size") >= min_key).join(meet, HASH, "left_semi")
    gone = gone.groupBy(r1, r2).agg(F.collect_set("at").alias(gone_at))
    text = F.coalesce("text", F.lit(""))
    parts = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone_at))
    kept = F.when(F.col(gone_at).isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    out = docs.select("*", *row).join(gone, [r1, r2], "left")
    return out.select(
        *(kept.alias(c) if c == "text" else F.col(c) for c in mine),
        F.size(parts).cast("long").alias("n_lines"),
        F.when(F.col(gone_at).isNull(), 0).otherwise(F.size(gone_at)).cast("long").alias("n_dropped"),
    )


def new_lines(docs: DataFrame, runs: LineRuns) -> DataFrame:
    """(doc_id, at, key) of the lines of a batch that no earlier batch holds; then the batch's own run is added.

    The incremental use of the runs: a merge anti-join, in which Spark splits partitions of hot lines.
    """
    lines = docs.select("doc_id", F.posexplode(line_keys(F.col("text"))).alias("at", "key"))
    fresh = lines.select("*", *hashes(F.col("key"))).join(runs.all().select(*HASH).hint("merge"), HASH, "left_anti")
    fresh = runs.scratch.keep(fresh.drop(*HASH), f"fresh-{runs.made}")
    runs.add(docs)
    return fresh


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = {
    "op2_line_dedup": r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
  unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""
}
QUERIES = {"op2_line_dedup": op2_line_dedup}
