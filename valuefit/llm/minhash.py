"""Near-duplicate documents by SuperMinHash.

A document's set is its distinct shingles of five words.  SuperMinHash gives every shingle a random permutation of the
signature's slots and, in its j-th slot, the value j + r with r uniform; a slot holds the least value that it gets.
Ranks of one shingle are correlated across slots, which lowers the variance, and once all slots of a document are below
j + 1 no later rank can change them, so the loop over ranks stops early.

Bands of slots are the buckets of candidates; candidates are verified on their whole sets and grouped by union-find on
edges, as connected components in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, maybe_broadcast, read_table, spare
from .graph import components, forest
from .kernels import NOT_SPACE, U, Words, chunks, mix

SLOTS, ROWS, SHINGLE = 128, 4, 5
#: shingles whose ranks are held at a time
BLOCK = 1 << 16
_RANK = U(64 - SLOTS.bit_length() + 1)  # bits of r below those of j


def shingle_sets(words: Words, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row of fewer words has its whole sequence as one shingle."""
    at, grams = words.grams(n)
    cut = np.searchsorted(words.doc[at], np.arange(words.n_docs + 1))
    out = []
    for d in range(words.n_docs):
        own = grams[cut[d] : cut[d + 1]]
        if len(own) == 0 and (size := int(words.first[d + 1] - words.first[d])):
            own = words.mixed(words.first[d : d + 1], size)
        own = np.sort(own)
        out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
    return out


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, one row of ``slots`` uint64 for each set; an empty set's slots are all ones."""
    sig = np.full((len(sets), slots), np.iinfo(np.uint64).max, U)
    every = np.concatenate([*sets, np.zeros(0, U)])
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for first in range(0, len(every), BLOCK):  # least values do not depend on the order: a long text comes in blocks
        _lower(sig, every[first : first + BLOCK], owners[first : first + BLOCK])
    return sig


def _lower(sig: np.ndarray, items: np.ndarray, owner: np.ndarray) -> None:
    """Lower the signatures by the values of some shingles."""
    flat, slots, order = sig.reshape(-1), sig.shape[1], None
    for j in range(slots):
        if len(items) == 0:
            break
        draw = mix(items + U((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        k = j + (((draw >> U(32)) * U(slots - j)) >> U(32)).astype(np.int64)
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(items), 1))
        rows = np.arange(len(items))
        slot = order[rows, k].astype(np.int64)
        order[rows, k] = order[:, j]
        value = (U(j) << _RANK) | (mix(draw) >> (U(64) - _RANK))
        np.minimum.at(flat, owner * slots + slot, value)
        open_ = (sig >= (U(j + 1) << _RANK)).any(axis=1)[owner]
        if not open_.all():
            items, owner, order = items[open_], owner[open_], order[open_]


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of ``rows`` consecutive slots."""
    n = sig.shape[1] // rows
    total = np.arange(1, n + 1, dtype=U)[None, :] * U(0xD6E8FEB86659FD93) * np.ones((len(sig), 1), U)
    for t in range(rows):
        total = mix(total + sig[:, t : n * rows : rows])
    return total


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    out = np.zeros((2, len(sets)), U)
    for d, s in enumerate(sets):
        out[0, d] = mix(s).sum(dtype=U)
        out[1, d] = mix(s ^ U(0xA0761D6478BD642F)).sum(dtype=U)
    return out[0].view(np.int64), out[1].view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column(1)):
            sets = shingle_sets(Words(data, offsets, NOT_SPACE))
            d1, d2 = _digests(sets)
            sizes = np.array([len(s) for s in sets], np.int64)
            hashes = bands(signatures(sets)).view(np.int64)
            n = hashes.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n), pa.array(hashes.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(d1), pa.array(d2), lists], ["doc_id", "n", "d1", "d2", "bands"]
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column(1)):
            sets = shingle_sets(Words(data, offsets, NOT_SPACE))
            ends = np.cumsum([0, *(len(s) for s in sets)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, U)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["id", "shingles"])


def near_duplicates(docs: DataFrame, percent: int = 75, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked if 100 * intersection >= ``percent`` * union holds for their full sets of distinct five-word
    shingles, words being runs of anything but ASCII white space after A-Z is lower-cased.  A document of fewer
    words has its whole sequence as its one shingle; one without words, or a null text, is empty and linked with
    nothing.  ``component_id`` is the smallest doc_id reachable by links, ``kept`` marks the document that has it.
    Repeated rows come back as often as they came; rows that share a doc_id are one node.  A row without an id joins
    the component of its exact copies, or has none and is kept.

    Equal sets are one class from the start, represented by their smallest id, so copies never meet in pairs.  In each
    bucket of a band all classes are compared with its leader, the one that shares most buckets.  Classes that are not
    linked to it are then compared, in blocks, with all others of the leader's buckets, so no link within a bucket is
    passed over, while those near a leader cost one comparison each and no pairs are emitted but those found.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    signed = scratch.keep(texts.mapInArrow(_sign, "doc_id long, n long, d1 long, d2 long, bands array<long>"), "signed")
    classes = signed.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    classes = scratch.keep(classes, "classes")
    reps = signed.where("n > 0").join(
        classes.where("rep is not null").select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi"
    ).dropDuplicates(["doc_id", "d1", "d2"])
    opened = scratch.keep(reps.select(F.col("doc_id").alias("rep"), "n", "bands"), "reps").select(
        "rep", "n", F.explode("bands").alias("bucket")
    )
    shared = scratch.keep(
        opened.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared"
    )
    members = scratch.keep(opened.join(maybe_broadcast(shared, shared.count(), broadcast_rows), "bucket"), "members")
    weight = members.groupBy("rep").agg(F.sum("members").alias("weight"))
    leaders = scratch.keep(
        members.join(weight, "rep").groupBy("bucket")
        .agg(F.max(F.struct("weight", (-F.col("rep")).alias("order"), "rep", "n")).alias("x"))
        .select("bucket", F.col("x.rep").alias("leader"), F.col("x.n").alias("leader_n")), "leaders",
    )
    led = members.join(maybe_broadcast(leaders, leaders.count(), broadcast_rows), "bucket").where("rep <> leader")
    fits = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent  # what any link needs
    led = scratch.keep(led.select("bucket", "rep", "n", "members", "leader", fits.alias("fits")), "led")
    star = led.where("fits").select(F.least("rep", "leader").alias("u"), F.greatest("rep", "leader").alias("v")).distinct()
    ids = scratch.keep(led.select(F.explode(F.array("rep", "leader")).alias("doc_id")).distinct(), "ids")
    sets = scratch.keep(
        texts.join(maybe_broadcast(ids, ids.count(), broadcast_rows), "doc_id", "left_semi").mapInArrow(_sets, "id long, shingles array<long>"), "sets"
    )
    links = scratch.keep(verify(star, sets, percent), "links")
    joined = links.select(F.col("u").alias("rep"), F.col("v").alias("leader")).unionByName(links.select(F.col("v").alias("rep"), F.col("u").alias("leader")))
    family = led.groupBy("leader", "rep").agg(F.max("n").alias("n"), F.max("members").alias("members"))
    family = scratch.keep(
        family.join(joined.withColumn("near", F.lit(True)), ["leader", "rep"], "left").withColumn("near", F.coalesce("near", F.lit(False))), "family"
    )
    links = links.unionByName(scratch.keep(compare_rest(family, sets, percent, broadcast_rows), "rest"))
    found = scratch.keep(components(links, scratch), "components")
    named = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component")
    )
    # copies may be a third of all rows: Spark splits the partitions of hot sets
    named = scratch.keep(named, "named")
    out = signed.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets meet the threshold."""
    both = (
        pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
        .join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
        .withColumn("meet", F.size(F.array_intersect("a", "b")))
    )
    union = F.size("a") + F.size("b") - F.col("meet")
    return both.where(F.col("meet") * 100 >= union * percent).select("u", "v")


def _meeting(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right ones, as products of 0/1 matrices of the shingles
    that more than one set holds."""
    out = np.zeros((len(left), len(right)), np.float32)
    values, codes, n = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    place = np.full(len(values), -1)
    place[n > 1] = np.arange((n > 1).sum())
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    at = place[codes]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, int((n > 1).sum()), width):
        a, b = np.searchsorted(at, [low, low + width])
        m = np.zeros((len(left) + len(right), width), np.float32)
        m[owner[a:b], at[a:b] - low] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        first = table.column("first").to_numpy().astype(bool)
        ids = table.column("rep").to_numpy()
        sets = [x.values.to_numpy() for x in table.column("shingles")]
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        if len(right) == 0:
            right = left
        sizes = np.array([len(x) for x in sets])
        meet = _meeting([sets[i] for i in left], [sets[i] for i in right])
        union = sizes[left][:, None] + sizes[right][None] - meet
        linked = (meet * 100 >= union * percent) & (ids[left][:, None] != ids[right][None])
        u, v = forest(linked, ids[left], ids[right])
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def compare_rest(family: DataFrame, sets: DataFrame, percent: int, broadcast_rows: int, block: int = 400_000, most: int = 512) -> DataFrame:
    """Links (u, v) between members of a leader's family that are not linked to it and all other members.

    Members are dealt into blocks of about ``block`` shingles or ``most`` sets, those near the leader apart from the
    rest; each block of the rest meets each other block in a task of its own, which gives a tree of the links it found.
    """
    sizes = family.groupBy("leader").agg(*(
        F.ceil(F.greatest(F.sum(F.when(of, F.col("n")).otherwise(0)) / block, F.sum(F.when(of, 1).otherwise(0)) / most)).cast("int").alias(name)
        for name, of in (("far_blocks", ~F.col("near")), ("near_blocks", F.col("near")))
    ), F.max("members").alias("largest")).where("far_blocks > 0 and largest > 2").drop("largest")
    dealt = family.select("leader", "rep", "near").join(maybe_broadcast(sizes, sizes.count(), broadcast_rows), "leader")
    lot = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(n, F.lit(1))).cast("int")
    k, m = F.col("far_blocks"), F.col("near_blocks")
    dealt = dealt.withColumn("own", F.when(F.col("near"), k + lot(m)).otherwise(lot(k)))
    task = lambda i, j, first: F.struct(i.alias("i"), j.alias("j"), F.lit(first).alias("first"))
    nothing = F.array().cast("array<struct<i:int,j:int,first:boolean>>")
    as_first = F.transform(F.sequence(F.col("own"), k + m - 1), lambda j: task(F.col("own"), j, True))
    as_second = F.transform(F.sequence(F.lit(0), F.least(F.col("own"), k) - 1), lambda i: task(i, F.col("own"), False))
    tasks = F.concat(F.when(F.col("near"), nothing).otherwise(as_first), F.when(F.col("own") > 0, as_second).otherwise(nothing))
    dealt = dealt.select("leader", "rep", F.explode(tasks).alias("t")).select("leader", "rep", "t.i", "t.j", "t.first")
    # a task without second members compares its first block with itself, which is right only where i = j
    full = dealt.join(sets.withColumnRenamed("id", "rep"), "rep").groupBy("leader", "i", "j")
    return full.applyInArrow(_compare(percent), "u long, v long").distinct()


def dedup_documents(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest doc_id.

    Rows that share a kept id all stay, rows without an id stay, and so do rows with a null or empty text.  Columns may
    have any names.
    """
    found = near_duplicates(docs, percent)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone"), F.lit(True).alias("drop")).distinct()
    gone = Scratch(docs.sparkSession, "duplicates").keep(gone, "ids")
    # a null id never joins, so those rows stay
    name, = spare(docs, "gone")
    meet = maybe_broadcast(gone.select(F.col("gone").alias(name)), gone.count(), 1_000_000)
    return docs.join(meet, F.col("doc_id").cast("long") == F.col(name), "left_anti").select(*docs.columns)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {"op7_minhash_dedup": op7_minhash_dedup}
SQL = {
    "op7_minhash_dedup": r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), cut as (
  select doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) as shingle from worded where len(w) > 0
), shingled as (select distinct doc_id, shingle from cut),
sized as (select doc_id, count(*) as n from shingled group by doc_id),
meeting as (
  select a.doc_id as u, b.doc_id as v, count(*) as m from shingled a join shingled b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2
), linked as (
  select u, v from meeting join sized x on x.doc_id = u join sized y on y.doc_id = v where 100 * m >= 75 * (x.n + y.n - m)
), ways as (select u, v from linked union all select v, u from linked),
reached(a, b) as (select doc_id, doc_id from documents union select r.a, l.v from reached r join ways l on r.b = l.u)
select d.doc_id, coalesce(s.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join sized s on s.doc_id = d.doc_id join (select a, min(b) as component_id from reached group by a) c on c.a = d.doc_id
"""
}
