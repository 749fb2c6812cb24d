"""A training corpus from raw documents: five stages, each over all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuefit.llm.common import Scratch, read_table
from valuefit.llm.decontaminate import decontaminate
from valuefit.llm.line_dedup import dedup_lines
from valuefit.llm.minhash import dedup_documents
from valuefit.llm.pieces import encode
from valuefit.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network rejects go.

    It learns from the labels of ``sf_dir`` whose documents still are in ``docs``.  Every row is judged by its own whole
    text, a null one like an empty text; equal texts are judged alike, and repeated rows and rows without an id stay or go
    by their text.  Texts of any length are read whole, very long ones in parts with the same result.  A score of just the
    threshold is kept.  Without labels of both classes all documents get one score, the share of good labels (1/2 for no
    labels at all is below the threshold, so then all go).  An empty table stays empty; other columns may have any names.
    """
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least ten documents hold go; ``n_chars``, if it is there, follows the text.

    Every row counts as a document, repeated ones and those without an id too.  A null or empty text is one empty line; an
    empty key is no key, so it stays, as an empty text.  A text whose lines all go becomes empty, and its row stays.
    Texts may have any length, tables may be empty, and other columns, also ``n_lines`` and ``n_dropped``, come back as they
    were.
    """
    aside = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    out = dedup_lines(docs.toDF(*aside)).select(*aside).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id.

    Rows that share the id that stays all stay, as do rows without an id and rows with a null or empty text, which are like
    nothing.  Texts are compared whole, whatever their length; a pair at just the threshold is a link.  An empty table stays
    empty; other columns may have any names.
    """
    return dedup_documents(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; items that are null or have no words match nothing.  Each of repeated rows is
    judged by its own text, also without an id.  Texts are searched whole, tables may be empty, and other columns may have
    any names.
    """
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document: doc_id, n_tokens, tokens, round_trip.

    A null or empty text has no tokens.  Repeated rows and rows without an id are encoded like any other, whole texts of
    any length; of equally good paths the one with the longest first pieces is taken.  An empty table gives an empty one;
    other columns are not returned.
    """
    return encode(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("minhash_dedup", near_duplicates),
    ("decontaminate", benchmark),
    ("sentencepiece", tokens),
]
#: The network and the transducer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
