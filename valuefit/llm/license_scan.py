"""License scans with a positional index of rare tokens.

Every template (a notice or a whole license text) is indexed by its words of the highest inverse document frequency,
counted over all documents, each with its position.  A document looks up its rarest license words, those that are the
rarest of a mandatory key phrase; where one and the key phrase around it meet a posting, the template has a place to start
at, and its other postings are intersected with the document's rare words by their relative positions.  The template is
found if enough of the indexed weight stands in place.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, read_table, row_hashes

#: Fixed phrases with a label of their own.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label, notice, mandatory key phrase
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "under the terms of the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("all-rights-reserved", "copyright all rights reserved", "all rights reserved"),
]
#: label and the names by which short notices refer to a license; each is its own key phrase
NAMES = {
    "mit": "mit license,mit licence,spdx license identifier mit", "isc": "isc license,isc licence", "unlicense": "the unlicense",
    "bsd": "bsd license,bsd licence,bsd style license,bsd 2 clause,bsd 3 clause,2 clause bsd,3 clause bsd",
    "apache-2.0": "apache license version 2 0,apache license 2 0,apache license v2 0,apache licence version 2 0,apache 2 0",
    "gpl-2.0": "gpl version 2,gpl v2,gplv2,gpl 2 0,gnu general public license v2", "gpl-3.0": "gpl version 3,gpl v3,gplv3,gpl 3 0,gnu general public license v3",
    "lgpl": "gnu lesser general public license,gnu library general public license,lgpl", "agpl": "gnu affero general public license,agpl",
    "mpl-1.1": "mozilla public license 1 1,mozilla public license version 1 1,mozilla public license v 1 1,mpl 1 1",
    "mpl-2.0": "mozilla public license 2 0,mozilla public license version 2 0,mozilla public license v2 0,mpl 2 0",
    "epl": "eclipse public license", "cc0-1.0": "cc0", "public-domain": "released into the public domain,in the public domain,public domain dedication,dedicated to the public domain",
}
#: short names of the Creative Commons licenses and their written-out forms
COMMONS = {
    "by": ["attribution"], "by-sa": ["attribution sharealike", "attribution share alike"], "by-nd": ["attribution noderivatives", "attribution noderivs", "attribution no derivatives"],
    "by-nc": ["attribution noncommercial", "attribution non commercial"],
    "by-nc-sa": ["attribution noncommercial sharealike", "attribution noncommercial share alike", "attribution non commercial share alike"],
    "by-nc-nd": ["attribution noncommercial noderivatives", "attribution noncommercial noderivs", "attribution non commercial no derivatives"],
}
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: label and key phrase of the whole texts beside this file
TEXTS = {
    "Apache-2.0": ("apache-2.0", "terms and conditions for use reproduction and distribution"), "BSD": ("bsd", "redistributions in binary form must reproduce"),
    "CC0-1.0": ("cc0-1.0", "jurisdictions throughout the world automatically confer exclusive copyright"), "GPL-2": ("gpl-2.0", "public license applies to most of the free software foundation"),
    "GPL-3": ("gpl-3.0", "general public license is a free copyleft license"), "LGPL-2.1": ("lgpl", "first released version of the lesser gpl"),
    "LGPL-3": ("lgpl", "lesser general public license incorporates the terms"), "MIT": ("mit", "permission notice shall be included in all copies or substantial portions"),
    "MPL-1.1": ("mpl-1.1", "contributor version means the combination of the original code"), "MPL-2.0": ("mpl-2.0", "contributes to the creation of or owns covered software"),
}
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of a-z, 0-9 and non-ASCII characters after A-Z is lower-cased; none for a null text."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP)
    return F.filter(parts, lambda w: w != "")


def all_templates() -> list[tuple[str, str, str]]:
    """Notices, short references and whole texts."""
    names = [(label, n) for label, some in NAMES.items() for n in some.split(",")]
    for kind, written in COMMONS.items():
        for version in VERSIONS:
            short, number = kind.replace("-", " "), version.replace(".", " ")
            forms = [f"cc {short} {number}", f"licenses {short} {number}", *(f"{w} {number}" for w in written)]
            names += [(f"cc-{kind}-{version}", f) for f in forms]
    known = {(label, notice) for label, notice, _ in TEMPLATES}
    short = [(label, n, n) for label, n in names if (label, n) not in known]
    folder = Path(__file__).parent / "licenses"
    whole = [(label, " ".join(re.sub(GAP, " ", (folder / f"{file}.txt").read_text().lower()).split()), key) for file, (label, key) in TEXTS.items()]
    return TEMPLATES + short + whole


def places(words: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand consecutively."""
    there = reduce(lambda a, b: a & b, (F.array_contains(words, w) for w in phrase)) & (F.size(words) >= len(phrase))
    starts = F.filter(
        F.sequence(F.lit(0), F.size(words) - len(phrase)),
        lambda i: reduce(lambda a, b: a & b, (F.get(words, i + k) == w for k, w in enumerate(phrase))),
    )
    return F.when(there, starts).otherwise(F.array().cast("array<int>"))


def _literal(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def postings(templates: list[tuple[str, str, str]], counts: dict[str, int], total: int, rare: int) -> tuple[list[tuple], list[tuple]]:
    """The positional index: a row for each template with the key phrase's rarest word, and rows of rare words elsewhere.

    Weights are inverse document frequencies; what a template's own words weigh together is 1.
    """
    keys, others = [], []
    for k, (label, notice, key) in enumerate(templates):
        notice, key = notice.split(), key.split()
        weight = {w: _idf(total, counts.get(w, 0)) for w in notice}
        chosen = set(sorted(weight, key=lambda w: (-weight[w], w))[:rare])
        start = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        within = range(start, start + len(key))
        own = [(w, i) for i, w in enumerate(notice) if w in chosen or i in within]
        sum_ = sum(weight[w] for w, _ in own)
        rarest = max(range(len(key)), key=lambda i: (weight[key[i]], key[i], -i))
        others += [(k, w, i, weight[w] / sum_) for w, i in own if i not in within]
        keys.append((key[rarest], k, label, rarest, start, key, sum(weight[w] for w in key) / sum_))
    return keys, others


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=None, rare: int = 6, coverage: float = 0.6, broadcast_rows: int = 200_000
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    ``n_base`` counts the places where a phrase of ``phrases`` stands, ``first_word`` and ``last_word`` are the
    smallest and largest word number at which one starts (null without any), ``base_labels`` their labels.
    ``labels`` adds those of templates that align.  ``score`` is 1 with a base place, else the largest covered
    share of an aligned template's weight, else 0.  ``places``: array of (label, word) of aligned templates.

    A file looks up its rarest license words, which are the rarest of some key phrase; the key phrase is verified around
    them, and then the other rare words of the template where its postings say that they stand.  A null or empty text
    has no words and no labels, whole texts of any length are read, repeated rows come back as often as they came, an id
    may be null, and other columns of ``docs`` are not read, so names cannot clash; an empty table gives an empty result.
    Of equally rare words the alphabetically last (in a key phrase) or first (elsewhere) is taken.  An alignment may
    start before the text's first word, so a notice may be cut off, but its key phrase has to be whole.  Without
    ``templates`` (label, notice, key phrase), those of ``all_templates`` are taken.  The key phrases' rarest words
    become part of the plan, so templates may be some thousands; postings are broadcast up to ``broadcast_rows``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    templates = all_templates() if templates is None else templates
    vocabulary = sorted({w for _, notice, _ in templates for w in notice.split()})
    # document frequencies over all documents: a few rows, one for each word of the templates
    seen = docs.select(F.explode(F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary)))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in scratch.keep(seen, "frequencies").collect()}
    keys, others = postings(templates, counts, docs.count(), rare)
    index = scratch.keep(spark.createDataFrame(keys, "word string, template int, label string, back int, start int, key array<string>, share double"), "keys")
    rest = scratch.keep(spark.createDataFrame(others, "template int, word string, at int, weight double"), "postings")
    met_by = lambda frame, n: F.broadcast(frame) if n <= broadcast_rows else frame
    rarest, elsewhere, wide = sorted({k[0] for k in keys}), sorted({w for _, w, _, _ in others}), max((len(k[5]) for k in keys), default=0)
    base = [places(F.col("words"), p.split()) for p in phrases]
    labels = F.array_compact(F.array(*(F.when(F.size(b) > 0, F.lit(v)) for b, v in zip(base, phrases.values()))))
    of = lambda some: F.filter(F.transform("words", lambda w, i: F.when(w.isin(some), F.struct(w.alias("word"), i.alias("i")))), lambda x: x.isNotNull())
    # each with the words around it, from the most that a key phrase can reach back
    looked = F.transform(of(rarest), lambda x: F.struct(
        x["word"].alias("word"), x["i"].alias("i"), F.greatest(x["i"] - (wide - 1), F.lit(0)).alias("low"),
        F.slice("words", F.greatest(x["i"] - (wide - 1), F.lit(0)) + 1, F.lit(2 * wide - 1)).alias("near")))
    rows = docs.select(
        "doc_id", *(h.alias(n) for h, n in zip(row_hashes("doc_id", "text"), ("r1", "r2"))), words_of(F.col("text")).alias("words")
    ).select(
        "doc_id", "r1", "r2", F.size("words").cast("long").alias("n_words"), F.array_sort(F.array_distinct(labels)).alias("base"),
        F.concat(*base).alias("starts"), looked.alias("looked"), F.when(F.arrays_overlap("words", _literal(rarest)), of(elsewhere)).alias("open"),
    )
    rows = scratch.keep(rows, "rows")
    texts = rows.where(F.size("looked") > 0).dropDuplicates(["r1", "r2"])
    begin = F.col("i") - F.col("back")
    whole = texts.select("r1", "r2", F.inline("looked")).join(met_by(index, len(keys)), "word").where(
        (begin >= F.col("low")) & (F.slice("near", F.greatest(begin - F.col("low"), F.lit(0)) + 1, F.size("key")) == F.col("key"))
    )
    whole = scratch.keep(whole.select("r1", "r2", "template", "label", "share", (begin - F.col("start")).alias("offset")).distinct(), "whole")
    there = texts.select("r1", "r2", F.inline("open"))
    more = whole.join(met_by(rest, len(others)), "template").select("r1", "r2", "template", "offset", "word", "weight", (F.col("offset") + F.col("at")).alias("i"))
    more = more.join(there, ["r1", "r2", "word", "i"]).groupBy("r1", "r2", "template", "offset").agg(F.sum("weight").alias("more"))
    aligned = whole.join(more, ["r1", "r2", "template", "offset"], "left").withColumn("share", F.col("share") + F.coalesce("more", F.lit(0.0)))
    hits = (
        aligned.where(F.col("share") >= coverage - 1e-12)
        .groupBy("r1", "r2").agg(F.array_sort(F.collect_set(F.struct("label", F.col("offset").alias("word")))).alias("places"), F.max("share").alias("share"))
    )
    found = rows.join(hits, ["r1", "r2"], "left").withColumn("places", F.coalesce("places", F.array().cast("array<struct<label:string,word:int>>")))
    every = F.array_sort(F.array_union("base", F.transform("places", lambda h: h["label"])))
    return found.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("starts") > 0, 1.0).otherwise(F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0))).alias("score"), "places",
    )


def _idf(total: int, count: int) -> float:
    return math.log((total + 1) / (count + 1)) + 1


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("places")


QUERIES = {"op10_license_scan": op10_license_scan}
