"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator and stage."""

import importlib

import pytest
from pyspark.sql import functions as F

from valuefit.llm import decontaminate, license_scan, line_dedup, minhash, pieces, pii, quality, toxicity, url_filter

NAMES = "r1 r2 gone m fps key at word found _key drop shingles matches label lot x score n_lines items url host rule kind _r1 _r2".split()
TEXTS = ["a line\nb b\nc", "a line\n" + "long words here " * 20000, None, "", "a line\nb b\nc", " ", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"] * 2


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i if i != 4 else None, t, "en", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int").select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(10)], "doc_id long, quality int, toxic int").select("*", *(F.lit(7).alias(n) for n in NAMES))
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, None), (None, "")], "item_id long, text string").select("*", *(F.lit(7).alias(n) for n in NAMES))
    return docs.repartition(3).cache(), labels, items


KEEPING = {
    "quality": lambda d, la, it: quality.keep_good(d, la, threshold=0.0),
    "line_dedup": lambda d, la, it: line_dedup.dedup_lines(d, min_docs=3),
    "minhash": lambda d, la, it: minhash.dedup_documents(d),
    "decontaminate": lambda d, la, it: decontaminate.decontaminate(d, it),
    "pii": lambda d, la, it: pii.pseudonymise(d, "secret"),
}
SCORING = {
    "quality": lambda d, la, it: quality.score_quality(d, la), "toxicity": lambda d, la, it: toxicity.score_toxicity(d, la), "minhash": lambda d, la, it: minhash.near_duplicates(d),
    "decontaminate": lambda d, la, it: decontaminate.find_contamination(d, it), "pieces": lambda d, la, it: pieces.encode(d), "licenses": lambda d, la, it: license_scan.scan_licenses(d),
    "urls": lambda d, la, it: url_filter.filter_urls(d, url_filter.rules_frame(d.sparkSession), key="doc_id", url="text"),
}
GONE = {"quality": 0, "line_dedup": 0, "minhash": None, "decontaminate": 2, "pii": 0}


@pytest.mark.parametrize("name", KEEPING)
def test_columns_of_any_name_are_kept(tables, name):
    docs, labels, items = tables
    run = KEEPING[name]
    out = run(docs, labels, items)
    mine = [c for c in docs.columns if c not in ("text", "n_lines", "found")]
    assert [c for c in out.columns if c in mine] == mine
    rows = out.select(*mine).collect()
    assert GONE[name] is None or len(rows) == docs.count() - GONE[name]
    for r in rows:
        assert all(r[c] == f"own {c}" for c in NAMES if c in mine)
    assert run(docs.limit(0), labels, items).count() == 0
    assert run(docs, labels.limit(0), items.limit(0)).count() >= len(rows)


@pytest.mark.parametrize("name", SCORING)
def test_every_row_has_a_result(tables, name):
    docs, labels, items = tables
    out = SCORING[name](docs, labels, items)
    assert out.count() == docs.count()
    assert SCORING[name](docs.limit(0), labels, items).count() == 0


def test_pipeline_stages_take_any_columns(spark, tables, tmp_path):
    stages = importlib.import_module("corpus_pipeline").STAGES
    docs, labels, items = tables
    docs = docs.withColumn("n_dropped", F.lit(5))
    for name, frame in (("labels", labels), ("benchmark", items)):
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, stage in stages:
        out = stage(spark, docs, str(tmp_path))
        assert name == stages[-1][0] or out.columns == docs.columns
        if name == "line_dedup":
            assert {tuple(r) for r in out.select("n_lines", "n_dropped").collect()} == {("own n_lines", 5)}
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_rows_with_nulls_are_not_mixed_up(spark):
    """A null and a value are other rows than the value and a null."""
    rows = [("menu", None)] * 2 + [(None, "menu")] * 3 + [("a", "menu")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((str(r["doc_id"]), str(r["text"]), r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs, min_docs=3).collect())
    assert got == [("None", "", 1, 1)] * 3 + [("a", "", 1, 1)] + [("menu", "", 1, 0)] * 2


def test_long_labelled_texts_are_learnt_from_in_parts(spark):
    long = "good words and more of them. " * 40
    docs = spark.createDataFrame([(i, long if i % 2 else "x9 x9 " * 200) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    found = quality.score_quality(docs, labels, longest=100).collect()  # no text is as short as that
    assert all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in found)


def test_many_lengths_of_rule_paths(spark):
    rules = [("a.com", "/" + "x" * k, "block" if k % 2 else "allow") for k in range(500)]
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, f"http://A.com/{'x' * k}?q") for k in (0, 1, 250, 499, 700)] + [(9, None)], "page_id int, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, frame).collect()}
    want = {k: ("a.com/" + "x" * min(k, 499), "block" if min(k, 499) % 2 else "allow") for k in (0, 1, 250, 499, 700)}
    assert got == want | {9: (None, "allow")}
