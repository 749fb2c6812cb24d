import collections
import random

import pytest
from helpers import LOWER
from pyspark.sql import functions as F

from valuefit.llm.common import Scratch
from valuefit.llm.line_dedup import LineRuns, dedup_lines, new_lines
from valuefit.llm.url_filter import RULES, filter_urls, rules_frame


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut].translate(LOWER), rest[cut:]
    cut = min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))
    path = rest[:cut]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/", "http://a.com", "http://a.com/x?y#z", "https://www.Example.com/en/1",
    "https://example.com/en", "https://example.com/en/", "http://notexample.com/en/1", "http://x.net/es/1", "http://x.net/fr/?q",
    "http://x.net?/fr/", "ftp://net/fr/1", "http://a..net/es/", "http://u:p@b.example.com/en/#x", "http://x.org/://y.com/", "http://é.com/é",
    "http://" + "a." * 60 + "com/" + "p/" * 500, "http://x.net/es/1",
]


@pytest.mark.parametrize("most", [100, 0])
def test_urls(spark, most):
    rows = [(i if i % 7 else None, u, f"x{i}") for i, u in enumerate(URLS)] + [(3, URLS[3], "again")]
    frame = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = [*RULES, ("é.com", "/é", "block"), ("com", "/", "allow")]
    found = filter_urls(frame, rules_frame(spark, rules), broadcast_rows=most)
    got = collections.Counter(tuple(r) for r in found.select("page_id", "url", "host", "path", "rule", "verdict").collect())
    assert got == collections.Counter((k, u, *judge(u, rules)) for k, u, _ in rows)


def test_urls_without_rules_or_rows(spark):
    frame = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in filter_urls(frame, rules_frame(spark, [])).collect()] == [(1, "a.com", "/", None, "allow", "http://a.com/")]
    assert filter_urls(frame.limit(0), rules_frame(spark)).count() == 0


def dropped(texts, least):
    keys = [[x.strip(" \t\n\x0b\f\r").translate(LOWER) for x in (t or "").split("\n")] for t in texts]
    n = collections.Counter(k for ks in keys for k in set(ks))
    out = []
    for t, ks in zip(texts, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks) if not (len(k) >= 1 and n[k] >= least)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("most", [1000, 0])
def test_lines(spark, most):
    texts = ["Menu\nunique %d\n\n  menu \x0b" % i for i in range(6)] + [None, "", "\n", "MENU", "é\nÉ\né", "menu\n" * 3000, "menu", "a\n\nmenu\n", " menu"]
    rows = [(i if i % 5 else None, t, "s", "en", 9) for i, t in enumerate(texts)] + [(1, texts[1], "s", "en", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_dropped int")
    found = dedup_lines(frame, min_docs=3, fanout=2, broadcast_rows=most)
    assert found.columns == ["doc_id", "text", "source", "lang", "n_lines", "n_dropped"]
    want = collections.Counter((r[0], *w) for r, w in zip(rows, dropped([r[1] for r in rows], 3)))
    assert collections.Counter(tuple(r) for r in found.select("doc_id", "text", "n_lines", "n_dropped").collect()) == want
    assert dedup_lines(frame.limit(0)).count() == 0


@pytest.mark.parametrize("batches,fanout", [(1, 4), (4, 4), (4, 2), (16, 3)])
def test_lines_do_not_depend_on_batches(spark, batches, fanout):
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(["x", "Y", " y", "z %d" % rng.randrange(9), "once %d" % i]) for _ in range(rng.randrange(1, 9))) for i in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = dedup_lines(frame, min_docs=4, batches=batches, fanout=fanout)
    want = collections.Counter((i, *w) for i, w in enumerate(dropped(texts, 4)))
    assert collections.Counter(tuple(r) for r in found.select("doc_id", "text", "n_lines", "n_dropped").collect()) == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lines_")]


def test_a_batch_meets_the_runs_without_a_shuffle(spark):
    runs = LineRuns(spark, Scratch(spark, "test"), buckets=4)
    frames = [spark.createDataFrame([(b, f"common\nline {b}\nline {b // 2}")], "doc_id long, text string") for b in range(3)]
    for f in frames[:2]:
        runs.add(f)
    counts = runs._save(runs.counts(frames[2], F.lit(0), 1), "next", "batch").where("batch = 0")
    for run in runs.levels[0]:
        counts = counts.join(runs._read(run).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    assert counts.count() == 1  # "line 2" alone: the batch before has "line 1"
    runs.close()


def test_runs_are_compacted_and_new_lines_found(spark):
    runs = LineRuns(spark, Scratch(spark, "test"), fanout=2)
    seen, names = set(), []
    for b in range(5):
        texts = [f"common\nbatch {b}\nline {b // 2}"]
        frame = spark.createDataFrame([(b, t) for t in texts], "doc_id long, text string")
        fresh = {r["key"] for r in new_lines(frame, runs).collect()}
        keys = set(texts[0].split("\n"))
        assert fresh == keys - seen
        seen |= keys
        names.append([len(x) for x in runs.levels])
    assert names == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    assert {r["n"] for r in runs.all().collect()} == {1, 2, 5}
