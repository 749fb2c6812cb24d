import collections
import itertools
import random

import numpy as np
import pytest
from helpers import groups, shingles, words

from valuefit.llm import license_scan, minhash
from valuefit.llm.decontaminate import decontaminate, find_contamination
from valuefit.llm.kernels import ALNUM, NOT_SPACE, Words
from valuefit.llm.license_scan import PHRASES, scan_licenses


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "日本", "A", "the"]
    return [" ".join(rng.choice(vocab) + rng.choice(["", ".", ",", "\n"]) for _ in range(rng.choice([0, 1, 3, 9, 12, 60, 300]))) for _ in range(n)]


def test_words_of_bytes():
    texts = ["", "  ", "Ab c", "é,Ü 9x", "", "tail", "tail"]
    for table, pattern in ((ALNUM, words), (NOT_SPACE, lambda t: t.translate(minhash_lower).split())):
        data = "".join(texts).encode()
        offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
        w = Words(np.frombuffer(data, np.uint8), offsets, table)
        got = [[w.text(i, 1) for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
        assert got == [pattern(t) for t in texts]
        assert w.hash[-1] == w.hash[-2] and len(set(w.hash.tolist())) == len(w.hash) - 1


minhash_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contamination(text, items, n=10):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        v = words(t)
        if not v:
            continue
        size = min(n, len(v))
        windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                ids.add(item)
    return len(w), len(hit), sorted(str(i) for i in ids if i is not None)


def test_shingles_of_repeated_words():
    texts = [" ".join(w) for n in (3, 5, 7) for w in itertools.product("pq", repeat=n)]
    data, offsets = "".join(texts).encode(), np.cumsum([0, *map(len, texts)])
    sets = minhash.shingle_sets(Words(np.frombuffer(data, np.uint8), offsets, NOT_SPACE))
    exact = [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in exact]
    assert len({tuple(s.tolist()) for s in sets}) == len(set(map(frozenset, exact)))


@pytest.mark.parametrize("most", [10**6, 0])
def test_contamination(spark, most):
    texts = corpus(1)
    items = [(i, t) for i, t in enumerate(corpus(2, 8))] + [(10, "w1 w2"), (11, None), (12, ""), (None, "w3 w4"), (13, "é"), (2, texts[3])]
    texts += [f"x y {items[k][1]} z" for k in range(8)] + [None, "", "w1, W2 w1 w2", "w3 w4", "a b " + " ".join(words(items[-1][1])[3:14])]
    rows = [(i if i else None, t, "s") for i, t in enumerate(texts)] + [(5, texts[5], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(docs, bench, broadcast_prints=most, broadcast_windows=most)
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found.collect())
    want = collections.Counter()
    for i, t, _ in rows:
        n, hit, ids = contamination(t, items)
        want[(i, n, hit, tuple(ids))] += 1
    assert got == want
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(n for k, n in want.items() if k[2] == 0)
    assert find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert find_contamination(docs.limit(0), bench).count() == 0


def alike(seed=3):
    """Texts with copies, near copies, a base whose copies are linked only to it, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = ["", None, "one", "ONE ", "one two", "a b c d e", "a b c d e", "a b c d e f"]
    for size, copies in [(8, 1), (30, 6), (30, 0), (60, 6), (120, 20), (120, 20), (400, 6)]:
        family = [[word() for _ in range(size)]]
        for _ in range(copies):  # copies of copies drift out of reach of the first text
            copy = list(rng.choice(family))
            for _ in range(rng.choice([1, 2, 3])):
                copy[rng.randrange(size)] = word()
            family.append(copy)
        texts += [" ".join(x) for x in family]
    return texts


def test_near_duplicates(spark):
    texts = alike()
    rows = [(100 - i, t, "x") for i, t in enumerate(texts)] + [(91, texts[9], "x"), (None, texts[9], "x"), (None, "alone here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    sets = {100 - i: shingles(t) for i, t in enumerate(texts)}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    of = groups(ids, links)
    unlike = sum(of[a] == of[b] for a in ids for b in ids if a < b) - len(links)
    assert len(links) > 60 and unlike > 20  # components hold pairs that are no links
    want = collections.Counter((i, len(sets[i]), of[i], of[i] == i) for i in ids)
    want[(91, len(sets[91]), of[91], of[91] == 91)] += 1
    want[(None, len(sets[91]), of[91], False)] += 1
    want[(None, 1, None, True)] += 1
    for most in (10**6, 0):
        found = minhash.near_duplicates(docs, broadcast_rows=most)
        assert collections.Counter(tuple(r) for r in found.collect()) == want
    kept = minhash.dedup_documents(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} - {None} == {i for i in ids if of[i] == i}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    for n in (3, 40, 700):
        errors = []
        for _ in range(30):
            x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = np.sort(x[: int(1.5 * n)]), np.sort(x[n // 2 :])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            sig = minhash.signatures([a, b])
            errors.append((sig[0] == sig[1]).mean() - true)
        assert abs(np.mean(errors)) < 0.03
        assert np.std(errors) < np.sqrt(0.25 / minhash.SLOTS) * 1.15


def test_bands_find_links():
    """At the threshold itself nearly no pair is without a common band."""
    rng = np.random.default_rng(1)
    missed = 0
    for n in (4, 8, 20, 100):
        for _ in range(250):
            x = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = minhash.bands(minhash.signatures([np.sort(x), np.sort(x[: -(-3 * n // 4)])]))
            missed += not (b[0] == b[1]).any()
    assert missed <= 1


def test_licenses(spark):
    texts = [
        None, "", "CC BY cc-by", "x all rights reserved. All Rights\nReserved", "General public license", "all rights all rights reserved",
        "Licensed under the Apache License, Version 2.0.", "Apache License, Version 2.0", "license apache the under licensed",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "cc", "by cc by",
        "word " * 5000 + "licensed under the apache license version 2 0", "Apache License, Version 3.0",
    ] + [f"the plain text under number {i}" for i in range(40)]
    rows = [(i if i != 4 else None, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    got = scan_licenses(docs).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        w = words(t)
        at = {p: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p in PHRASES}
        every = sorted(k for v in at.values() for k in v)
        labels = ",".join(sorted({PHRASES[p] for p, v in at.items() if v}))
        want[(i, len(w), len(every), every[0] if every else None, every[-1] if every else None, labels)] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[6]["labels"] == "apache-2.0" and by[13]["labels"] == "apache-2.0" and by[13]["places"][0]["word"] == 5000
    assert by[8]["labels"] == "" and by[14]["labels"] == "" and by[8]["score"] == 0
    assert by[9]["labels"] == "gpl,gpl-3.0" and by[10]["labels"] == "cc-by,cc-by-nc-4.0"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert scan_licenses(docs.limit(0)).count() == 0


def test_every_notice_form(spark):
    """The notices that occur in the documents, short references and whole texts."""
    forms = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "All rights reserved.": "all-rights-reserved,reserved", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Under a BSD license": "bsd", "BSD-3-Clause": "bsd",
        "Mozilla Public License, version 2.0": "mpl-2.0", "MPL 1.1": "mpl-1.1", "CC BY-SA 3.0": "cc-by,cc-by-sa-3.0", "https://creativecommons.org/licenses/by-nc-nd/2.5/": "cc-by-nc-nd-2.5",
        "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa-4.0", "Released into the public domain": "public-domain", "GPLv2 or later": "gpl-2.0", "CC0": "cc0-1.0",
        "the mit students asked for a licence": "", "Mozilla Public License 3.0": "", "cc by 9": "cc-by",
    }
    folder = license_scan.Path(license_scan.__file__).parent / "licenses"
    whole = [((folder / f"{file}.txt").read_text(), label) for file, (label, _) in license_scan.TEXTS.items()]
    rows = [(i, f"some words before {t} and after") for i, t in enumerate(forms)] + [(1000 + i, "x " * i + t) for i, (t, _) in enumerate(whole)] + [(5000 + i, f"plain text {i}") for i in range(60)]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i]["labels"] for i, t in enumerate(forms)} == forms
    assert all((got[i]["score"] > 0) == bool(w) for i, w in enumerate(forms.values()))
    assert all(label in got[1000 + i]["labels"].split(",") for i, (_, label) in enumerate(whole))
    cut = license_scan.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(whole)], "doc_id long, text string"), templates=[x for x in license_scan.all_templates() if len(x[1].split()) > 100]).collect()
    assert all(whole[r["doc_id"]][1] in r["labels"].split(",") for r in cut)


def test_license_labels_by_brute_force(spark):
    """Every template at every place where its key phrase stands, with ties of alignments and of frequencies."""
    rng = random.Random(5)
    own = [("a", "one two three four five six seven eight nine ten", "three four"), ("b", "two three four nine", "two three"), ("c", "ten ten one", "ten"), ("a", "six six six seven", "six seven")]
    vocab = "one two three four five six seven eight nine ten eleven twelve".split()
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 2, 8, 40]))) for _ in range(60)] + [own[0][1], "x " + own[0][1] + " " + own[0][1], "four five six seven", None]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, r1 long")
    seen = collections.Counter(w for t in texts for w in set(words(t)))
    for rare, most in ((1, 10**6), (3, 0)):
        got = {r["doc_id"]: r for r in scan_licenses(docs, templates=own, rare=rare, broadcast_rows=most).collect()}
        for i, t in enumerate(texts):
            w, want, best = words(t), set(), 0.0
            for label, notice, key in own:
                notice, key = notice.split(), key.split()
                weight = {x: license_scan._idf(len(texts), seen[x]) for x in notice}
                chosen = sorted(weight, key=lambda x: (-weight[x], x))[:rare]
                start = next(k for k in range(len(notice)) if notice[k : k + len(key)] == key)
                held = [(x, k) for k, x in enumerate(notice) if x in chosen or start <= k < start + len(key)]
                for at in range(-len(notice), len(w) + 1):
                    stands = lambda k: 0 <= at + k < len(w) and w[at + k] == notice[k]  # noqa: B023, E731
                    if all(stands(k) for k in range(start, start + len(key))):
                        share = sum(weight[x] for x, k in held if stands(k)) / sum(weight[x] for x, _ in held)
                        if share >= 0.6 - 1e-12:
                            want.add((label, at))
                            best = max(best, share)
            assert {(p["label"], p["word"]) for p in got[i]["places"]} == want
            assert got[i]["score"] == pytest.approx(best) and got[i]["labels"] == ",".join(sorted({x for x, _ in want}))


def test_signatures_in_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 5, 300, 2000)]
    whole = minhash.signatures(sets)
    monkeypatch.setattr(minhash, "BLOCK", 37)
    assert (minhash.signatures(sets) == whole).all()
