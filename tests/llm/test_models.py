import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from helpers import groups, words

from valuefit.llm import multi_index, pieces, pii, quality, toxicity
from valuefit.llm.common import Scratch
from valuefit.llm.kernels import ALNUM, Words

INF, NAN = float("inf"), float("nan")


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1):
        centre = rng.normal(size=8)
        for _ in range(12):
            base = centre + rng.normal(size=8)
            for _ in range(rng.integers(1, 6)):
                rows.append((k, (base + rng.normal(size=8) * 0.06).astype(np.float32).tolist(), label))
                k += 1
    rows += [(k + i, rows[3][1], rows[3][2]) for i in range(40)]  # copies
    k = len(rows)
    odd = [(k, rows[0][1], None), (k + 1, None, 0), (k + 2, [], 0), (k + 3, [0.0] * 8, 0), (k + 4, [NAN] + [1.0] * 7, 0), (k + 5, [None] + [1.0] * 7, 0), (k + 6, [INF] * 8, 0),
           (k + 7, rows[0][1][:5], 0), (k + 8, [1e30] * 8, 1), (k + 9, [1e30] * 7 + [1.01e30], 1), (k + 10, [-1e30] * 8, 1), (None, rows[0][1], 0), (3, rows[3][1], rows[3][2])]
    return rows + odd


@pytest.mark.parametrize("block, per_cell, recall", [(1024, 64, 0.9999), (8, 2, 0.9999), (8, 2, 1.0)])
def test_vectors(spark, block, per_cell, recall):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    usable = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    x = [np.array(r[1], np.float32).astype(float) for r in usable]
    near = lambda a, b: len(a) == len(b) and (a / np.linalg.norm(a)) @ (b / np.linalg.norm(b)) >= 0.98
    links = [(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and usable[i][2] == usable[j][2] and near(x[i], x[j])]
    n = collections.Counter(i for i, _ in links)
    of = groups({r[0] for r in usable}, [(usable[i][0], usable[j][0]) for i, j in links])
    want = collections.Counter((r[0], n[i], of[r[0]], of[r[0]] == r[0]) for i, r in enumerate(usable))
    want.update((r[0], 0, r[0], True) for r in rows if not any(r is u for u in usable))
    found = multi_index.near_vectors(df, block=block, per_cell=per_cell, recall=recall)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert collections.Counter(tuple(r) for r in found.collect()) == want
    assert multi_index.near_vectors(df.limit(0)).count() == 0


def test_no_cell_with_a_link_is_left_out():
    """Recall by brute force, for codebooks that have nothing to do with the vectors."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    x = multi_index._unit(np.concatenate([x, x + 0.12 * rng.normal(size=x.shape)]))
    c1, c2 = 0.3 * rng.normal(size=(20, 8)), 0.3 * rng.normal(size=(20, 8))
    (h1, t1), (h2, t2) = multi_index.bounds(x[:, :8], c1), multi_index.bounds(x[:, 8:], c2)
    at, i, j = multi_index.visits(t1, t2, 0.04)
    seen = set(zip(at.tolist(), i.tolist(), j.tolist()))
    a, b = np.nonzero(x @ x.T >= 0.98)
    assert len(a) > 1000 and all((p, h1[q], h2[q]) in seen for p, q in zip(a.tolist(), b.tolist()))
    assert len(seen) < len(x) * 400
    # and of few visits, nearly none
    few = multi_index.reach(x, c1, c2, 0.98, 0.9999)
    at, i, j = multi_index.visits(t1, t2, few)
    some = set(zip(at.tolist(), i.tolist(), j.tolist()))
    assert len(some) < len(seen) and np.mean([(p, h1[q], h2[q]) in some for p, q in zip(a.tolist(), b.tolist())]) > 0.999


def labelled(n=400, seed=0):
    """Clean and noisy texts; toxic ones hold words of their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "do", "ri", "nu", "el", "sha"]) for _ in range(rng.choice([1, 2, 3])))
    docs, labels = [], []
    for i in range(n):
        ws = [word() for _ in range(rng.choice([20, 60, 150]))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(len(ws) // 8):
                ws[rng.randrange(len(ws))] = rng.choice(["grubble", "snark", "vile"])
        if bad:
            ws = [w + rng.choice(["###", "$$$", "%%%"]) for w in ws]
        docs.append((i, " ".join(ws), "x"))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


EXTRA = [(None, "vile vile vile snark", "x"), (900, None, "x"), (901, "", "x"), (902, "é" * 70000, "x"), (5, "again", "x"), (5, "again", "x")]


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels = labelled()
    d = spark.createDataFrame(docs + EXTRA, "doc_id long, text string, score string").repartition(3)
    la = spark.createDataFrame(labels + [(None, 1, 1), (7, None, None), (902, 5, 7)], "doc_id long, quality int, toxic int")
    return docs, labels, d, la


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers(spark, learnt, kind):
    docs, labels, d, la = learnt
    run = (lambda a, b: quality.score_quality(a, b, sample=300)) if kind == "quality" else toxicity.score_toxicity
    out = run(d, la).collect()
    assert len(out) == len(docs) + len(EXTRA) and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == int(r["score"] >= (0.7 if kind == "quality" else 0.3)) for r in out)
    y = {i: (q if kind == "quality" else t) for i, q, t in labels}
    test = [r for r in out if r["doc_id"] in y and r["held_out"]]
    assert len(test) > 60 and np.mean([r["predicted"] == y[r["doc_id"]] for r in test]) > 0.95
    by = collections.Counter(round(r["score"], 6) for r in out if r["doc_id"] in (900, 901))
    assert len(by) == 1  # null and empty texts score alike
    # held-out labels and other columns change nothing
    flipped = la.selectExpr("doc_id", *(f"case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - {c} else {c} end as {c}" for c in ("quality", "toxic")))
    again = {r["doc_id"]: r["score"] for r in run(d.drop("score"), flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 for r in test if r["doc_id"] != 5)  # 5 names several texts
    assert run(d.limit(0), la.limit(0)).count() == 0
    assert len({r["score"] for r in run(d, la.limit(0)).collect()}) == 1


def test_good_documents_keep_their_columns(learnt):
    docs, labels, d, la = learnt
    out = quality.keep_good(d, la, sample=300)
    assert out.columns == d.columns
    good = {i for i, q, _ in labels if q}
    kept = {r["doc_id"] for r in out.collect()}
    assert len(kept & good) > 0.97 * len(good) and len(kept - good - {None, 900, 901, 902}) < 0.1 * (len(labels) - len(good))


def test_network_gradients():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(1, 250, n, dtype=np.uint8)) for n in (0, 5, 40, 700, 1500)]
    s = quality.Steps(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *(len(t) for t in texts)]))
    y = np.array([1.0, 0, 1, 0, 1])
    p = {k: v.astype(np.float64) for k, v in quality.start(3).items()}
    p["v"] = rng.normal(size=p["v"].shape)

    def loss(q):
        z = quality.forward(s, q)[4]
        return float((np.logaddexp(0, z) - y * z).mean())

    g = quality.gradients(s, y, p)
    for k in p:
        d = rng.normal(size=p[k].shape)
        up, down = (loss({**p, k: p[k] + e * 1e-4 * d}) for e in (1, -1))
        assert abs((up - down) / 2e-4 - (g[k] * d).sum()) < 2e-2 * max(1, abs((g[k] * d).sum()))


def test_windows_cover_the_whole_text():
    """A lone byte anywhere can reach the score."""
    p = quality.start(1)
    base = np.full(3001, 97, np.uint8)
    plain = quality.forward(quality.Steps(base, np.array([0, 3001])), p)[1]
    for at in (0, 7, 511, 512, 1500, 3000):
        other = base.copy()
        other[at] = 35
        assert not np.allclose(quality.forward(quality.Steps(other, np.array([0, 3001])), p)[1], plain)


TEXTS = ["", " ", "Hello  the étés 日本🙂\n\tx", "   a    b ▁▁ d", "a" * 40 + " bbbbb", "def f(x):\n        return x+1  # ok\n\n\n", "\x00 x", "The quick brown fox, 1234567.", "ñandú çà et là"]


def test_pieces_equal_the_public_library():
    import sentencepiece

    own = pieces.Machine(open(pieces.model_path(), "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(0)
    many = TEXTS + ["".join(rng.choice(["th", "er", " ", "  ", "é", "\n", "日", "x", "ing", ".", "0"]) for _ in range(60)) for _ in range(150)]
    for text in many:
        ids = np.frombuffer(own.encode(text), np.int32)
        assert ids.tolist() == library.encode(text)
        if "▁" not in text:
            assert own.decode(ids).decode() == text
    for texts in (many, [t for t in many if "▁" not in t]):
        data = "".join(texts).encode()
        ids, ends, same = own.encode_all(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
        assert [ids[i:j].tolist() for i, j in zip(ends[:-1], ends[1:])] == [library.encode(t) for t in texts]
        assert same.tolist() == ["▁" not in t for t in texts]


def test_segments_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 3000)
    monkeypatch.setattr(pieces, "FREE", 7)
    own = pieces.Machine(open(pieces.model_path(), "rb").read())
    rng = random.Random(5)
    for _ in range(30):
        texts = ["".join(rng.choice(["th", "er", " ", "  ", "é", "\n", "日", "x", "ing", "0"]) for _ in range(rng.randrange(80))) for _ in range(6)]
        data = "".join(texts).encode()
        ids, ends, same = own.encode_all(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
        assert [ids[i:j].tolist() for i, j in zip(ends[:-1], ends[1:])] == [np.frombuffer(own.encode(t), np.int32).tolist() for t in texts]
        assert same.all() and len(own.memo[0]) * 20 + len(own.memo[3]) * 4 < 6000


def test_pairs_by_the_definition_of_merging():
    own = pieces.Machine(open(pieces.model_path(), "rb").read())
    rng, ids = random.Random(3), list(own.id.values())
    short = [i for i in ids if len(own.merges.text[i]) < 4]
    some = [(rng.choice(short), rng.choice(short)) for _ in range(20000)] + [(rng.choice(ids), rng.choice(ids)) for _ in range(5000)]
    some += [(own.id[w[:k]], own.id[w[k:]]) for w in ("aaaa", "▁▁▁▁▁", "======", "00000000", "ababab") for k in range(1, len(w)) if w[:k] in own.id and w[k:] in own.id]
    text = own.merges.text
    assert [own.merges.meet(a, b) for a, b in some] == [own.merges.merged(text[a] + text[b]) == [text[a], text[b]] for a, b in some]


def test_long_texts_without_gaps():
    import sentencepiece

    own = pieces.Machine(open(pieces.model_path(), "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(0)
    text = "".join(rng.choice("日本語人大小中国年月的一是不了在有") for _ in range(4000))
    assert own.path(pieces.MARK + text) == library.encode(text)
    took = []
    for n in (50_000, 200_000):
        start = time.time()
        assert len(own.path((text * (n // 4000)))) > 0
        took.append(time.time() - start)
    assert took[1] < 12 * took[0] + 1


def test_squeezed_gaps():
    normal = pieces.Normaliser(True, True, True)
    assert [normal(t) for t in ("", "  ", " a  b ", "a b")] == ["", "", "▁a▁b", "▁a▁b"]
    assert [pieces.Normaliser(p, False, True)(" a  b ") for p in (True, False)] == ["▁▁a▁▁b▁", "▁a▁▁b▁"]


def test_shortest_path_of_a_unigram_model():
    """Least total weight by brute force over all segmentations."""
    own = pieces.Machine(open(pieces.model_path(), "rb").read())
    rng = random.Random(1)
    vocabulary = ["a", "b", "c", "ab", "bc", "abc", "ca", "aab"]
    own.bpe, own.id, own.rank = False, {w: i for i, w in enumerate(vocabulary)}, {w: rng.random() * len(w) for w in vocabulary}
    own.worst = 50.0
    own.compile()

    def best(word):
        return min([(own.rank[w] + best(word[len(w) :])[0], [own.id[w], *best(word[len(w) :])[1]]) for w in vocabulary if word.startswith(w)], default=(0.0, []) if not word else (np.inf, []))

    for _ in range(40):
        word = "".join(rng.choice("abc") for _ in range(7))
        assert own.path(word) == best(word)[1]


def test_encoding_and_decoding_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None, TEXTS[2]])] + [(None, "a b", "x"), (0, "", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    out = pieces.encode(d)
    got = out.collect()
    assert len(got) == len(rows) and all(r["n_tokens"] == len(r["tokens"]) for r in got)
    assert [r["doc_id"] for r in got if not r["round_trip"]] == [3]  # the mark itself decodes to a space
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(out).collect()}
    assert {(i, t or "") for i, t, _ in rows if i != 3} <= back
    assert pieces.encode(d.limit(0)).count() == 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


KEY = "secret"


def test_pseudonyms(spark):
    cards = [f"{i:015d}" for i in range(10**14, 10**14 + 60 * 7919, 7919)]
    cards = [c + str(next(k for k in range(10) if luhn(c + str(k)))) for c in cards]
    grouped = " ".join(re.findall("....", cards[0]))
    lines = {
        "card": [cards[0], grouped, *cards[1:]], "ip": ["1.2.3.4", "255.0.0.255", "10.0.0.1"], "date": ["1999-12-31", "2024-02-29", "1900-01-01", "2099-12-31"],
        "ssn": ["123-45-6789", "001-01-0001"], "phone": ["+1 (743) 555-3824", "743-555-3824", "(743) 555-3824"], "email": ["a.b@c.example.org"],
    }
    left = ["1234567812345678", "1.2.3.400", "2023-02-30", "000-12-3456", "12345", "x@", "", "1.2.3.4.5", "2100-01-01"]
    rows = [(i, f"see {m}, or {m}.", "x") for i, m in enumerate(m for ms in lines.values() for m in ms)] + [(1000 + i, t, "x") for i, t in enumerate(left)] + [(None, None, "x"), (0, "no data " * 20000, "x"), (0, "no data " * 20000, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, found string")
    out = pii.pseudonymise(d, KEY)
    assert out.columns == ["doc_id", "text", "found"] and out.count() == len(rows)
    got = out.where("doc_id < 1000 and size(found) > 0").collect()
    kinds = [k for k, ms in lines.items() for _ in ms]
    images = collections.defaultdict(set)
    for r in got:
        k, f = kinds[r["doc_id"]], r["found"]
        assert len(f) == 2 and f[0] == f[1] and f[0]["kind"] == k  # equal values stay linked
        a, b = f[0]["original"], f[0]["pseudonym"]
        assert r["text"] == f"see {b}, or {b}." and a != b
        images[k].add(re.sub(r"\D", "", b) if k == "card" else b)
        if k != "email":
            assert re.sub(r"\d+" if k == "ip" else r"\d", "9", a) == re.sub(r"\d+" if k == "ip" else r"\d", "9", b)
        if k == "card":
            assert luhn(re.sub(r"\D", "", b))
        if k == "ip":
            assert all(int(x) < 256 for x in b.split("."))
        if k == "date":
            assert "1900" <= b[:4] <= "2099" and np.datetime64(b)
        if k == "ssn":
            assert b[:3] not in ("000", "666") and b[0] != "9" and b[4:6] != "00" and b[7:] != "0000"
    assert len(got) == len(kinds) and len(images["card"]) == len(cards)  # a permutation; grouping changes no digits
    assert {r["text"] for r in out.where("doc_id >= 1000").collect()} == set(left)
    back = pii.pseudonymise(out.drop("found"), KEY, reverse=True)
    assert {(r["doc_id"], r["text"]) for r in back.collect()} - {(i, t) for i, t, _ in rows} == {(r["doc_id"], r["text"]) for r in back.where("text like '%user%@%'").collect()}
    other = pii.pseudonymise(d, key="other")
    assert out.join(other.withColumnRenamed("text", "t2"), "doc_id").where("doc_id between 1 and 60 and text = t2").count() == 0
    assert pii.pseudonymise(d.limit(0), KEY).count() == 0


def test_dates_are_permuted(spark):
    d = spark.range(0, pii.DAYS, 37).selectExpr("id as doc_id", "cast(date_add(date'1900-01-01', cast(id as int)) as string) as text")
    out = pii.pseudonymise(d, KEY)
    assert out.select("text").distinct().count() == d.count()
    assert out.where("text < '1900-01-01' or text > '2099-12-31'").count() == 0


def test_pipeline_on_a_fixture(spark, tmp_path):
    import corpus_pipeline as cp

    docs, labels = labelled(160, 5)
    extra = [(1000 + i, f"shared footer line\n{docs[i][1]}", "x") for i in range(12)]  # near copies once the line is gone
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in docs + extra], "doc_id long, text string, lang string, source string, n_chars long")
    la = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    words = docs[20][1].split()
    b = spark.createDataFrame([(1, " ".join(words[2:14]))], "item_id long, text string")
    for name, f in (("documents", d), ("labels", la), ("benchmark", b)):
        f.write.parquet(str(tmp_path / f"{name}.parquet"))
    out = d
    for k, (name, stage) in enumerate(cp.STAGES):
        before = out.count()
        out = stage(spark, out, str(tmp_path))
        out = spark.read.parquet(_written(out, tmp_path / f"stage{k}"))
        if name == "line_dedup":
            assert out.count() == before and out.where("text like '%shared footer line%'").count() == 0 and out.where("n_chars <> length(text)").count() == 0
        if name == "minhash_dedup":
            assert out.where("doc_id >= 1000").count() == 0
        if name == "decontaminate":
            assert out.where("doc_id = 20").count() == 0
        if k < 4:
            assert out.columns == d.columns and 0 < out.count() <= before
    assert out.where("not round_trip").count() == 0
    again = cp.run(spark, str(tmp_path))
    key = lambda f: sorted((r["doc_id"], tuple(r["tokens"])) for r in f.collect())
    assert key(again) == key(out)


def _written(df, path):
    df.write.parquet(str(path))
    return str(path)


def test_words_that_share_low_bits_of_their_hash_are_counted_apart(spark):
    """A toxic word tells as much whichever ordinary word it would meet in a table of fixed size."""
    texts = [f"q{i}" for i in range(20000)]
    data = " ".join(texts).encode()
    low = (Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM).hash & np.uint64((1 << 21) - 1)).tolist()
    seen, met = {}, []
    for word, slot in zip(texts, low):
        if slot in seen:
            met.append((seen.pop(slot), word))
        else:
            seen[slot] = word
    bad, good = zip(*met[:8])
    rng, docs, labels = random.Random(4), [], []
    for i in range(400):
        toxic = i % 3 == 0
        ws = [f"z{rng.randrange(100000)}" for _ in range(30)]
        for k in rng.sample(range(30), 6):
            ws[k] = rng.choice(bad if toxic else good)
        docs.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    out = toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    test = [r for r in out if r["held_out"]]
    assert len(test) > 60 and np.mean([r["predicted"] == dict(labels)[r["doc_id"]] for r in test]) > 0.95


def brute_ratio(texts, y, word_discount, stem_discount, pair_discount, both):
    """log P_1(w | v) / P_0(w | v) of all words of all texts, straight from the definition."""
    split = [words(t) for t in texts]
    n = collections.Counter(w for ws in split for w in ws)
    stem = lambda w: w.encode()[:6]
    n_s = collections.Counter()
    for w, k in n.items():
        n_s[stem(w)] += k
    total = sum(n.values())
    two = [collections.Counter((v, w) for ws, c in zip(split, y) if c == k for v, w in zip([None, *ws], ws)) for k in (0, 1)]
    d = lambda k, most: min(k, most)
    given, word_p = [], []
    for k in (0, 1):
        cont = collections.Counter(w for _, w in two[k])
        of_stem = collections.Counter()
        for w, m in cont.items():
            of_stem[stem(w)] += m
        all_, lw, ls = sum(cont.values()), sum(d(m, word_discount) for m in cont.values()), sum(d(m, stem_discount) for m in of_stem.values())
        p_s = lambda s, of_stem=of_stem, all_=all_, ls=ls: (of_stem[s] - d(of_stem[s], stem_discount) + ls * n_s[s] / total) / all_
        p = {w: (cont[w] - d(cont[w], word_discount) + lw * p_s(stem(w)) * n[w] / n_s[stem(w)]) / all_ for w in n}
        assert sum(p.values()) == pytest.approx(1)
        word_p.append(p)
        left, back = collections.Counter(), collections.Counter()
        for (v, w), m in two[k].items():
            left[v] += m
            back[v] += d(m, pair_discount)
        given.append((left, back))
    out = []
    for ws in split:
        rs = []
        for v, w in zip([None, *ws], ws):
            if v is not None and all(g[0][v] >= both for g in given):
                p = [(two[k][v, w] - d(two[k][v, w], pair_discount) + given[k][1][v] * word_p[k][w]) / given[k][0][v] for k in (0, 1)]
                for k in (0, 1):
                    every = sum((two[k][v, x] - d(two[k][v, x], pair_discount) + given[k][1][v] * word_p[k][x]) / given[k][0][v] for x in n) if len(n) < 60 else 1
                    assert every == pytest.approx(1)
            else:
                p = [word_p[k][w] for k in (0, 1)]
            rs.append(np.log(p[1] / p[0]))
        out.append(rs)
    return out


def test_kneser_ney_by_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"{a}{b}" for a in ("common", "strange", "é", "wo", "insult") for b in ("", "a", "bb", "ccc", "9")]
    texts = [" ".join(rng.choice(vocab[: 25 if i % 3 else 12]) for _ in range(rng.choice([0, 1, 5, 40, 90]))) for i in range(60)] + ["insult insulta " * 9, "", "insult insulta " * 9]
    y = [rng.choice([0, 0, 1, None]) for _ in range(60)] + [1, 1, 0]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, r double").repartition(3)
    marks = spark.createDataFrame([(i, k) for i, k in enumerate(y) if k is not None], "doc_id long, toxic int")
    scratch = Scratch(spark, "test")
    table, default = toxicity.ratios(docs, marks, scratch, 2, 3, 1, 4)
    want = brute_ratio(texts, y, 2, 3, 1, 4)
    seen = []
    for most in (1 << 20, 0):  # looked up and joined
        got = {r["doc_id"]: r["x"] for r in toxicity.featured(docs, table, default, Scratch(spark, "test"), most).collect()}
        for i, rs in enumerate(want):
            best = sorted(rs, reverse=True)
            mean = np.mean(rs) if rs else 0
            runs = [np.mean(rs[k : k + 8]) for k in range(len(rs) - 7)] or [mean]
            assert got[i] == pytest.approx([mean, max(runs) if len(rs) > 8 else mean, sum(best[:2]) / 2, sum(best[:3]) / 3], abs=2e-5)
        seen.append(got)
    assert {r["kind"] for r in table.select("kind").distinct().collect()} == {0, 1, 2, 3}


def feistel(value, left, right, tweak, key=KEY):
    prf = lambda i, half: int(hashlib.sha256(f"{key}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)
    l, r = divmod(value, right)  # noqa: E741
    for i in range(10):
        if i % 2 == 0:
            l = (l + prf(i, r) % left) % left  # noqa: E741
        else:
            r = (r + prf(i, l) % right) % right
    return l * right + r


def brute_pseudonym(kind, m):
    d = re.sub(r"\D", "", m)
    digits = lambda x, kind: f"{feistel(int(x), 10 ** (len(x) // 2), 10 ** (len(x) - len(x) // 2), f'{kind}{len(x)}'):0{len(x)}d}"
    fill = lambda new: "".join(c if not c.isdigit() else next(it) for it in [iter(new)] for c in m)
    if kind == "ip":
        n = feistel(sum(int(x) << s for x, s in zip(m.split("."), (24, 16, 8, 0))), 1 << 16, 1 << 16, "ip")
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "date":
        n = int((np.datetime64(m) - np.datetime64("1900-01-01")).astype(int))
        while (n := feistel(n, 271, 271, "date")) >= 73049:
            pass
        return str(np.datetime64("1900-01-01") + n)
    if kind == "ssn":
        bad = lambda x: x[:3] in ("000", "666") or x[:3] >= "900" or x[3:5] == "00" or x[5:] == "0000"
        while bad(d := digits(d, "ssn")):
            pass
        return fill(d)
    if kind == "phone":
        return fill(d[:-10] + digits(d[-10:], "phone"))
    body = digits(d[:-1], "card")
    return fill(body + next(c for c in "0123456789" if luhn(body + c)))


def test_pseudonyms_by_another_feistel(spark):
    cards = ["4111111111111111", "4111 1111 1111 1111", "3782-822463-10005", "41111 11111 11111 1"]
    some = [("card", c) for c in cards] + [("ip", "10.1.255.3"), ("date", "1987-06-05"), ("ssn", "123-45-6789"), ("phone", "+1 (743) 555-3824"), ("phone", "743.555.3824")]
    d = spark.createDataFrame([(i, f"x {m}; y", 1, i) for i, (_, m) in enumerate(some)], "doc_id long, text string, m int, matches int")
    out = pii.pseudonymise(d, KEY)
    assert out.columns == ["doc_id", "text", "m", "matches", "found"]
    for r in out.collect():
        kind, m = some[r["doc_id"]]
        assert r["text"] == f"x {brute_pseudonym(kind, m)}; y" and r["m"] == 1 and r["matches"] == r["doc_id"]
    with pytest.raises(ValueError):
        pii.pseudonymise(d, "")


def test_cards_beside_other_numbers(spark):
    lines = ["paid 12 4111111111111111 today", "order 7 4111 1111 1111 1111", "4111111111111111 12", "1 2 3 4111-1111-1111-1111 4 5", "call 555 4111111111111111 and 4111111111111111"]
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string"), KEY).collect()
    assert [[f["kind"] for f in r["found"]] for r in sorted(got)] == [["card"]] * 4 + [["card"] * 2]
    assert all("4111" not in r["text"] for r in got)


def test_the_worst_texts_of_each_pattern(spark):
    n = 10**6
    parts = ["a@b" + ".c" * (n // 2), "a" * n, "a@" * (n // 2), "1." * (n // 2), "1 " * (n // 2), "1" * n, "1-" * (n // 2), "4111 " * (n // 5), "2020-01-" * (n // 8), "+1 (" * (n // 4), "12 3456789012345678901 " * (n // 24)]
    start = time.time()
    rows = [(i, t) for i, t in enumerate(parts)]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id int, text string").repartition(8), KEY).selectExpr("doc_id", "size(found) n", "length(text) l").collect()
    assert len(got) == len(parts) and time.time() - start < 120
    assert {r["doc_id"]: r["n"] for r in got}[0] == 1


def test_long_texts_in_parts():
    rng = np.random.default_rng(2)
    p = {k: v if k != "v" else rng.normal(size=v.shape).astype(np.float32) for k, v in quality.start(2).items()}
    for n in (0, 1, 8, 511, 512, 513, 4096 * 3, 40_001):
        data = rng.choice(np.frombuffer(b"abc \xc3\xa9", np.uint8), n)
        whole = quality.forward(quality.Steps(data, np.array([0, n])), p)[4][0]
        assert all(quality.forward_long(data, p, k) == pytest.approx(whole, abs=1e-4) for k in (1, 3, 1000))


def plain_forward(text, p):
    """The quality network by loops over bytes, steps and chunks."""
    b, n = list(text), max(-(-len(text) // 8), 1)
    at = lambda j: b[j] if 0 <= j < len(b) else 0

    def step(s):
        own = range(8 * s, 8 * s + 8)
        letters = np.concatenate([p["e"][at(j)] for j in own])
        repeats = [sum(at(j) != 0 and at(j) == at(j - lag) for j in own) / 8 for lag in range(2, 26)]
        return np.concatenate([letters, repeats])

    x = [step(s) for s in range(n + 3)]
    z = [np.maximum(sum(x[s + t] @ p["w"][t].astype(float) for t in range(4)) + p["b"], 0) for s in range(n)]
    tops = [np.max(z[c : c + 64], axis=0) for c in range(0, n, 64)]
    logit = np.concatenate([np.max(tops, axis=0), np.mean(tops, axis=0)]) @ p["v"] + p["c"][0]
    return 1 / (1 + np.exp(-logit))


def test_quality_network_by_plain_loops():
    rng = random.Random(7)
    p = quality.start(3)
    texts = [b"", b"a", b"abababab" * 9, "é日本 text, ".encode() * 70, bytes(rng.randrange(1, 256) for _ in range(1300)), b"x" * 511, b"\x00y\x00" * 20]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = [plain_forward(t, p) for t in texts]
    assert np.allclose(quality.predict(data, offsets, p), want, atol=1e-5) and len({round(w, 4) for w in want}) == len(want)
