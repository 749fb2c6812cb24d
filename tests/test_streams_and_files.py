"""Streaming state, readers and writers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuefit.operators import heads, ledger, neural, stats
from valuefit.sources import schemas, tables
from valuefit.sources.scratch import shared_folder
from valuefit.streaming.cumulative import CumulativeHead, replay, write_step, write_steps


def updates(spark, step, n=8, width=2, seed=0):
    rng = np.random.default_rng([seed, step])
    rows = []
    for a in range(n):
        for p in range(3):
            rows.append((step, f"{step}-{a}", str(a // 2), p, rng.normal(size=width).tolist(), float(a % 2) if p == 2 else 0.0))
    return spark.createDataFrame(rows, "step int, answer_id string, question_id string, position int, x array<double>, reward double")


@pytest.mark.parametrize("decay", [1.0, 0.9])
def test_stream_equals_batch(spark, tmp_path, decay):
    frames = [updates(spark, s) for s in (1, 2, 3)]
    for step, f in enumerate(frames, 1):
        write_step(f.repartition(4), str(tmp_path / "in"), step)
    head = CumulativeHead(spark, str(tmp_path / "head"), decay=decay)
    log = replay(frames[0], head, str(tmp_path / "in"), str(tmp_path / "checkpoint"))
    assert sorted((r["step"], r["answers"], r["transitions"]) for r in log.collect()) == [(1, 8, 24), (2, 16, 48), (3, 24, 72)]
    every = frames[0].unionByName(frames[1]).unionByName(frames[2])
    y = every.groupBy("answer_id").agg(F.max("reward").alias("y"))
    rows = every.join(y, "answer_id").withColumn("question", F.col("answer_id")).withColumn("response", F.lit(0))
    s = stats.collect_statistics(stats.lstd_partials(rows, decay))[""]
    state = head.load(3)[""]
    assert np.allclose(state["a"], s["a"]) and np.allclose(state["b"], s["b"])
    assert head.update(frames[2].repartition(2), 3) is None  # a replay changes nothing
    with pytest.raises(ValueError, match="other rows"):
        head.update(frames[2].where("answer_id <> '3-0'"), 3)
    with pytest.raises(ValueError, match="consecutive"):
        head.update(updates(spark, 5), 5)


def test_epochs_folds_and_contracts(spark, tmp_path):
    head = CumulativeHead(spark, str(tmp_path / "h"), interval=2)
    for s in (1, 2, 3):
        head.update(updates(spark, s), s, (s - 1) // 2)
    assert head.load(3)[""]["answers"] == 8 and head.load(2)[""]["answers"] == 16
    with pytest.raises(ValueError, match="epoch"):
        head.update(updates(spark, 4), 4, 0)
    with pytest.raises(ValueError, match="contract"):
        head.update(updates(spark, 4).withColumn("reward", F.lit(0.5)), 4)
    with pytest.raises(ValueError, match="width"):
        head.update(updates(spark, 4, width=3), 4)
    folds = spark.createDataFrame([(str(i), i % 2) for i in range(4)], "id string, fold int")
    both = CumulativeHead(spark, str(tmp_path / "f"), folds=folds)
    out = both.update(updates(spark, 1), 1)
    assert out.count() == 24 and set(both.load(1)) == {"0", "1"}
    first = CumulativeHead(spark, str(tmp_path / "p"), order="predict_first")
    assert {r[0] for r in first.update(updates(spark, 1), 1).select("value").collect()} == {0.0}


def test_answers_are_added_once(spark, tmp_path):
    head = CumulativeHead(spark, str(tmp_path / "h"), decay=0.9, by_answer=True)
    seen = updates(spark, 1)
    head.update(seen, 1)
    for step in range(2, 7):  # each update brings four new answers and all that came before, in another order
        new = updates(spark, step, n=4)
        seen = seen.unionByName(new)
        values = head.update(seen.withColumn("step", F.lit(step)).repartition(3), step)
        assert values.count() == seen.count() and values.where("value is null").count() == 0
    runs = head._ledger().where("step = 6").first()["runs"]
    assert sorted(r.split("-")[0] for r in runs) == ["level0", "level0", "level1"]  # four runs became one
    assert {x.name for x in (tmp_path / "h" / "answers").iterdir()} == set(runs)
    log = {r["step"]: (r["answers"], r["repeated"]) for r in spark.read.parquet(str(tmp_path / "h" / "metrics")).collect()}
    assert log == {s: (4 + 4 * s, 0 if s == 1 else 4 * s) for s in range(1, 7)}
    once = CumulativeHead(spark, str(tmp_path / "o"), decay=0.9)
    once.update(seen.withColumn("step", F.lit(1)), 1)
    a, b = head.load(6)[""], once.load(1)[""]
    assert np.allclose(a["a"], b["a"]) and np.allclose(a["b"], b["b"]) and np.allclose(a["w"], b["w"]) and a["n"] == b["n"]
    changed = seen.withColumn("x", F.when(F.col("answer_id") == "3-1", F.transform("x", lambda v: v + 1)).otherwise(F.col("x"))).withColumn("step", F.lit(7))
    with pytest.raises(ValueError, match="1 answers have changed .*3-1"):
        head.update(changed, 7)
    with pytest.raises(ValueError, match="changed"):  # a row less is a change too
        head.update(seen.where("answer_id <> '2-0' or position < 2").withColumn("reward", F.lit(0.0)).withColumn("step", F.lit(7)), 7)
    assert head.last_step() == 6
    head.update(updates(spark, 7, n=1), 7)
    assert head.load(7)[""]["answers"] == 29


def test_an_epoch_starts_its_ledger_anew(spark, tmp_path):
    head = CumulativeHead(spark, str(tmp_path / "h"), interval=2, by_answer=True)
    for step in (1, 2, 3):
        head.update(updates(spark, 1).withColumn("step", F.lit(step)), step)
    log = {r["step"]: (r["answers"], r["repeated"]) for r in spark.read.parquet(str(tmp_path / "h" / "metrics")).collect()}
    assert log == {1: (8, 0), 2: (8, 8), 3: (8, 0)}


def test_waiting_steps_are_added_together(spark, tmp_path, monkeypatch):
    """Answers come again in the next step; statistics start anew after two steps; the fourth step is in the second group."""
    every = updates(spark, 1)
    for s in (2, 3, 4):
        every = every.unionByName(updates(spark, s, n=4)).unionByName(updates(spark, s - 1, n=4).withColumn("step", F.lit(s)))
    folds = spark.createDataFrame([(str(i), i % 2) for i in range(4)], "id string, fold int")
    make = lambda name: CumulativeHead(spark, str(tmp_path / name), decay=0.9, interval=2, folds=folds, order="predict_first", by_answer=True, group=3)
    one, many = make("one"), make("many")
    for s in (1, 2, 3, 4):
        one.update(every.where(F.col("step") == s), s)
    write_steps(every, str(tmp_path / "in"))
    groups, whole = [], CumulativeHead.update_many
    monkeypatch.setattr(CumulativeHead, "update_many", lambda self, batch, steps, *a: groups.append(steps) or whole(self, batch, steps, *a))
    log = replay(every, many, str(tmp_path / "in"), str(tmp_path / "checkpoint"))
    assert groups == [[1, 2, 3], [4]]
    columns = ["step", "epoch", "transitions", "answers", "repeated", "prefixes", "questions", "brier"]
    rows = lambda df, *c: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*c).collect())
    assert rows(log, *columns) == rows(spark.read.parquet(f"{one.path}/metrics"), *columns) and {r["repeated"] for r in log.collect()} == {0, 4}
    values = ["step", "answer_id", "position", "fold", "value"]
    assert rows(spark.read.parquet(f"{many.path}/values"), *values) == rows(spark.read.parquet(f"{one.path}/values"), *values)
    for k, s in one.load(4).items():
        assert np.allclose(s["a"], many.load(4)[k]["a"]) and np.allclose(s["w"], many.load(4)[k]["w"]) and s["n"] == many.load(4)[k]["n"]


def test_waiting_steps_are_read_and_dealt_once(spark, tmp_path):
    every = updates(spark, 1)
    for s in range(2, 7):
        every = every.unionByName(updates(spark, s))
    every.write.parquet(str(tmp_path / "rows"))
    head, sc = CumulativeHead(spark, str(tmp_path / "h"), interval=2, order="predict_first"), spark.sparkContext
    sc.setJobGroup("waiting", "a group of steps")
    try:
        out = head.update_many(spark.read.parquet(str(tmp_path / "rows")), [1, 2, 3, 4, 5, 6])
        jobs = len(sc.statusTracker().getJobIdsForGroup("waiting"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == 6 * 24 and head.load(6)[""]["answers"] == 16
    assert jobs <= 25  # 31 when each check read the rows


def test_steps_before_a_wrong_one_are_added(spark, tmp_path):
    head = CumulativeHead(spark, str(tmp_path / "h"), by_answer=True)
    changed = updates(spark, 1, n=2).withColumns({"step": F.lit(2), "x": F.transform("x", lambda v: v + 1)})
    with pytest.raises(ValueError, match="2 answers have changed .*1-0"):
        head.update_many(updates(spark, 1).unionByName(changed), [1, 2])
    assert head.last_step() == 1
    with pytest.raises(ValueError, match="consecutive: 4 after 2"):
        head.update_many(updates(spark, 2).unionByName(updates(spark, 4)), [2, 4])
    assert head.last_step() == 2 and head.load(2)[""]["answers"] == 16


def test_scratch_needs_a_shared_folder(spark):
    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_folder(Session(), "x")


def test_readers(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"problem": "a", "answer": "1"}\n\n{"problem": "b", "answer": "2"}\n')
    q = tables.read_questions(spark, str(tmp_path / "q.jsonl"), {"problem": "question"})
    assert q.count() == 2 and "question" in q.columns
    with pytest.raises(ValueError, match="nothing"):
        schemas.require_columns(q, "nothing")
    good = {"id": "a", "level": 1, "ground_truth": "1", "response": "x", "score": 1, "response_tokens": 3, "capped": False, "verifier_status": "correct", "extracted": "1"}
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({**good, "id": i}) for i in "ab"))
    assert tables.read_answers(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({**good, "score": s}) for s in (0, 1)))
    with pytest.raises(ValueError):
        tables.read_answers(spark, str(tmp_path / "b.jsonl"))
    (tmp_path / "acct").write_text("200|200|COMPLETED|3600|8|cpu=8,gres/gpu=1|2025-01-01T00:00:00|Unknown\n200.b|200.batch|COMPLETED|1|1|x|y|z\n")
    got = ledger.allocations(tables.read_accounting(spark, str(tmp_path / "acct"))).collect()
    assert len(got) == 1 and got[0]["gpu_hours"] == 1 and got[0]["cpu_hours"] == 8 and got[0]["end"] is None
    (tmp_path / "jobs.tsv").write_text("fit\t100\n")
    assert tables.read_ledger(spark, str(tmp_path / "jobs.tsv")).first()["job"] == "100"
    (tmp_path / "rank-3.jsonl").write_text('{"update": 1, "lr": 0.5}\n')
    assert tables.read_metrics(spark, str(tmp_path / "rank-3.jsonl")).first()["rank"] == 3
    (tmp_path / "s.jsonl").write_text('{"question": "a", "prefix": "x"}\n{"question": "b", "prefix_token_ids": [1]}\n{"question": "c"}\n{"question": "d", "prefix_token_ids": [-1]}\n')
    s = tables.read_states(spark, str(tmp_path / "s.jsonl"))
    assert [r[0] for r in s.where(tables.state_violation()).orderBy("ordinal").select("question").collect()] == ["c", "d"]


def test_writers(spark, tmp_path):
    q = spark.createDataFrame([("1", 1, "q1", "7", "train"), ("2", 2, "q2", "8", "test")], "id string, source_index long, question string, reference string, split string")
    with pytest.raises(ValueError, match="val"):
        tables.write_online(q, str(tmp_path / "o"), "s", "I")
    tables.write_online(q, str(tmp_path / "o"), "s", "I", ("train", "test"))
    r = spark.read.parquet(str(tmp_path / "o")).where("split = 'test'").first()
    assert r["reward_model"]["ground_truth"] == "8" and r["prompt"][1]["content"] == "q2" and r["extra_info"]["prompt_id"] == "2"
    with pytest.raises(Exception):
        tables.write_online(q, str(tmp_path / "o"), "s", "I", ("train", "test"))
    p = spark.createDataFrame([("d", 5, "a", 1, "q", 0, 1.0, 0.5)], "domain string, budget int, arm string, seed int, question string, position int, y double, value double")
    tables.write_predictions(p, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    tables.write_audit({("m", 1): q, ("m", 2): q}, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 4


def test_payloads(spark, tmp_path):
    import hashlib

    payload = {"question_id": "q", "é": [1, 2]}
    sha = hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()
    (tmp_path / "a.json").write_text(json.dumps({"payload": payload, "sha256": sha}, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps({"payload": {**payload, "x": 1}, "sha256": sha}))
    rows = tables.read_wrapped(spark, str(tmp_path / "*.json"), "question_id string")
    bad = ledger.changed_payloads(rows).collect()
    assert len(bad) == 1 and bad[0]["file"].endswith("b.json") and bad[0]["payload"]["question_id"] == "q"


def test_networks_learn(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 6))
    y = (np.abs(x[:, 0]) + x[:, 1] > 0.7).astype(float)
    df = spark.createDataFrame([(str(i % 40), r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y))], "question string, x array<double>, y double").repartition(4)
    fit = neural.fit_mlp(df, df, hidden=8, epochs=25, steps=1, rate=0.1, patience=None)
    scores = [h[2] for h in fit["history"]]
    assert fit["score"] == min(scores) < 0.6 * scores[0]
    again = neural.fit_mlp(df, df, hidden=8, epochs=1, steps=1, rate=5.0, warm=fit["params"])
    assert again["epoch"] == 0 and again["score"] == fit["score"]
    c = neural.fit_compressor(df, df, 5, epochs=3, steps=1)
    z = neural.transform(c, df)
    assert len(z.first()["x"]) == 5 and heads.ridge_fit(z, z)["score"] < 0.25


def bucket_of(spark, df, steps):
    """The step of each row of an epoch, by position ``i``."""
    rows = df.select("i", F.pmod(F.xxhash64(F.col("x").cast("array<double>")), F.lit(steps)).alias("b")).orderBy("i").collect()
    return np.array([r["b"] for r in rows])


def in_one_place(p, gradients, value, x, y, q, bucket, epochs, steps, rate, decay, clip=None):
    """The same steps by numpy on all rows at once: scores of each epoch, and the parameters of the first best one."""
    p = {k: np.array(v, float) for k, v in p.items()}
    m, v, scores, best, t = dict.fromkeys(p, 0), dict.fromkeys(p, 0), [], None, 0
    for _ in range(epochs):
        for b in range(steps):
            own = bucket == b
            if not own.any():
                continue
            g = {k: a / own.sum() for k, a in gradients(p, x[own], y[own]).items()}
            size = np.sqrt(sum((g[k] ** 2).sum() for k in rate))
            t += 1
            for k in rate:
                h = g[k] * min(1, clip / size) if clip else g[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * h, 0.999 * v[k] + 0.001 * h**2
                p[k] = p[k] * (1 - rate[k] * decay) - rate[k] * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        e = (value(p) - y) ** 2
        scores.append(np.mean([e[q == k].mean() for k in sorted(set(q))]))
        if len(scores) == 1 or scores[-1] < min(scores[:-1]):
            best = {k: a.copy() for k, a in p.items()}
    return scores, best


@pytest.mark.parametrize("kind,epochs,steps", [("mlp", 30, 3), ("compressor", 6, 1), ("affine", 6, 2), ("joint", 8, 2), ("frozen", 4, 1)])
def test_networks_equal_training_in_one_place(spark, kind, epochs, steps):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(90, 5)), rng.integers(0, 2, 90).astype(float)
    q = np.array([str(i % 7) for i in range(90)])
    df = spark.createDataFrame([(i, str(q[i]), x[i].tolist(), float(y[i])) for i in range(90)], "i int, question string, x array<double>, y double").repartition(5).cache()
    bucket, mean = bucket_of(spark, df, steps), x.mean(0)
    scale = np.sqrt(((x - mean) ** 2).mean())
    z, start = (x - mean) / scale, np.random.default_rng(0)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    unit = lambda w: w / np.linalg.norm(w, axis=1, keepdims=True)
    top = lambda p, z: sigmoid(np.maximum(z @ p["w1"].T + p["b1"], 0) @ p["w2"] + p["b2"])
    squeezed = lambda p: np.maximum(z @ unit(p["w"]).T + p["b"], 0)
    clip, decay, data = None, 0.0, z
    if kind == "mlp":
        fit = neural.fit_mlp(df, df, hidden=4, epochs=epochs, steps=steps, patience=None)
        p = {"w1": start.normal(size=(4, 5)) / np.sqrt(5), "b1": np.zeros(4), "w2": start.normal(size=4) / 2, "b2": np.array(0.0)}
        value, gradients, data = lambda p: top(p, x), lambda p, x, y: neural.value_gradients(p, x, y, 1e-4)[1], x
        rate = dict.fromkeys(p, 0.02)
    elif kind in ("compressor", "affine"):
        fit = neural.fit_compressor(df, df, 3, epochs=epochs, steps=steps, affine=kind == "affine")
        p = {"w": start.normal(size=(3, 5)), "b": np.zeros(3), "v": start.normal(size=3) * 0.1, "c": np.array(0.0)}
        if kind == "affine":
            p["w"] = p["w"] / np.sqrt(5)
            value, gradients = lambda p: sigmoid((z @ p["w"].T + p["b"]) @ p["v"] + p["c"]), lambda p, x, y: neural.affine_gradients(p, x, y)[1]
        else:
            value, gradients = lambda p: sigmoid(squeezed(p) @ p["v"] + p["c"]), lambda p, x, y: neural.compressor_gradients(p, x, y, 0.01)[1]
        rate, decay = dict.fromkeys(p, 0.02), 0.01
    else:
        below = {"params": {"w": rng.normal(size=(3, 5)), "b": rng.normal(size=3)}, "mean": mean, "scale": scale}
        slow = 0.005 if kind == "joint" else 0.0
        fit = neural.fit_joint(df, df, below, hidden=4, epochs=epochs, steps=steps, compressor_rate=slow, clip=0.05, patience=None)
        p = {**below["params"], "w1": start.normal(size=(4, 3)) / np.sqrt(3), "b1": np.zeros(4), "w2": start.normal(size=4) / 2, "b2": np.array(0.0)}
        value, gradients = lambda p: top(p, squeezed(p)), lambda p, x, y: neural.joint_gradients(p, x, y, 0.01)[1]
        rate, decay, clip = dict.fromkeys(("w1", "b1", "w2", "b2"), 0.02) | ({"w": slow, "b": slow} if slow else {}), 0.001, 0.05
        assert np.array_equal(fit["params"]["w"], below["params"]["w"]) == (kind == "frozen")
    scores, best = in_one_place(p, gradients, value, data, y, q, bucket, epochs, steps, rate, decay, clip)
    assert np.allclose([h[2] for h in fit["history"]], scores, atol=1e-9) and fit["epoch"] == int(np.argmin(scores)) + 1
    assert all(np.allclose(fit["params"][k], best[k], atol=1e-8) for k in p)
    df.unpersist()


def test_joint_training_from_a_warm_start(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    df = spark.createDataFrame([(str(i % 9), x[i].tolist(), float(x[i, 0] > 0)) for i in range(120)], "question string, x array<double>, y double").cache()
    below = neural.fit_compressor(df, df, 3, epochs=2, steps=1)
    fit = neural.fit_joint(df, df, below, hidden=6, epochs=6, steps=2, head_rate=0.1, compressor_rate=0.05, patience=None)
    assert fit["score"] < 0.2 and fit["history"][-1][1] < fit["history"][0][1]
    again = neural.fit_joint(df, df, below, hidden=6, epochs=1, steps=1, head_rate=9.0, warm=fit["params"])
    assert again["epoch"] == 0 and abs(again["score"] - fit["score"]) < 1e-12
    with pytest.raises(ValueError, match="finite"):
        neural.clipped({"a": np.array([np.nan])}, 1.0)


def test_subjects_shards_and_corpora(spark, tmp_path):
    a = spark.createDataFrame([("p", 1)], "problem string, level int")
    b = spark.createDataFrame([("q",)], "problem string")
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    got = tables.read_subjects(spark, {"algebra": str(tmp_path / "a"), "it's": str(tmp_path / "b")})
    assert sorted((r["problem"], r["level"], r["subject"]) for r in got.collect()) == [("p", 1, "algebra"), ("q", None, "it's")]
    tables.write_corpus(b.select("problem", F.lit("3").alias("answer"), F.lit("\\boxed{3}").alias("solution"), F.lit(1).alias("other")), str(tmp_path / "c"))
    assert [r.asDict() for r in spark.read.json(str(tmp_path / "c")).collect()] == [{"problem": "q", "answer": "3", "solution": "\\boxed{3}"}]
    shard = lambda rows, name: spark.createDataFrame(rows, "x array<double>, y double").write.parquet(str(tmp_path / name))
    shard([([1.0, 2.0], 1.0)], "s0")
    shard([([0.0, 2.0], 0.0)], "s1")
    shard([([0.0], 0.0)], "ragged")
    shard([([0.0, float("inf")], 0.0)], "endless")
    assert tables.read_features(spark, str(tmp_path / "s0"), str(tmp_path / "s1"), width=2).count() == 2
    for bad in (["s0"], ["s0", "ragged"], ["s0", "endless"]):
        with pytest.raises(ValueError):
            tables.read_features(spark, *(str(tmp_path / n) for n in bad))
    with pytest.raises(ValueError):
        tables.read_features(spark, str(tmp_path / "s0"), str(tmp_path / "s1"), width=3)


def test_arms_of_transfer(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(160, 4))
    rows = [(f"q{i % 16}", x[i].tolist(), float(x[i, 0] + 0.3 * rng.normal() > 0)) for i in range(160)]
    df = spark.createDataFrame(rows, "question string, x array<double>, y double")
    half = lambda k: df.where(F.substring("question", 2, 2).cast("int") % 4 == k)
    fit = lambda s, t: neural.transfer_arms({"train": s(0), "val": s(1)}, {"train": t(2), "val": t(3)}, 3, 4, epochs=1, steps=1)
    arms = fit(half, half)
    assert tuple(arms) == neural.ARMS
    assert {k: a["width"] for k, a in arms.items()} == {"full_transfer": 3, "feature_transfer": 3, "target": 3, "pooled": 3, "combined": 3, "wide": 6, "raw": 4}
    direct = heads.ridge_fit(half(2), half(3))
    assert np.allclose(arms["raw"]["head"]["weights"], direct["weights"]) and all(a["head"]["score"] < 0.3 for a in arms.values())
    # what an arm does not train on does not change it
    flipped = lambda k: half(k).withColumn("y", 1 - F.col("y"))
    other_source, other_target = fit(flipped, half), fit(half, flipped)
    same = lambda a, b, k: np.allclose(a[k]["head"]["weights"], b[k]["head"]["weights"])
    assert {k for k in arms if same(arms, other_source, k)} == {"target", "raw"}
    assert {k for k in arms if same(arms, other_target, k)} == {"full_transfer"}
    assert np.allclose(arms["feature_transfer"]["represent"](x), other_target["feature_transfer"]["represent"](x))
    test = {r["arm"]: r for r in neural.evaluate_arms(df, arms).collect()}
    w = direct["weights"]
    assert abs(test["raw"]["brier"] - ((x @ w[:-1] + w[-1] - np.array([r[2] for r in rows])) ** 2).mean()) < 1e-12 and set(test) == set(arms)


def test_gradients():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 2, 9).astype(float)
    for f, p in (
        (lambda p: neural.compressor_gradients(p, x, y, 0.01), {"w": rng.normal(size=(3, 4)), "b": rng.normal(size=3), "v": rng.normal(size=3), "c": np.array(0.1)}),
        (lambda p: neural.affine_gradients(p, x, y), {"w": rng.normal(size=(3, 4)), "b": rng.normal(size=3), "v": rng.normal(size=3), "c": np.array(0.1)}),
        (lambda p: neural.joint_gradients(p, x, y, 0.3),
         {"w": rng.normal(size=(3, 4)), "b": rng.normal(size=3), "w1": rng.normal(size=(5, 3)), "b1": rng.normal(size=5), "w2": rng.normal(size=5), "b2": np.array(0.1)}),
        (lambda p: neural.value_gradients(p, x, y, 0.0), {"w1": rng.normal(size=(3, 4)), "b1": rng.normal(size=3), "w2": rng.normal(size=3), "b2": np.array(0.1)}),
    ):
        g = f(p)[1]
        for k in p:
            d = rng.normal(size=p[k].shape)
            up, down = (f({**p, k: p[k] + s * 1e-6 * d})[0] for s in (1, -1))
            assert abs((up - down) / 2e-6 - (g[k] * d).sum()) < 1e-4
