"""Learning-curve studies against one ridge fit at a time."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuefit.functions import vectors as v
from valuefit.operators import heads, locks, metrics, study
from valuefit.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(600):
        x = rng.normal(size=6) * 3 + 40  # far from 0: sums without a shift would cancel
        d = i % 2
        out.append((f"d{d}", f"q{i // 2 % 20}", x.tolist(), float(x[d] - 40 + rng.normal() > 0), ("train", "val", "test")[i // 40 % 3]))
    return spark.createDataFrame(out, "domain string, question string, x array<double>, y double, split string").repartition(5).cache()


def test_study_equals_single_fits(spark, rows):
    part = lambda s: rows.where(F.col("split") == s).drop("split")
    arms, budgets, seeds = v.representations(4), [3, 7, 50], [1, 2]
    found = study.arm_study(part("train"), part("val"), arms, budgets, seeds, sample=64)
    assert set(found) == {(d, s, a, b) for d in ("d0", "d1") for s in seeds for a in arms for b in budgets}
    tests = {(r["domain"], r["seed"], r["arm"], r["budget"]): r for r in study.evaluate_study(part("test"), found, arms).collect()}
    assert set(tests) == set(found)
    for d, s, a, b in [("d0", 1, "rms_rest", 3), ("d1", 2, "first", 7), ("d0", 2, "first_layernorm", 50), ("d1", 1, "first", 50)]:
        mine = lambda name: v.batch_map(part(name).where(F.col("domain") == d), {"z": arms[a]}).drop("x").withColumnRenamed("z", "x")
        order = sorted((hashlib.sha256(f"{s}:{q}".encode()).hexdigest(), q) for q in {f"q{i}" for i in range(20)})
        single = heads.ridge_fit(mine("train").where(F.col("question").isin([q for _, q in order[:b]])), mine("val"))
        got = found[d, s, a, b]
        assert got["best"] == single["epsilon"] and abs(got["scores"][got["best"]] - single["score"]) < 1e-9
        assert np.allclose(got["weights"][got["best"]], single["weights"], atol=1e-7)
        m = metrics.prediction_metrics(v.predict_many(mine("test"), single["weights"]).withColumn("value", F.get("values", F.lit(0)))).first()
        r = tests[d, s, a, b]
        assert r["epsilon"] == single["epsilon"] and all(abs(r[c] - m[c]) < 1e-8 for c in ("brier", "question_brier", "accuracy", "ece"))


def test_heads_of_many_arms_from_one_pass(spark, rows, monkeypatch):
    part = lambda s: rows.where(F.col("split") == s).drop("domain", "split")
    passes, plain = [], study.arm_partials
    monkeypatch.setattr(study, "arm_partials", lambda df, *a: passes.append(df) or plain(df, *a))
    arms = v.representations(4)
    found = study.whole_study(part("train"), part("val"), arms)
    assert len(passes) == 1 and set(found) == set(arms)
    for a, f in arms.items():
        mine = lambda name: v.batch_map(part(name), {"z": f}).drop("x").withColumnRenamed("z", "x")
        single = heads.ridge_fit(mine("train"), mine("val"))
        assert set(single) == set(found[a]) and found[a]["epsilon"] == single["epsilon"] and abs(found[a]["score"] - single["score"]) < 1e-9
        assert np.allclose(found[a]["weights"], single["weights"], atol=1e-7)


def test_one_scan_of_the_training_rows(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "rows"))
    train = spark.read.parquet(str(tmp_path / "rows")).where("split = 'train'")
    bands = study.memberships(train, [3, 7], [1, 2, 3])
    kept = bands.collect()
    assert all(len(r["bands"]) <= 3 for r in kept) and sum(len(r["bands"]) for r in kept) == 2 * 3 * 7
    plan = study.arm_partials(train.join(F.broadcast(bands), ["domain", "question"]), v.representations(4), {"rms_rest": 0, "first_layernorm": 0, "first": 0})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 2 and text.count("ReadSchema: struct<domain:string,question:string,x:array<double>,y:double") == 1  # vectors are read once
    assert "WindowGroupLimit" in text  # only the first questions of an order are shuffled


def test_selections_are_locked_once_and_checked(spark, tmp_path):
    key = "domain string, seed int, epsilon double"
    chosen = spark.createDataFrame([("a", 1, 0.1), ("a", 2, None), ("b", 1, 10.0)], key)
    path, read = str(tmp_path / "lock"), []
    rows = lambda: read.append(1) or chosen
    with pytest.raises(ValueError, match="not locked"):  # an early look at the test rows
        locks.after_lock(spark, path, rows)
    chosen.write.parquet(f"{path}/selection")  # a try that ended before its commit
    locks.lock(path, selection=chosen, heads=chosen.select("seed"))
    with pytest.raises(ValueError, match="already"):
        locks.lock(path, selection=chosen)
    tables, test = locks.after_lock(spark, path, rows)
    assert sorted(map(str, tables["selection"].collect())) == sorted(map(str, chosen.collect())) and read == [1] and test is chosen
    chosen.withColumn("seed", F.col("seed") + 1).write.mode("overwrite").parquet(f"{path}/selection")
    with pytest.raises(ValueError, match="changed since .*selection"):
        locks.after_lock(spark, path, rows)
    assert read == [1]
    chosen.repartition(3).write.mode("overwrite").parquet(f"{path}/selection")  # the same rows in other files
    assert set(locks.locked(spark, path)) == {"selection", "heads"}
    assert locks.content(chosen) != locks.content(chosen.unionByName(chosen)) and locks.content(chosen) != locks.content(chosen.withColumnRenamed("seed", "s"))


def test_line_numbers_over_files_and_splits(spark, tmp_path):
    want = []
    for name, n in (("b.jsonl", 3000), ("a.jsonl", 700), ("c.jsonl", 1)):
        lines = [f'{{"question": "{name} {i}", "prefix": "{"x" * (i % 50)}"}}' if i % 7 else " " * (i % 3) for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    for name in sorted(p.name for p in tmp_path.iterdir()):
        want += [x for x in (tmp_path / name).read_text().split("\n") if x.strip()]
    known = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            out = tables.numbered_lines(spark, str(tmp_path))
            rows = out.orderBy("ordinal").collect()
            assert [r["ordinal"] for r in rows] == list(range(len(want))) and [r["value"] for r in rows] == want
            plan = tables.read_states(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and "Arrow" not in plan and "ExternalRDD" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", known)
