"""Golden values and independent recomputations."""

import hashlib
import json
import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuefit.functions import text as t
from valuefit.functions import vectors as v
from valuefit.operators import advantages, calibrate, curate, grading, heads, ledger, metrics, paired, prefixes, runs, stats


def one(df):
    return df.first()[0]


def test_gae(spark):
    rows = [("a", i, r, x) for i, (r, x) in enumerate(zip([0.0, 0.0, 1.0], [0.2, 0.3, 0.1]))] + [("b", i, r, x) for i, (r, x) in enumerate(zip([0.0, 1.0], [0.4, 0.2]))]
    df = spark.createDataFrame(rows, "answer string, position int, reward double, value double")
    got = {(r["answer"], r["position"]): r["returns"] for r in advantages.gae(df, 0.9, 0.8, ["answer"]).collect()}
    assert np.allclose([got["a", i] for i in range(3)], [0.58536, 0.738, 1]) and np.allclose([got["b", i] for i in range(2)], [0.756, 1])
    assert all(abs(r["returns"] - 1) < 1e-12 for r in advantages.gae(df, 1.0, 1.0, ["answer"]).collect())


def test_group_advantage(spark):
    rows = [("a", float(i % 2)) for i in range(4)] + [("b", 1.0)] * 3 + [("c", 0.0)] * 2 + [("d", 1.0)]
    got = advantages.group_advantage(spark.createDataFrame(rows, "q string, reward double"), ["q"]).collect()
    for r in got:
        want = (0.8660239 if r["reward"] else -0.8660239) if r["q"] == "a" else 0
        assert abs(r["advantage"] - want) < 1e-6


def test_policy_objective_and_value_loss(spark):
    df = spark.createDataFrame([(0.0, math.log(1.5), 1.0), (0.0, math.log(0.5), -1.0)], "old_logp double, new_logp double, advantage double")
    assert abs(advantages.policy_objective(df, 0.2).first()["objective"] + 0.2) < 1e-12
    df = spark.createDataFrame([("a", 1.0, 0.0, 1.0), ("b", 0.1, 0.0, 1.0), ("b", 0.1, 0.0, 1.0)], "answer string, value double, old_value double, returns double")
    assert abs(one(advantages.value_loss(df, 0.2, ["answer"])) - 0.5 * (0.64 + 0.81) / 2) < 1e-12


def test_critic_diagnostics(spark):
    rows = [("a", 0.0, 0.8), ("b", 0.0, 0.8), ("b", 0.0, 0.8)]
    r = advantages.critic_diagnostics(spark.createDataFrame(rows, "answer string, before double, after double").withColumn("returns", F.lit(1.0)), ["answer"]).first()
    assert r["mse_before"] == 1 and abs(r["mse_after"] - 0.04) < 1e-12


STATES = np.array([[1.0, 2], [3, -1], [2, 0.5]])
SYSTEMS = {
    0.0: ([[5, -0.5, 2], [-4, 7.75, 0.5], [1, 2, 1]], [2, 0.5, 1]),
    0.99: ([[13.8902, -0.00995, 5.9501], [-0.0796, 5.2651, 1.4702], [5.9302, 1.50005, 2.9701]], [5.9501, 1.4702, 2.9701]),
    1.0: ([[14, 0, 6], [0, 5.25, 1.5], [6, 1.5, 3]], [6, 1.5, 3]),
}


@pytest.mark.parametrize("decay", SYSTEMS)
@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_lstd_statistics(spark, decay, partitions):
    a, b = stats.trajectory_statistics(STATES, 1.0, decay)
    assert np.allclose(a, SYSTEMS[decay][0]) and np.allclose(b, SYSTEMS[decay][1])
    rows = [(str(q), q % 2, p, x.tolist(), 1.0) for q in range(5) for p, x in enumerate(STATES)]
    df = spark.createDataFrame(rows, "question string, response int, position int, x array<double>, y double").repartition(partitions)
    s = stats.collect_statistics(stats.lstd_partials(df, decay, partitions=partitions))[""]
    assert np.allclose(s["a"], 5 * a) and np.allclose(s["b"], 5 * b) and s["n"] == 15 and s["answers"] == 5
    if decay == 1:
        r = stats.collect_statistics(stats.ridge_partials(df))[""]
        assert np.allclose(r["a"], s["a"]) and np.allclose(r["b"], s["b"])


def test_lstd_statistics_of_answers_in_many_batches(spark):
    """Answers of 1 to 9 rows and two keys, cut by Arrow batches of 4 rows."""
    rng, rows, want = np.random.default_rng(3), [], {}
    for i in range(12):
        x, y, k = rng.normal(size=(i % 9 + 1, 2)), float(i % 3), "ab"[i // 6]
        rows += [(k, f"{i:02d}", p, v.tolist(), y) for p, v in enumerate(x)]
        a, b = stats.trajectory_statistics(x, y, 0.9)
        now = want.setdefault(k, [0, 0, 0, 0])
        want[k] = [now[0] + a, now[1] + b, now[2] + len(x), now[3] + 1]
    df = spark.createDataFrame(rows, "k string, answer string, position int, x array<double>, y double").repartition(1, "answer")
    known = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = stats.collect_statistics(stats.lstd_partials(df, 0.9, "k", ["answer"], dealt=True))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", known)
    assert set(found) == {"a", "b"}
    for k, s in found.items():
        assert np.allclose(s["a"], want[k][0]) and np.allclose(s["b"], want[k][1]) and [s["n"], s["answers"]] == want[k][2:]


def test_solve():
    w = heads.fit_system(np.array(SYSTEMS[1.0][0], float), np.array(SYSTEMS[1.0][1], float), 0.01)
    assert np.allclose(w, [0.3385445160, 0.2254281687, 0.2094985551])
    with pytest.raises(ValueError):
        heads.fit_system(np.eye(2), np.ones(2), -1)


def test_question_brier_and_ece(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 1.0), ("b", 1.0, 1.0)], "question string, value double, y double")
    m = metrics.prediction_metrics(df).first()
    assert m["question_brier"] == 0.5 and abs(m["brier"] - 2 / 3) < 1e-12
    df = spark.createDataFrame([("a", -1.0, 0.0), ("a", 0.2, 0.0), ("b", 2.0, 1.0)], "question string, value double, y double")
    m = metrics.prediction_metrics(df).first()
    assert abs(m["question_brier"] - 0.76) < 1e-12 and abs(m["question_clipped_brier"] - 0.01) < 1e-12 and abs(m["ece"] - 0.2 / 3) < 1e-12
    assert abs(one(metrics.calibration_error(df)) - m["ece"]) < 1e-12
    edge = np.nextafter(0.9, 0)
    assert one(spark.createDataFrame([(float(edge),)], "p double").select(metrics.ece_bin(F.col("p")))) == 8


def test_numbers(spark):
    cases = {"+5": "5", "007": "7", "1,234.50": "1234.5", "-0": "0", "-0.00": "0", " 12 ": "12", "1,23": None, "1e5": None, "": None, ".5": None, "5.": None, "-00.10": "-0.1", "12,345,678": "12345678", "0": "0", "1" * 60: "1" * 60}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "x string")
    got = {r[0]: (r[1], r[2]) for r in df.select("x", t.parse_number(F.col("x")), t.decimal_str("x")).collect()}
    assert {k: got[k][0] for k in cases} == cases and got[None] == (None, None)
    want = {"+5": "5", "007": "7", "1,234.50": "1234.50", "-0": "-0", "1,23": None}
    assert {k: got[k][1] for k in want} == want


def test_families_and_digests(spark):
    cases = {"What is 2+3?": "what is NUMBER NUMBER", "Is 1,234.5 > ½ of x²?": "is NUMBER NUMBER NUMBER of x NUMBER", "ﬁnd Ⅷ étés": "find viii étés"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r[0]: r[1] for r in df.select("x", t.family_key("x")).collect()} == cases
    r = spark.createDataFrame([("buy NUMBER pears",)], "f string").select(F.sha2("f", 256).alias("id"), t.salted_key("numina-online-v1", F.col("f")).alias("s")).withColumn("o", t.order_key(42, F.col("id"))).first()
    assert r["id"].startswith("c0668b5fbdfc1a1c") and r["o"].startswith("e946d2299628fcb6") and r["s"].startswith("441e2b21f98400eb")


def test_references(spark):
    df = spark.createDataFrame([("p", r"\boxed{7}", "7"), ("p", r"\boxed{(2,3)}", "7"), ("p", r"\boxed{7", "7"), ("find all values", r"\fbox {7}", "8"), ("p", r"\boxed{\boxed{1}}", "1"), ("p", None, None)], "p string, s string, a string")
    got = [r[0] for r in df.select(t.reference_decision(F.col("p"), F.col("s"), F.col("a"))).collect()]
    assert got[0]["eligible"] and got[0]["number"] == "7"
    assert got[1]["reasons"] == ["reference_not_single_decimal"]
    assert got[2]["reasons"] == ["malformed_reference_box", "reference_must_have_exactly_one_box", "reference_not_single_decimal"]
    assert got[3]["reasons"] == ["question_requests_multiple_answers", "saved_reference_mismatch"]
    assert got[4]["reference_boxes"] == [r"\boxed{1}", "1"] and not got[5]["eligible"]


def test_template_dedup(spark):
    rows = [(0, "f", 900), (1, "f", 10), (2, "f", 900), (3, "g", 10), (4, "f", 5), (5, None, 5)]
    df = spark.createDataFrame(rows, "source_index long, family string, n_tokens int")
    out = curate.select_eligible(df, {"none": F.col("family").isNull()}, {"prompt_length": F.col("n_tokens") > 100})
    assert {r["source_index"]: r["reason"] for r in out.collect()} == {0: "prompt_length", 1: None, 2: "duplicate_family", 3: None, 4: "duplicate_family", 5: "none"}


@pytest.mark.parametrize("n, train, val", [(20, 12, 4), (35, 21, 7), (41, 24, 8), (50, 30, 10)])
def test_split_cut_points(spark, n, train, val):
    got = curate.split_share(spark.range(n).selectExpr("cast(id as string) id").repartition(3), 42).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": train, "val": val, "test": n - train - val}


def test_counts_that_cannot_be_met(spark):
    df = spark.range(5).selectExpr("cast(id as string) id")
    with pytest.raises(ValueError):
        curate.split_counts(df, {"train": 10}, F.col("id"))
    with pytest.raises(ValueError):
        curate.two_folds(df.limit(3), 1)
    with pytest.raises(ValueError):
        curate.top_by_hash(df, 6, 1)


def test_nested_budgets_and_pool(spark):
    df = spark.createDataFrame([(q,) for q in "bbaaddcc"], "question string")
    got = {r["budget"]: r["count"] for r in curate.nested_budgets(df, [1, 2]).groupBy("budget").count().collect()}
    assert got == {1: 2, 2: 4}
    a, b = (spark.createDataFrame([(f"{s}{i // 2}",) for i in range(12)], "question string") for s in "ab")
    pool = {r[0] for r in curate.pool_two(a, b, 6, 1).distinct().collect()}
    assert len(pool) == 6 and sum(q[0] == "a" for q in pool) == 3


def test_ledger(spark):
    rows = [("200", "200_1", "COMPLETED", "1800", "8", "cpu=8,gres/gpu=1,gres/gpu:a=1"), ("201", "100_2", "COMPLETED", "1800", "", "gres/gpu:a=1,gres/gpu:b=1"), ("200.b", "200.batch", "COMPLETED", "9", "1", "gres/gpu=1"), ("202", "200_[0-4]", "CANCELLED by 1", "0", "0", "")]
    raw = spark.createDataFrame(rows, "job_id_raw string, job_id string, state string, elapsed string, cpus string, tres string").withColumns({"start": F.lit("x"), "end": F.lit(None).cast("string")})
    got = {r["job_id_raw"]: r for r in ledger.allocations(raw).collect()}
    assert set(got) == {"200", "201", "202"} and got["200"]["gpu_hours"] == 0.5 and got["200"]["cpu_hours"] == 4 and got["201"]["gpus"] == 2 and got["202"]["gpu_hours"] == 0
    with pytest.raises(ValueError):
        ledger.allocations(raw.unionByName(raw))
    led = spark.createDataFrame([("s", "fit", "100"), ("s", "fit", "300")], "study string, stage string, job string")
    assert [r["job"] for r in ledger.missing_jobs(led, ledger.allocations(raw)).collect()] == ["300"]
    with pytest.raises(ValueError):
        ledger.check_ledger(led.unionByName(led.withColumn("study", F.lit("t"))))


def test_token_usage(spark):
    rows = [("d", "train", "q", 3, 2, False, "correct"), ("d", "train", "q", 2, 2, True, "parse_failure")]
    a = spark.createDataFrame(rows, "domain string, split string, question_id string, n_tokens int, n_prompt int, capped boolean, verifier_status string")
    r = prefixes.group_usage(prefixes.question_usage(a)).first()
    assert (r["response_tokens"], r["prompt_tokens"], r["answers"], r["retained_answers"], r["sampled_prefixes"], r["capped_answers"]) == (5, 4, 2, 1, 3, 1)


def test_subset_usage(spark):
    rows = [("d", "train", q, *[n] * len(prefixes.USAGE), k) for q, n, k in (("a", 100, 0), ("b", 200, 1), ("c", 300, 1))]
    u = spark.createDataFrame(rows, "domain string, split string, question_id string, " + ", ".join(f"{c} long" for c in prefixes.USAGE) + ", retained_question long")
    assert {r["budget"]: r["response_tokens"] for r in prefixes.subset_usage(u, [1, 2]).collect()} == {1: 200, 2: 500}
    with pytest.raises(ValueError):
        prefixes.subset_usage(u, [3])


def test_sampled_positions(spark):
    df = spark.createDataFrame([(n, str(n)) for n in (0, 1, 5, 8, 9, 200)], "n int, k string")
    for parts in (1, 3):
        for r in df.repartition(parts).select("n", prefixes.sample_positions(F.col("n"), F.col("k"), 8, 3).alias("p")).collect():
            assert len(r["p"]) == min(8, r["n"]) == len(set(r["p"])) and list(r["p"]) == sorted(r["p"]) and all(0 <= p < r["n"] for p in r["p"])


def test_policies(spark):
    df = spark.createDataFrame([("correct", "1"), ("grader_error", "1"), ("incorrect", "1")], "verifier_status string, reference string")
    assert [r["score"] for r in grading.apply_policy(df, exclude=True).collect()] == [1, None, 0]
    with pytest.raises(ValueError):
        grading.apply_policy(df).collect()
    with pytest.raises(ValueError):
        grading.apply_policy(df.withColumn("reference", F.lit("x")), exclude=True)


def test_health_and_profiles(spark):
    rows = [(r, u, 1.0, 0.5, 0.1, 1.0, 0.1, 0.0, 2.0) for r in (0, 1) for u in (1, 2)]
    df = spark.createDataFrame(rows, "rank int, update int, mse_before double, mse_after double, prediction_change double, grad_norm_max double, lr double, initial_value_abs_max double, audit_seconds double")
    r = runs.audit_health(df, 2, 2).first()
    assert r["passed"] and r["extra_seconds"] == 4
    assert not runs.audit_health(df, 3, 2).first()["passed"] and not runs.audit_health(df.withColumn("mse_after", F.lit(3.0)), 2, 2).first()["passed"]
    p = lambda *rows: spark.createDataFrame(rows, "profile string, place int, passed boolean, initial double, final double")
    assert runs.select_profile(p(("b", 2, True, 0.1, 0.5), ("a", 1, True, 0.1, 0.5))).first()["profile"] == "a"
    assert runs.select_profile(p(("a", 1, False, 0.1, 0.5), ("b", 2, True, 0.1, 0.5))).first()["profile"] == "b"
    with pytest.raises(ValueError):
        runs.select_profile(p(("a", 1, True, 0.6, 0.5)))


def test_selection_ties(spark):
    df = spark.createDataFrame([("m", 0.01, 0, 0.5), ("m", 0.1, 1, 0.5), ("m", 1.0, 2, 0.5)], "m string, epsilon double, place int, score double")
    assert metrics.pick_min(df, ["m"], "score", "place", "epsilon").first()["epsilon"] == 0.01
    r = metrics.pick_max(df, ["m"], "score", "epsilon").first()
    assert r["epsilon"] == 0.01 and not r["at_ceiling"]


def test_best_epoch_with_patience(spark):
    df = spark.createDataFrame([("m", e, b) for e, b in enumerate([0.5, 0.4, 0.4, 0.45, 0.1])], "m string, epoch int, brier double")
    assert runs.best_epoch(df, ["m"]).first()["epoch"] == 4 and runs.best_epoch(df, ["m"], 2).first()["epoch"] == 1


def test_layers():
    assert v.select_layers(28, 1, 5) == [27, 26, 25, 24, 23] and v.select_layers(28, 2, 5) == [27, 26, 24, 20, 12] and v.select_layers(28, 3, 3) == [27, 25, 19]


def test_transforms_agree_with_numpy(spark):
    x = np.random.default_rng(0).normal(size=(7, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(7, [0.0] * 6)], "i int, x array<double>")
    x = np.vstack([x, np.zeros(6)])
    made = v.batch_map(df, {"r": v.np_rms, "l": v.np_layer_norm})
    for r in made.select("i", "r", "l", v.rms_coordinates(F.col("x")).alias("r2"), v.layer_norm(F.col("x")).alias("l2")).collect():
        assert np.allclose(r["r"], r["r2"]) and np.allclose(r["l"], r["l2"]) and np.isfinite(r["r"]).all() and abs(np.mean(r["l"])) < 1e-9
    mean, scale = stats.isotropic_normalization(df.repartition(5))
    assert np.allclose(mean, x.mean(0)) and abs(scale - np.sqrt(((x - x.mean(0)) ** 2).mean())) < 1e-12


def test_grid_equals_direct_solves_and_ceiling_blocks(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 4)), rng.integers(0, 2, 60).astype(float)
    df = spark.createDataFrame([(str(i % 9), r.tolist(), float(t_)) for i, (r, t_) in enumerate(zip(x, y))], "question string, x array<double>, y double")
    g = heads.ridge_grid(df, df)
    z = np.hstack([(x - x.mean(0)) / np.sqrt(((x - x.mean(0)) ** 2).mean()), np.ones((60, 1))])
    for e, h in g["heads"].items():
        assert np.allclose(h["w"], np.linalg.solve(z.T @ z + e * np.eye(5), z.T @ y))
    b = heads.budget_study(df, df, [3, 9])
    assert np.allclose(b[9]["heads"][1.0]["w"], g["heads"][1.0]["w"], atol=1e-8)
    flat = spark.createDataFrame([("a", [0.0], 1.0), ("b", [0.0], 1.0)], "question string, x array<double>, y double")
    with pytest.raises(ValueError, match="1e10"):
        heads.ridge_grid(flat, flat.withColumn("y", F.lit(0.0)))


def test_out_of_fold_values_do_not_see_their_outcomes(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i), rng.normal(size=3).tolist(), float(i % 3 == 0), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "question string, x array<double>, y double, fold int")
    flipped = df.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    value = lambda d: {r["question"]: r["value"] for r in heads.out_of_fold(d, heads.fit_ridge(d, 0.01, "fold")).where("fold = 0").collect()}
    a, b = value(df), value(flipped)
    assert all(abs(a[q] - b[q]) < 1e-12 for q in a)


def test_calibration(spark):
    rng = np.random.default_rng(3)
    raw = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * raw - 0.5)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(raw, y)], "value double, y double")
    s, c = calibrate.calibrate(df)
    p = 1 / (1 + np.exp(-(s * raw + c)))
    assert abs(((p - y) * raw).mean() + 2e-5 * s) < 1e-8 and abs((p - y).mean() + 2e-5 * c) < 1e-8
    with pytest.raises(ValueError):
        calibrate.calibrate(df.where("y = 1"))


def drawn(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def test_bootstrap_by_brute_force(spark):
    d = np.random.default_rng(4).normal(size=(3, 20))
    rows = [(s, i, float(d[s, i])) for s in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "seed int, id long, delta double")
    a, b = ({r["draw"]: r["value"] for r in paired.bootstrap_draws(x, 50, 1, p).collect()} for x, p in ((df, 1), (df.repartition(5), 7)))
    for k in range(50):
        seeds, places = [drawn(1, "s", k, j) % 3 for j in range(3)], [drawn(1, "q", k, j) % 20 for j in range(20)]
        assert abs(a[k] - d[seeds][:, places].mean()) < 1e-12 and abs(a[k] - b[k]) < 1e-12
    with pytest.raises(ValueError, match="not paired"):
        paired.bootstrap_draws(df.where("seed > 0 or id > 3"), 5, 1)
    with pytest.raises(ValueError, match="not paired"):
        paired.bootstrap_draws(df.limit(0), 5, 1)
    draws = {r["draw"]: r["value"] for r in paired.poisson_draws(df.where("seed = 0").unionByName(spark.createDataFrame([(0, 99, None)], df.schema)), 40, 3).collect()}
    levels = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(25)])
    for k in range(40):
        w = np.array([(drawn(3, i, k) / 2**52 >= levels[:18]).sum() for i in range(20)])
        assert abs(draws[k] - w @ d[0] / w.sum()) < 1e-12
    r = paired.interval(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "value double")).first()
    assert np.allclose([r["low"], r["high"]], [1.075, 9.475])


@pytest.mark.parametrize("per_range", [10**6, 7])
def test_ranks_are_those_of_a_sort(spark, per_range):
    rows = [(i * 37 % 101, f"k{i * 53 % 101:03d}", i) for i in range(101)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(5)
    got = {(r["a"], r["b"]): r["rank"] for r in curate.ranked(df, F.col("a") % 3, "b", per_range=per_range).collect()}
    assert got == {(a, b): i for i, (a, b, _) in enumerate(sorted(rows, key=lambda r: (r[0] % 3, r[1])))}
    assert curate.ranked(df.limit(0), "b").count() == 0


def test_boxes_in_any_nesting(spark):
    def boxes(text):
        """By depth, from each opening to its end."""
        out, bad = [], False
        for at in [i for i in range(len(text)) if text.startswith("\\boxed{", i)]:
            inner = text[at + 7 :]
            depth = [1 + inner[: k + 1].count("{") - inner[: k + 1].count("}") for k in range(len(inner))]
            if 0 in depth:
                out.append(inner[: depth.index(0)])
            else:
                bad = True
        return out, bad

    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(["\\boxed{", "{", "}", "x", "1"], size=12)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", t.boxed_parts("t").alias("p")).collect():
        assert (r["p"]["boxes"], r["p"]["malformed"]) == boxes(r["t"])
    many = spark.createDataFrame([("\\boxed{" * 100_000,)], "t string").select(t.boxed_parts("t").alias("p")).first()["p"]
    assert many["malformed"] and many["boxes"] == []


def test_keys_of_any_text(spark):
    texts = ["Été 1,234.5 ÇA_va?", "ﬁ x² Ⅷ", "日本 12", "áb", "ĳŉ", "  ", "", None, "Ünïcödé—dash", 'a "quoted" \\ text', "tab\tand\nline", "\x01", "é"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for r in df.select("x", t.family_key("x").alias("k"), t.salted_key("s", F.col("x")).alias("d")).collect():
        if r["x"] is None:
            assert r["k"] is None and r["d"] is None
            continue
        y = unicodedata.normalize("NFKC", r["x"]).lower()
        assert r["k"] == re.sub(r"\W+", " ", re.sub(r"\d+(?:[.,]\d+)*", " NUMBER ", y)).strip()
        assert r["d"] == hashlib.sha256(json.dumps(["s", r["x"]], separators=(",", ":")).encode()).hexdigest()


def test_ill_conditioned_systems(spark):
    """The residual is measured by the size of the system and its weights, not of b alone."""
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    a, b = q @ np.diag(np.logspace(0, 13, 12)) @ q.T, rng.normal(size=12)
    w = heads.fit_system(a, b, 0.01)
    assert heads.relative_residual(a + 0.01 * np.eye(12), w, b) < 1e-8
    systems = spark.createDataFrame([("r", 0, a.ravel().tolist(), b.tolist()), ("z", 0, [0.0] * 4, [1.0, 1.0])], "run string, fold int, a array<double>, b array<double>")
    got = {(r["run"], r["epsilon"]): r for r in heads.conditioning(systems).collect()}
    assert got["z", 0.0]["error"] and got["z", 0.0]["condition"] is None and got["z", 1.0]["condition"] == 1
    assert got["r", 1.0]["norm"] == pytest.approx(np.linalg.norm(np.linalg.solve(a + np.eye(12), b)), rel=1e-4) and len(got["r", 1.0]["sensitivity"]) == 3
    assert all(x == pytest.approx(1) for x in got["z", 1.0]["sensitivity"])
    good = lambda run, fold, fitting, n=5, w=w: (run, fold, a.ravel().tolist(), b.tolist(), w.tolist(), 0.01, fitting, n)
    stored = [good("two", 0, 1), good("two", 1, 0), good("one", 0, 0), good("same", 0, 0), good("same", 1, 1), good("none", 0, 0, 0), good("off", 0, 0, 5, w + 1), good("short", 0, 0, 5, w[:5])]
    frame = spark.createDataFrame(stored, "run string, fold int, a array<double>, b array<double>, w array<double>, epsilon double, fitting_fold int, answers long")
    assert {(r["run"], r["fold"]): r["ok"] for r in heads.audit_heads(frame).collect()} == {
        ("two", 0): True, ("two", 1): True, ("one", 0): True, ("same", 0): False, ("same", 1): False, ("none", 0): False, ("off", 0): False, ("short", 0): False,
    }


def test_reasons_alone_equal_reasons_in_rows(spark):
    rows = [(i, f"f{i % 7}" if i % 11 else None, i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "source_index long, family string, n int")
    early, late = {"zero": F.col("n") == 0, "null": F.when(F.col("n") == 9, F.lit(True))}, {"four": F.col("n") == 4}
    whole = {r["source_index"]: r["reason"] for r in curate.select_eligible(df, early, late).collect()}
    assert {r["source_index"]: r["reason"] for r in curate.eligible_reasons(df, early, late).collect()} == whole
    assert {"zero", "duplicate_family", None} <= set(whole.values())


def test_row_norms_take_each_coordinate_a_few_times(spark):
    """Mean and variance are computed once a row, not once a coordinate of a coordinate: 2,000^3 steps take minutes."""
    import time

    x = np.random.default_rng(3).normal(size=2000)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    began = time.monotonic()
    r = df.select(v.layer_norm(F.col("x")).alias("l"), v.rms_coordinates(F.col("x")).alias("r")).first()
    assert time.monotonic() - began < 60
    assert np.allclose(r["l"], v.np_layer_norm(x[None])[0]) and np.allclose(r["r"], v.np_rms(x[None])[0])
    assert df.select(v.layer_norm(F.lit(None).cast("array<double>")).alias("l")).first()["l"] is None


def test_draws_count_places_and_deal_questions(spark):
    """Slots do not move, their counts by block do; a place may be taken more than 255 times; few rows still meet many tasks."""
    slots = spark.createDataFrame([(0, 3)] * 300 + [(0, paired.BLOCK + 1)] * 2 + [(1, 3)], "draw long, place long").coalesce(1)
    got = [(r["draw"], r["block"], np.frombuffer(zlib.decompress(r["counts"]), np.uint8)) for r in paired._counted(slots).collect()]
    assert sorted((d, b, int(c.sum())) for d, b, c in got) == [(0, 0, 45), (0, 0, 255), (0, 1, 2), (1, 0, 1)] and all(len(c) == paired.BLOCK for *_, c in got)
    df = spark.createDataFrame([(s, i, float(i % 7 - s)) for s in range(2) for i in range(40)], "seed int, id int, delta double")
    plan = paired.bootstrap_draws(df, 500, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "counts" in plan and "Join" not in plan.split("MapInArrow")[0]
    draws = paired.poisson_draws(df.where("seed = 0").coalesce(1), 5, 3)
    assert "RepartitionByExpression" in draws._jdf.queryExecution().optimizedPlan().toString()


def test_questions_are_judged_once(spark):
    """With ``keep`` reasons are those of the wide path, and no text is in the plan that compares families."""
    texts = ["What is 1 + 1?", "what is 2 + 2", "", "See the diagram", "Find all values", "One more"]
    df = spark.createDataFrame([(i, x, "\\boxed{5}", "5", 3) for i, x in enumerate(texts)], "source_index long, question string, solution string, answer string, n_tokens int")
    wide = curate.prepare_questions(df, 10, 10, 20, "solution").select("source_index", "number", "reason")
    narrow = curate.prepare_questions(df, 10, 10, 20, "solution", keep=("number",))
    assert sorted(map(tuple, narrow.collect()), key=str) == sorted(map(tuple, wide.collect()), key=str) and narrow.columns == wide.columns
    assert "question" not in narrow._jdf.queryExecution().optimizedPlan().toString()
