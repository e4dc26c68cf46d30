"""Models, clusters and samples without SQL, against plain numpy or their definition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.operators import agg, corpus, models, ordered, search, workloads
from rowmill.operators.quantiles import exact_quantiles


def newton(x, y):
    """Logistic coefficients (intercept first) by Newton's steps."""
    a, b = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        b = b + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a, a.T @ (y - p))
    return b


@pytest.fixture(scope="module")
def drawn(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.3 + 1.2 * x[:, 0] - 0.7 * x[:, 1])))).astype(float)
    rows = [(i, float(a), float(b), float(t), f"g{i % 3}") for i, ((a, b), t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, y double, g string").cache()


def test_logistic_odds_against_newton(drawn):
    x, y, df = drawn
    got = {r.variable: r for r in models.proc_logistic(df, F.col("y"), ["a", "b"], []).collect()}
    want = newton(x, y)
    assert [got["a"].odds_ratio, got["b"].odds_ratio] == pytest.approx(np.exp(want[1:]), rel=1e-3)
    score = x @ want[1:]
    pos, neg = score[y == 1], score[y == 0]
    area = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert got["a"].c == pytest.approx(area, abs=0.01)


def test_platt_against_newton(drawn):
    x, y, df = drawn
    want = newton(x[:, :1], y)
    got = {r.id: r.probability for r in models.calibrated(df, "a", F.col("y")).collect()}
    assert [got[i] for i in range(500)] == pytest.approx(1 / (1 + np.exp(-(want[0] + want[1] * x[:, 0]))), abs=1e-4)


def test_entropy_tree_finds_the_rule(drawn):
    _, _, df = drawn
    # two thresholds, one inside the other: an entropy tree of two levels holds them
    rule = (F.col("g") == "g1") & (F.col("a") > 0)
    row = models.proc_tree(df, rule, ["a", "b"], ["g"]).head()
    assert row.accuracy > 0.98 and row.depth <= 6
    none = models.proc_tree(df, F.lit(1) == F.lit(2), ["a", "b"], ["g"]).head()
    assert none.n_nodes == 1 and none.accuracy == 1.0


def test_ancova_against_least_squares(drawn):
    x, y, df = drawn
    value = 2 * x[:, 0] + np.arange(500) % 3 + y
    rows = df.withColumn("v", 2 * F.col("a") + F.col("id") % 3 + F.col("y"))
    got = {r.g: r for r in models.ancova(rows, "v", "g", ["a", "b"]).collect()}
    k = np.arange(500) % 3
    design = np.c_[k == 0, k == 1, k == 2, x].astype(float)
    coef = np.linalg.lstsq(design, value, rcond=None)[0]
    at = x.mean(0) @ coef[3:]
    for i in range(3):
        r = got[f"g{i}"]
        assert r.n == (k == i).sum() and r.mean == pytest.approx(value[k == i].mean()) and r.adjusted == pytest.approx(coef[i] + at)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    at = np.eye(4)[np.arange(120) % 4] * 8
    v = at + rng.normal(size=(120, 4)) * 0.3
    return v, spark.createDataFrame([(i, [float(c) for c in r], i % 4, i % 4 // 2) for i, r in enumerate(v)], "id long, v array<double>, label int, broad int").cache()


def test_lsh_recall_against_all_pairs(blobs):
    v, df = blobs
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in search.lsh_top(df.where("id % 20 = 0"), df, "id", "v", 5).collect():
        got.setdefault(r.query_id, {})[r.id] = r.score
        assert r.score == pytest.approx(u[r.query_id] @ u[r.id])
    hits = 0
    for q in range(0, 120, 20):
        order = sorted((i for i in range(120) if i != q), key=lambda i: (-(u[q] @ u[i]), i))[:5]
        hits += len(set(order) & set(got.get(q, {})))
    assert hits >= 27


def test_contrastive_pairs_keep_their_kinds(blobs):
    _, df = blobs
    rows = search.contrastive_pairs(df, "id", "label", "broad").collect()
    want = {1.0: lambda a, b: a % 4 == b % 4, 0.5: lambda a, b: a % 4 != b % 4 and a % 4 // 2 == b % 4 // 2, 0.0: lambda a, b: a % 4 // 2 != b % 4 // 2}
    per = {}
    for r in rows:
        assert r.a != r.b and want[r.score](r.a, r.b)
        per[r.a, r.score] = per.get((r.a, r.score), 0) + 1
    assert max(per.values()) <= 2 and {s for _, s in per} == set(want)
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, search.contrastive_pairs(df, "id", "label", "broad").collect()))


def test_block_vector_nesting(spark):
    texts = {1: "<div><div>\n</div></div></div>\n<div>", 2: "</div>\n</div><div>\nplain", 3: "", 4: None, 5: "\n".join(["<div>"] * 7)}
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    got = {r.id: r for r in corpus.block_vector(df, "id", "t", F.lit("x"), F.col("t").isNull(), ("<div>", "</div>"), "x", "plain", {"p": "plain"}, {"y": 2.0}).collect()}
    for i, t in texts.items():
        depth = top = 0
        for line in (t or "").split("\n"):
            depth += line.count("<div>")
            top, depth = max(top, depth), max(0, depth - line.count("</div>"))
        assert got[i].nesting_norm == (None if t is None else pytest.approx(top / 5))
    assert got[2].conditional_density == pytest.approx(1 / 3) and got[2].has_p == 1 and got[4].is_ambiguous == 1 and got[4].has_p is None and got[1].type_weight == 1


def test_cluster_summary_with_nulls(spark):
    df = spark.createDataFrame([("a", "x {1}\ny"), ("a", None), ("b", "plain"), ("c", "2024|{")], "k string, t string")
    got = {r.k: tuple(r)[1:] for r in search.cluster_summary(df, ["k"], "t", {"year": "[0-9]{4}", "brace": "[{]"}).collect()}
    assert got == {"a": (2, 2, "brace", "LOW"), "b": (1, 1, "general", "LOW"), "c": (1, 1, "brace, year", "LOW")}


def test_gap_velocity_accumulates(spark):
    stamps = [(1, "2024-01-01 00:10:00", 5.0), (2, "2024-01-01 01:05:00", None), (3, "2024-01-03 00:00:00", 7.0), (4, "2024-01-03 00:00:00", 1.0), (5, None, 2.0)]
    df = spark.createDataFrame([(1, *r) for r in stamps] + [(2, 9, "2024-01-01 00:00:00", 3.0)], "k int, id long, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: (r.n_1h, r.sum_1h, r.max_1h, r.n_72h) for r in ordered.gap_velocity(df, "k", "ts", "v", [1, 72], "id").collect()}
    assert got == {5: (0, 0.0, None, 0), 1: (0, 0.0, None, 0), 2: (1, 0.0, None, 1), 3: (1, 0.0, None, 2), 4: (2, 1.0, 1.0, 3), 9: (0, 0.0, None, 0)}


def test_hazard_and_weights(spark):
    f = spark.createDataFrame([(1, False, 73), (2, True, 400), (3, False, 0), (4, False, 365)], "k long, censored boolean, days int")
    got = {r.k: (r.hazard_rate, r.risk) for r in workloads.hazard(f).collect()}
    assert got[1] == (pytest.approx(365.25 / 73), "HIGH") and got[2] == (0.0, "CENSORED") and got[3] == (None, "HIGH") and got[4] == (pytest.approx(365.25 / 365), "MODERATE")
    w = spark.createDataFrame([(1, 96.0), (2, 3.0), (3, 1.0), (4, None)], "k long, v double")
    got = {r.k: (r.weight, r.position) for r in workloads.weights(w, "v").collect()}
    assert got == {1: (pytest.approx(0.96), "LARGE"), 2: (pytest.approx(0.03), "MEDIUM"), 3: (pytest.approx(0.01), "SMALL"), 4: (None, "SMALL")}
    assert math.isclose(sum(x[0] or 0 for x in got.values()), 1)
    assert workloads.weights(w.limit(0), "v").count() == 0


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(9)
    groups = [None, "a", "b", "hot"]
    rows = [(groups[3 if i % 2 else i // 2 % 4], None if i % 17 == 0 else float(rng.integers(0, 40)) if i % 3 else float(rng.normal())) for i in range(3000)]
    rows += [("none", None), ("one", 4.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"q0": 0.0, "q1": 0.01, "q2": 0.37, "q3": 0.5, "q4": 0.95, "q5": 1.0}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.g: tuple(r)[1:] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {g: tuple(np.quantile([v for h, v in rows if h == g and v is not None], list(probs.values()))) for g in [*groups, "one"]}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g])
    every = exact_quantiles(df, [], "v", {"m": 0.5}).collect()
    assert [tuple(r) for r in every] == [(pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.5)),)]
    assert [tuple(r) for r in exact_quantiles(df.limit(0), [], "v", {"m": 0.5}).collect()] == [(None,)]
    assert exact_quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def test_means_quantiles_of_every_class_level(spark):
    rows = [(a, b, None if i % 5 == 0 else float(i * 7 % 23)) for i, (a, b) in enumerate([("x", 1), ("x", 2), ("y", None), ("y", 2), (None, 1)] * 8)]
    df = spark.createDataFrame(rows, "a string, b int, v double")
    got = {(r._type_, r.a, r.b): (r._freq_, r.v_median, r.v_n, r.v_p90) for r in agg.proc_means(df, ["a", "b"], ["v"], ("median", "n", "p90"), nway=False).collect()}
    want = {}
    for t, key in ((0, lambda r: (None, None)), (1, lambda r: (None, r[1])), (2, lambda r: (r[0], None)), (3, lambda r: r[:2])):
        for k in {key(r) for r in rows}:
            vs = [r[2] for r in rows if key(r) == k]
            some = [v for v in vs if v is not None]
            want[t, *k] = (len(vs), pytest.approx(np.quantile(some, 0.5)) if some else None, len(some), pytest.approx(np.quantile(some, 0.9)) if some else None)
    assert got == want


def test_mixture_fit_prefers_the_true_number(blobs):
    v, df = blobs
    rows = {r.k: r for r in models.mixture_fit(df, "v", [2, 4], seed=3).collect()}
    for k, r in rows.items():
        assert r.bic == pytest.approx((k - 1 + 4 * k + 10 * k) * math.log(120) - 2 * r.log_likelihood)
    # four equal parts, each a normal law at its own moments
    part = lambda x: -0.5 * len(x) * (4 * math.log(2 * math.pi) + math.log(np.linalg.det(np.cov(x.T, bias=True))) + 4)
    assert rows[4].log_likelihood == pytest.approx(sum(part(v[b::4]) for b in range(4)) + 120 * math.log(0.25), rel=0.02)
    assert rows[4].bic < rows[2].bic


def test_risk_model_holds_out_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    kind = np.where(x[:, 0] > 0.8, "HIGH", np.where(x[:, 1] > 0, "LOW", "MODERATE"))
    df = spark.createDataFrame([(i, str(k), float(a), float(b)) for i, (k, (a, b)) in enumerate(zip(kind, x))] + [(900, None, 1.0, 1.0), (901, "LOW", None, 0.0)], "id long, risk string, a double, b double")
    got = {r.part: r for r in models.risk_model(df, "id", "risk", ["a", "b"]).collect()}
    assert got["TRAIN"].n + got["VALID"].n == 600 and 80 < got["VALID"].n < 160
    assert got["VALID"].accuracy > 0.85 and got["VALID"].ece < 0.2 and 0 <= got["TRAIN"].ece <= got["TRAIN"].n
