"""Core operators against brute force: nulls, ties, hot keys and loops that SQL does not show."""

import itertools
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from rowmill.functions import numbers as num
from rowmill.operators import analytics, corpus, domain, etl, joins, matching, minhash, models, ordered, recon, search


def test_row_hash_tells_fields_apart(spark):
    rows = [("a|vb", "c"), ("a", "b|vc"), (None, "n"), ("n", None), ("", None), (None, ""), ("1:a", "b"), ("1", ":ab")]
    df = spark.createDataFrame(rows, "a string, b string").select(etl.row_hash(["a", "b"]).alias("h"))
    assert df.distinct().count() == len(rows)


def test_global_order_splits_ties(spark):
    rows = [(i, i % 3, None if i % 7 == 0 else float(i % 11)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k int, v double")
    want, run, last = {}, 0.0, None
    for n, (i, k, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        run += v or 0
        want[i] = (run, n, last)
        last = v
    order = [F.desc("k"), "id"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = ordered.global_running_sum(df, F.col("v"), order, "s")
    out = ordered.global_lag(ordered.add_sequence(out, order, "n"), "v", order, "l")
    assert {r.id: (pytest.approx(r.s), r.n, r.l) for r in out.collect()} == want
    b = ordered.bucketed(df, order).select("_b").distinct().count()
    assert b > 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    none = df.limit(0)
    assert ordered.add_sequence(none, order, "n").count() == 0 and ordered.global_lag(none, "v", order, "l").count() == 0


def test_rank_groups_with_ties_and_nulls(spark):
    vals = [None, 5.0, 5.0, 1.0, 9.0, 9.0, 9.0, 2.0, None, 7.0]
    df = spark.createDataFrame(list(enumerate(vals)), "id long, v double")
    have = sorted(v for v in vals if v is not None)
    rank = {v: sum(1 for x in have if x < v) + (have.count(v) + 1) / 2 for v in have}
    want = {i: None if v is None else math.floor(rank[v] * 4 / (len(have) + 1)) for i, v in enumerate(vals)}
    assert {r.id: r.q for r in ordered.proc_rank(df, "v", 4, "q").collect()} == want


def test_nearest_match_against_all_pairs(spark):
    t = [(i, i % 4, None if i == 5 else float(i * 37 % 50)) for i in range(40)]
    c = [(100 + i, i % 3, None if i == 7 else float(i * 23 % 50)) for i in range(60)]
    df = lambda rows, k: spark.createDataFrame(rows, f"{k} long, g int, v double")
    got = {r.t: (r.match_id, r.gap) for r in matching.nearest_match(df(t, "t"), df(c, "c"), ["g"], "v", "t", "c").collect()}
    want = {}
    for i, g, v in t:
        near = [(abs(v - x), j) for j, h, x in c if h == g and v is not None and x is not None]
        if near:
            gap, j = min(near)
            want[i] = (j, gap)
    assert got == want


def test_strong_components_against_brute_force(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (5, 7), (8, 9), (10, 10), (9, 11), (11, 8), (7, 12), (None, 3), (12, None), (1, 2)]
    live = {(a, b) for a, b in edges if a is not None and b is not None}
    nodes = {x for e in live for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in live:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    df = spark.createDataFrame(edges, "src long, dst long")
    scc = matching.strong_components(df)
    assert {r.node: r.scc for r in scc.collect()} == want
    cond = corpus.condense(df.dropna(), scc)
    assert {(r.src, r.dst) for r in cond.collect()} == {(want[a], want[b]) for a, b in live if want[a] != want[b]}
    assert corpus.hop_cap(cond) == 4 and corpus.hop_cap(cond, 2) == 2
    assert {r.node for r in corpus.members(scc, 8).collect()} == {8, 9, 11}
    assert matching.strong_components(df.limit(0)).count() == 0


def test_khop_keeps_least_hops(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 1)], "src long, dst long")
    out = analytics.khop(e, spark.createDataFrame([(1,)], "node long"), 3)
    assert {r.node: r.hops for r in out.collect()} == {1: 0, 2: 1, 3: 1, 4: 2}


def test_dedup_jaccard_against_all_pairs(spark):
    base = [f"t{i}" for i in range(20)]
    rows = [(0, base), (1, base[:-1]), (2, base[:-2]), (3, [*base, "x"]), (4, ["a", "b"]), (5, ["b", "a"]), (6, []), (7, None), (8, [None, "a", "b"]), (9, base[:10])]
    sets = {i: {x for x in t or [] if x} for i, t in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = matching.dedup_jaccard(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t", 0.85)
    assert {r.id: r.component for r in got.collect()} == root


def test_minhash_finds_copies(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words)), (1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(f"v{i}" for i in range(60))), (4, None), (5, "")]
    got = {r.id: r.component for r in minhash.minhash_dedup(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}


def test_window_and_tolerance_joins_against_all_pairs(spark):
    a = [(i, i % 3, f"2024-01-{1 + i % 28:02d} 05:00:00") for i in range(60)]
    b = [(i, i % 4, f"2024-01-{1 + i * 5 % 28:02d} 06:00:00") for i in range(60)]
    x = spark.createDataFrame(a, "ia long, k int, ta string").withColumn("ta", F.col("ta").cast("timestamp"))
    y = spark.createDataFrame(b, "ib long, k int, tb string").withColumn("tb", F.col("tb").cast("timestamp"))
    got = {(r.ia, r.ib) for r in joins.window_join(x, y, "k", "ta", "tb", 3).collect()}
    day = lambda t: int(t[8:10]) * 24 + int(t[11:13])
    assert got == {(i, j) for i, k, s in a for j, m, t in b if k == m and 0 <= day(t) - day(s) <= 72}
    p = [(i, i % 2, i * 7 % 40, i * 7 % 40 + i % 5) for i in range(30)]
    g = [(i, i % 2, i * 3 % 40, i * 3 % 40 + 2) for i in range(30)]
    df = lambda rows, n: spark.createDataFrame(rows, f"{n} long, t int, s int, e int")
    got = {r.gid: r.pid for r in joins.tolerance_join(df(p, "pid"), df(g, "gid"), ["t"], ["s", "e"], 2, "gid", "pid").collect()}
    want = {}
    for i, t, s, e in g:
        near = [j for j, u, v, w in p if u == t and abs(s - v) <= 2 and abs(e - w) <= 2]
        if near:
            want[i] = min(near)
    assert got == want


def test_internal_ratings_formula(spark):
    nd = NormalDist()
    for pd in (0.001, 0.02, 0.3):
        w = (1 - math.exp(-50 * pd)) / (1 - math.exp(-50))
        r = 0.12 * w + 0.24 * (1 - w)
        z = (nd.inv_cdf(pd) + math.sqrt(r) * nd.inv_cdf(0.999)) / math.sqrt(1 - r)
        want = 1000 * 12.5 * 0.45 * (nd.cdf(z) - pd)
        got = spark.range(1).select(domain.rwa_internal(F.lit(1000.0), F.lit(pd), F.lit(0.45)).alias("x")).head().x
        assert got == pytest.approx(want, rel=1e-7)


def test_tail_probabilities(spark):
    # fixed values: standard tables of the chi-square, t and F laws
    cases = [(num.probchi(F.lit(3.841458820694124), F.lit(1)), 0.95), (num.probchi(F.lit(18.307038053275146), F.lit(10)), 0.95), (num.probt(F.lit(2.2281388519649385), F.lit(10)), 0.975), (num.probf(F.lit(3.3258345304130112), F.lit(5), F.lit(10)), 0.95)]
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).head()
    assert list(row) == pytest.approx([w for _, w in cases], abs=1e-6)


def test_stepwise_finds_the_variables(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    y = 3 + 2 * x[:, 0] - x[:, 2] + rng.normal(size=400) * 0.1
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, 0.0, 0.0, 0.0, 0.0)]
    got = {r.term: r for r in models.stepwise(spark.createDataFrame(rows, "a double, b double, c double, d double, y double"), "y", ["a", "b", "c", "d"], 0.001, 0.001).collect()}
    assert set(got) == {"intercept", "a", "c"} and abs(got["a"].coefficient - 2) < 0.05 and got["a"].p_value < 1e-6
    coef, p, _ = models.solve(*models.gram(spark.createDataFrame(rows, "a double, b double, c double, d double, y double"), ["a", "b"], "y"), [1, 2])
    full = np.c_[np.ones(400), x[:, :2]]
    assert coef == pytest.approx(np.linalg.lstsq(full, y, rcond=None)[0]) and p[2] > 0.001


def test_net_and_impute_with_nulls(spark):
    df = spark.createDataFrame([(1, 2, 10.0), (2, 1, 4.0), (1, 1, 9.0), (3, 1, None), (None, 1, 2.0)], "a long, b long, v double")
    got = {(r.party_a, r.party_b): (r.difference, r.status) for r in recon.net_pairs(df, "a", "b", "v", 1, 5).collect()}
    assert got[1, 2] == (6.0, "MATERIAL")
    out = recon.impute(df, {"v": F.lit(0.0)}).where("v_imputed").collect()
    assert len(out) == 1 and out[0].v == 0.0


def test_adversarial_table(spark):
    out = domain.adversarial(spark.range(1, 5001).withColumnRenamed("id", "k"), "k")
    n = out.count()
    assert n == 5002 and out.distinct().count() == 5000
    nulls = out.where("num is null").count() / n
    assert 0.06 < nulls < 0.1 and out.where("num = 0").count() and out.where("num < 0").count() and out.where("num = 999999.99").count()
