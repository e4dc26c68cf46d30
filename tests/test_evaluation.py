"""Decisions, lift tables, splits, comparisons and features against plain computations."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowmill.operators import analytics, corpus, matching, models, search


def test_ab_decision(spark):
    rows = [("c", i % 10 < 2, float(i % 7)) for i in range(400)] + [("up", i % 10 < 4, float(i % 7) + 1) for i in range(300)]
    rows += [("down", i % 20 < 1, 1.0) for i in range(400)] + [("same", i % 10 < 2, 3.0) for i in range(20)]
    got = {r.g: r for r in analytics.ab_decision(spark.createDataFrame([(g, int(y), v) for g, y, v in rows], "g string, y int, v double"), "g", "c", "y", "v").collect()}
    assert {g: (r.winner, r.decision) for g, r in got.items()} == {"up": ("TEST_WINS", "LAUNCH"), "down": ("CONTROL_WINS", "REVERT"), "same": ("INCONCLUSIVE", "EXTEND_OR_STOP")}
    r, va, vb = got["up"], 0.24 / 299, 0.16 / 399
    se = math.sqrt(va + vb)
    assert r.rate_lift == pytest.approx(1.0) and r.t == pytest.approx(0.2 / se) and r.df == pytest.approx((va + vb) ** 2 / (va**2 / 299 + vb**2 / 399))
    assert (r.ci_lower, r.ci_upper) == (pytest.approx(0.2 - 1.96 * se), pytest.approx(0.2 + 1.96 * se))
    assert r.detectable == pytest.approx(2.8 * math.sqrt(0.2 * 0.8 / 300)) and r.p < 1e-6
    assert got["same"].p == pytest.approx(1.0) and got["same"].t == pytest.approx(0.0)


def test_gini_and_baseline(spark):
    rng = random.Random(3)
    rows = [(i, float(i), int(rng.random() < (i / 1000) ** 2)) for i in range(1000)]
    got = analytics.lift_table(spark.createDataFrame(rows, "i long, s double, y int"), "s", "y").orderBy("decile").collect()
    events, n = [r.events for r in got], [r.n for r in got]
    area, good, bad = 0.0, 0, 0
    for e, m in zip(events, n, strict=True):
        area += (m - e) / (sum(n) - sum(events)) * (2 * good + e) / sum(events) / 2
        good, bad = good + e, bad + m - e
    assert all(r.gini == pytest.approx(2 * area - 1) and r.baseline == pytest.approx(sum(events) / sum(n)) for r in got)
    assert 0.4 < got[0].gini < 0.9


def test_stratified_split_is_exact_in_every_label(spark):
    rows = [(i, "rare" if i < 7 else "common" if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = models.stratified_split(df, "id", "label", 80, 1)
    count = Counter((r.label, r.part) for r in got.collect())
    for label, n in Counter(x for _, x in rows).items():
        assert count[label, "TRAIN"] == -(-n * 80 // 100) and count[label, "TRAIN"] + count[label, "VALID"] == n
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, models.stratified_split(df.repartition(3), "id", "label", 80, 1).collect()))


def test_retrieval_delta(spark):
    ev = lambda *r: spark.createDataFrame(list(r), "tier string, n_queries long, hit_at_k double, mrr double")
    got = {r.tier: r for r in search.retrieval_delta(ev(("a", 10, 0.9, 0.5), ("b", 30, 0.5, 0.4)), ev(("a", 10, 0.8, 0.5), ("b", 30, 0.6, 0.1)), "tier").collect()}
    assert got["a"].hit_gain == pytest.approx(0.1) and got["b"].mrr_gain == pytest.approx(0.3)
    assert got[None].n_queries == 40 and got[None].hit_0 == pytest.approx(0.6) and got[None].hit_gain == pytest.approx(-0.05)


def test_contrastive_partners_and_caps(spark):
    df = spark.createDataFrame([(i, i % 4, i % 4 // 2, "own" if i % 2 else None) for i in range(200)], "id long, label int, broad int, p string")
    rows = search.contrastive_pairs(df, "id", "label", "broad", partner="p", most={1.0: 25, 0.0: 0}).collect()
    assert Counter(r.score for r in rows)[1.0] == 25 and not any(r.score == 0.0 for r in rows)
    assert {r.a for r in rows if r.score == 0.8} == set(range(1, 200, 2)) and all(r.a == r.b for r in rows if r.score == 0.8)


def test_program_vector_has_fourteen_features(spark):
    code = """%macro m; data out; retain total; merge a b; if x > 1 then do; call execute('y'); end;
array q{3} q1-q3; do i = 1 to 3; output; end;
declare hash h; call symputx('n', 1); set _null_;
proc transpose data=out; proc sql; create table t as select * from (select * from A); %put %eval(1);"""
    docs = spark.createDataFrame([(1, code, "MACRO"), (2, "plain text", "OTHER"), (3, None, "MACRO")], "id long, code string, kind string")
    got = {r.id: r.asDict() for r in corpus.program_vector(docs, "id", "code", F.col("kind"), F.col("id") == 2, {"MACRO": 2.0}).collect()}
    assert len(got[1]) - 1 == 14
    assert all(got[1][f"has_{f}"] == 1.0 for f in corpus.PROGRAM_FLAGS) and not any(got[2][f"has_{f}"] for f in corpus.PROGRAM_FLAGS)
    names = {x.lower() for x in re.findall(r"(?i)\b(?:DATA|SET|MERGE|FROM|INTO|UPDATE)\s+(\w+(?:\.\w+)?)", code)} - {"_null_"}
    assert got[1]["dataset_count_norm"] == pytest.approx(min(len(names) / 5, 1.5)) and got[1]["macro_pct"] == pytest.approx(min(code.count("%") / 4, 1.5))
    assert got[1]["line_count_norm"] == 4 / 200 and got[1]["type_weight"] == 2.0 and got[2]["is_ambiguous"] == 1.0 and got[1]["nesting_norm"] > 0


def test_members_of_a_component(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6)], "src long, dst long")
    scc = matching.strong_components(edges)
    assert sorted(r.node for r in corpus.members(scc, 1).collect()) == [1, 2, 3]
    assert sorted(map(tuple, corpus.component_sizes(scc).collect())) == [(1, 3, 1), (4, 2, 4)]


def test_ranks_of_many_columns_equal_those_of_each(spark):
    from rowmill.operators import ordered

    rng = random.Random(6)
    rows = [(i, rng.choice([None, *range(12)]), rng.choice([1.5, 1.5, 1.5, float("inf"), -2.0, rng.random()])) for i in range(700)]
    df = spark.createDataFrame(rows, "i long, a int, b double")
    got = {r.i: (r.x, r.y) for r in ordered.proc_rank_many(df, {"a": ("x", True), "b": ("y", False)}, 5).collect()}
    one = {r.i: r.x for r in ordered.proc_rank(df, "a", 5, "x", descending=True).collect()}
    two = {r.i: r.y for r in ordered.proc_rank(df, "b", 5, "y").collect()}
    assert got == {i: (one[i], two[i]) for i in one}
    assert ordered.proc_rank_many(df.limit(0), {"a": ("x", True)}, 5).count() == 0
