"""Matching and workload operators on small tables with nulls, blanks, ties and no rows."""

import pytest
from pyspark.sql import functions as F

from rowmill.operators import matching, workloads


def test_overlap_and_weighted_score(spark):
    df = spark.createDataFrame([("abc", "abd"), ("a", ""), (None, "a"), ("abcd", "ab")], "a string, b string")
    got = [r[0] for r in df.select(matching.overlap(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(2 / 3) and got[1] == 0 and got[2] is None and got[3] == 0.5
    part = df.select(matching.weighted_score([(0.6, matching.overlap(F.col("a"), F.col("b"))), (0.4, F.lit(1.0))])).collect()
    assert part[2][0] == pytest.approx(1.0)


def test_components_of_a_chain_a_cycle_and_a_loop(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51), (51, 52), (52, 50), (70, 70), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in matching.components(e).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[52] == 50 and got[70] == 70 and len(got) == 34
    assert matching.components(e.limit(0)).count() == 0


def test_golden_takes_the_first_filled_value(spark):
    r = spark.createDataFrame([(1, 1, None, "x"), (1, 2, " ", "y"), (1, 3, "c", None), (2, 4, None, None)], "c int, k int, name string, phone string")
    got = {x.c: (x.n_records, x.name, x.phone) for x in matching.golden(r, ["c"], [F.col("k")], ["name", "phone"]).collect()}
    assert got == {1: (3, "c", "x"), 2: (1, None, None)}


def test_nearest_match_ties_go_to_the_smaller_id(spark):
    t = spark.createDataFrame([(1, "a", 5.0), (2, "b", 5.0)], "id long, k string, v double")
    c = spark.createDataFrame([(9, "a", 6.0), (8, "a", 4.0)], "id long, k string, v double")
    assert [tuple(r) for r in matching.nearest_match(t, c, ["k"], "v", "id", "id").collect()] == [(1, 8, 1.0)]


def test_returns_after_zero_are_null(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("a", 3, 0.0), ("a", 4, 1.0)], "k string, t int, v double")
    got = workloads.returns(df, ["k"], "t", "v", 0.4).orderBy("t").collect()
    assert [r.simple for r in got] == [None, 0.5, None, None] and [r.extreme for r in got] == [False, True, False, False]


def test_attribution_sums_to_the_excess_return(spark):
    p = spark.createDataFrame([("x", 0.7, 0.1), ("y", 0.3, 0.02)], "s string, w double, r double")
    b = spark.createDataFrame([("x", 0.4, 0.08), ("z", 0.6, 0.03)], "s string, w double, r double")
    got = workloads.attribution(p, b, "s").agg(F.sum(F.col("allocation") + F.col("selection") + F.col("interaction"))).first()[0]
    assert got == pytest.approx((0.07 + 0.006) - (0.032 + 0.018))


def test_aging_edges(spark):
    df = spark.createDataFrame([("2001-01-31",), ("2001-01-30",), ("2001-01-01",), ("2000-10-01",), (None,)], "due string")
    assert [r.bucket for r in workloads.aging(df, "due", "2001-01-31").collect()]== ["CURRENT", "1-30", "1-30", "90+", None]
