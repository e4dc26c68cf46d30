"""Small witnesses whose results are known by hand."""

import datetime as dt

from pyspark.sql import functions as F

from rowmill.functions import dates, numbers, text
from rowmill.operators import agg, etl, joins, ordered, rows, setops


def col(df, c, *by):
    return [r[c] for r in df.orderBy(*by).collect()]


def test_retain_reset(spark):
    df = spark.createDataFrame([(g, i, 1) for g in "AB" for i in range(3)], "g string, i int, v int")
    assert col(ordered.running_sum(df, F.col("v"), ["g"], ["i"], "t"), "t", "g", "i") == [1, 2, 3, 1, 2, 3]
    assert col(ordered.sas_lag(df, "v", 1, ["g"], ["i"], "l"), "l", "g", "i") == [None, 1, 1, None, 1, 1]


def test_null_addend_counts_zero(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0), ("A", 3, None)], "g string, i int, v double")
    assert col(ordered.running_sum(df, F.col("v"), ["g"], ["i"], "t"), "t", "i") == [1, 3, 3]


def test_zip_merge_differs_from_join(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "k int, x string")
    b = spark.createDataFrame([(1, 10), (1, 20)], "k int, y int")
    out = joins.zip_merge(a, b, ["k"], ["x"], ["y"])
    assert [(r.x, r.y) for r in out.orderBy("_seq").collect()] == [("a", 10), ("b", 20), ("c", 20)]


def test_outer_merge_keeps_every_key(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "key int, v int")
    b = spark.createDataFrame([(2, 2), (3, 3), (4, 4)], "key int, v int")
    out = joins.merge_by(a, b, ["key"])
    assert sorted(r.key for r in out.collect()) == [1, 2, 3, 4]
    assert {"v_x", "v_y"} <= set(out.columns)


def test_proc_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 9.0), (5, None)], "i int, v double")
    # mean ranks 1, 2.5, 2.5, 4 of 4 rows in 2 groups
    assert col(ordered.proc_rank(df, "v", 2, "g"), "g", "i") == [0, 1, 1, 1, None]


def test_clamped_balance_against_loop(spark):
    deltas = [5, -9, 3, -1, -4, 7, 2, -30, 1]
    df = spark.createDataFrame([(0, i, d) for i, d in enumerate(deltas)], "g int, i int, d int")
    want, run = [], 0
    for d in deltas:
        run = max(0, run + d)
        want.append(run)
    assert col(ordered.clamped_balance(df, ["g"], ["i"], F.col("d"), "b"), "b", "i") == want


def test_global_order_is_the_same_for_any_bucketing(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("o"), F.col("id").alias("v"))
    for join in ("false", "true"):  # several buckets, and one
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", join)
        got = ordered.global_running_sum(df, F.col("v"), ["o"], "s").orderBy("o").collect()
        run = 0
        for r in got:
            run += r.v
            assert r.s == run
        lag = ordered.global_lag(df, "v", ["o"], "l").orderBy("o").collect()
        assert [r.l for r in lag] == [None, *(r.v for r in lag[:-1])]


def test_null_class_is_a_level_and_all_null_sum_is_null(spark):
    df = spark.createDataFrame([(None, None), ("a", 1.0)], "c string, v double")
    out = {r.c: r for r in agg.proc_means(df, ["c"], ["v"], ("n", "nmiss", "sum")).collect()}
    assert out[None].v_sum is None and out[None].v_nmiss == 1 and out["a"].v_sum == 1


def test_missing_compares_lowest(spark):
    df = spark.createDataFrame([(None,), (3.0,), (9.0,)], "x double")
    assert [r.a for r in df.select(rows.sas_cmp(F.col("x"), "<", 5).alias("a")).collect()] == [True, True, False]


def test_sort_missing_first_and_last(spark):
    df = spark.createDataFrame([(1, 2), (2, None), (3, 1)], "i int, v int")
    assert [r.i for r in setops.proc_sort(df, ["v"]).collect()] == [2, 3, 1]
    assert [r.i for r in setops.proc_sort(df, ["-v"]).collect()] == [1, 3, 2]


def test_scd2_keeps_history(spark):
    d = dt.date
    dim = spark.createDataFrame([(1, 10, "a", d(2000, 1, 1), d(9999, 12, 31), True)], "dim_key long, k long, v string, effective_from date, effective_to date, current_flag boolean")
    stage = spark.createDataFrame([(10, "b"), (11, None)], "k long, v string")
    out = {(r.k, r.v): r for r in etl.scd2(dim, stage, "k", ["v"], "2001-01-01").collect()}
    assert out[(10, "a")].effective_to == d(2000, 12, 31) and not out[(10, "a")].current_flag
    assert {out[(10, "b")].dim_key, out[(11, None)].dim_key} == {2, 3}


def test_dates_and_text(spark):
    one = spark.range(1)
    d = F.lit("2000-12-31").cast("date")
    r = one.select(dates.intck("year", d, F.date_add(d, 1)).alias("y"), dates.intnx("month", F.lit("2000-01-31").cast("date"), 1, "S").alias("s"), dates.intck("week", d, F.date_add(d, 7)).alias("w"), dates.intnx("year", d, 0, "B", 7).alias("f"), text.scan(F.lit("a b  c"), -1).alias("last"), text.scan(F.lit("a"), 2).alias("none"), text.compress(F.lit("a1-b2"), "", "kd").alias("digits"), text.currency(F.lit("$1,234.56")).alias("money")).head()
    assert (r.y, r.s, r.w, r.f, r.last, r.none, r.digits, r.money) == (1, dt.date(2000, 2, 29), 1, dt.date(2000, 7, 1), "c", None, "12", 1234.56)


def test_normal_distribution(spark):
    from statistics import NormalDist

    xs = [-6.5, -3.9, -1.0, 0.0, 0.3, 2.5, 4.1, 7.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", numbers.probnorm("x").alias("p"))
    for r in df.withColumn("z", numbers.probit("p")).collect():
        assert abs(r.p - NormalDist().cdf(r.x)) < 1e-12
        if abs(r.x) < 5:
            assert abs(r.z - r.x) < 1e-8


def test_equal_amounts_tie_in_any_order(spark, tmp_path):
    """Two customers with the same orders in another order have the same attainment, so the same quartile."""
    from rowmill import catalog

    rows = [(1, 0.1), (1, 0.2), (1, 0.3), (8, 0.3), (8, 0.2), (8, 0.1), (7, 5.0)]
    spark.createDataFrame(rows, "o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_custkey: (r.band, r.quartile) for r in catalog.queries()["quota_attainment"](spark, str(tmp_path)).collect()}
    assert got == {1: ("BELOW", 2), 8: ("BELOW", 2), 7: ("NO_QUOTA", None)}
