"""Exact nearest rows in cells against brute force: copies, nulls, zero and odd vectors, groups, marks; no pairs are formed."""

import math
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.operators import nearest, search

SF = "/root/testdata/sf0.001"


def vectors(n, seed=0):
    """Vectors with many ties and copies, and a few without a usable direction."""
    rng = np.random.default_rng(seed)
    out = [[float(x) for x in rng.integers(-2, 3, 4)] if i % 3 else [float(x) for x in rng.normal(size=4)] for i in range(n)]
    for i in range(0, n - 12, 12):
        out[i], out[i + 1], out[i + 2], out[i + 3], out[i + 4] = None, [0.0] * 4, out[i + 5], [1.0, None, 2.0, 3.0], [1e200, -1e200, 0.0, 1.0]
    return out


def cosine(a, b):
    if a is None or b is None or None in a or None in b:
        return None
    dot = lambda x, y: reduce(lambda total, p: total + p, (p * q for p, q in zip(x, y, strict=True)), 0.0)  # noqa: E731  sum() would round otherwise
    n, m = math.sqrt(dot(a, a)), math.sqrt(dot(b, b))
    return None if n == 0 or m == 0 else dot(a, b) / (n * m)


def best(rows, k, able):
    """{query: [(id, score)]}, nulls last and NaN first, ties to the smaller id."""
    out = {}
    for i, v in rows:
        if i % 5 == 0:
            scored = [(j, cosine(v, w)) for j, w in rows if j != i and able(i, j)]
            key = lambda x: (-(-math.inf if x[1] is None else math.inf if math.isnan(x[1]) else x[1]), x[0])
            out[i] = sorted(scored, key=key)[:k]
    return out


def ranked(df, k):
    out = {}
    for r in search.top(df, "query_id", "score", "id", k).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    return {q: [(i, s) for _, i, s in sorted(x)] for q, x in out.items()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cell", [64, 1 << 20])
def test_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(nearest, "CELL", cell)  # many parts and blocks, then one
    rows = list(enumerate(vectors(150)))
    df = spark.createDataFrame([(i, v, i % 3 if i % 7 else None) for i, v in rows], "i long, v array<double>, g int")
    same = lambda a, b: a == b or (a != a and b != b)
    flat = ranked(nearest.nearest(df.where("i % 5 = 0"), df, "i", "v", 6), 6)
    kept = ranked(nearest.nearest(df.where("i % 5 = 0"), df, "i", "v", 6, group="g"), 6)
    for got, able in ((flat, lambda i, j: True), (kept, lambda i, j: i % 7 and j % 7 and i % 3 == j % 3)):
        want = {q: x for q, x in best(rows, 6, able).items() if x}
        assert got.keys() == want.keys()
        for q, x in want.items():
            assert [i for i, _ in got[q]] == [i for i, _ in x]
            assert all(same(s, t) for (_, s), (_, t) in zip(got[q], x, strict=True))


def test_rounded_scores_keep_their_ties(spark):
    rows = [(0, [1.0, 0.0]), (9, [1.0, 1e-3]), (3, [1.0, 2e-3]), (5, [1.0, 1e-1])]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    near = nearest.nearest(df.where("i = 0"), df, "i", "v", 1, tie=1e-4).withColumn("score", F.round("score", 4))
    assert [x[0] for x in ranked(near, 1)[0]] == [3]


def test_marked_rows_equal_the_join_of_buckets(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "i long, v array<double>")
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    unit = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(u)], "i long, u array<double>").withColumn("f", array_to_vector("u"))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=0.1, numHashTables=2, seed=1).fit(unit)
    met = {(r.a, r.b) for r in model.approxSimilarityJoin(unit.where("i % 20 = 0"), unit, 2.0).select(F.col("datasetA.i").alias("a"), F.col("datasetB.i").alias("b")).collect()}
    assert len(met) < 0.7 * 10 * 200
    near = search.lsh_top(df.where("i % 20 = 0"), df, "i", "v", 5, width=0.1, tables=2)
    got = {}
    for r in near.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q in range(0, 200, 20):
        want = sorted((i for i in range(200) if i != q and (q, i) in met), key=lambda i: (-(u[q] @ u[i]), i))[:5]
        assert [i for _, i in sorted(got[q])] == want
    assert "Generate" not in plan_of(near).split("FlatMapCoGroupsInArrow")[0]  # rows are not joined by their buckets
    assert "FlatMapCoGroupsInArrow" in plan_of(near)


#: Queries that search cells.
IN_CELLS = ["knn_cosine", "knn_cosine_all", "label_retrieval", "retrieval_compare", "adaptive_k", "knn_filtered", "retrieval_eval", "hybrid_search"]


@pytest.mark.parametrize("name", IN_CELLS)
def test_queries_form_no_pairs(spark, name):
    """Scores of pairs are no expressions after a join; results are held against SQL in test_queries."""
    from rowmill import catalog

    plan = plan_of(catalog.queries()[name](spark, SF))
    assert "zip_with" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_first_other_against_all_pairs(spark):
    rows = [(i, g) for i, g in enumerate([0, 0, 1, None, 2, 2, 0, 2]) for _ in range(1 + i % 2)]
    df = spark.createDataFrame(rows, "i long, g int")
    got = {r.query_id: r.id for r in search.first_other(df, df, "g", "i").collect()}
    assert got == {i: min(j for j, h in rows if h == g and j != i) for i, g in rows if g in (0, 2)}
