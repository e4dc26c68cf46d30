"""Names matched by positions against all pairs, and how many pairs are looked at."""

import random

import pytest
from pyspark.sql import functions as F

from rowmill.operators import fuzzy


def names(n, seed):
    rng = random.Random(seed)
    out = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 14))) for _ in range(n)]
    for i in range(0, n, 3):  # near copies of earlier names
        w = list(out[rng.randrange(n)])
        w[rng.randrange(len(w))] = rng.choice("xyz")
        out[i] = "".join(w)
    return [*out, "", None, "a", "b", "ab", "same name here", "same name here"]


def share(x, y):
    return sum(p == q for p, q in zip(x, y, strict=False)) / max(len(x), len(y)) if x and y else 0


@pytest.mark.parametrize("least", [0.4, 0.7, 1.0])
def test_no_pair_is_lost_and_few_are_looked_at(spark, least):
    a, b = list(enumerate(names(300, 1))), list(enumerate(names(200, 2) + names(300, 1)[:50]))
    da, db = spark.createDataFrame(a, "i long, x string"), spark.createDataFrame(b, "j long, y string")
    got = {(r.i, r.j) for r in fuzzy.candidate_pairs(da, db, "i", "x", "j", "y", least).collect()}
    want = {(i, j) for i, x in a for j, y in b if share(x, y) >= least - 1e-12 and share(x, y) > 0}
    assert want <= got
    assert len(got) < {0.4: 0.25, 0.7: 0.04, 1.0: 0.01}[least] * len(a) * len(b)


def test_scores_equal_all_pairs_in_blocks(spark):
    a = [(i, x, i % 3, float(i % 5 - 2)) for i, x in enumerate(names(200, 3))]
    b = [(j, y, j % 3, float(j % 4 - 2)) for j, y in enumerate(names(200, 4) + names(200, 3)[:60])]
    da, db = spark.createDataFrame(a, "i long, x string, g int, u double"), spark.createDataFrame(b, "j long, y string, g int, v double")
    same = ((F.col("u") > 0) == (F.col("v") > 0)).cast("int")
    got = {(r.i, r.j): (round(r.score, 9), r.status) for r in fuzzy.match_names(da, db, "i", "x", "j", "y", [(0.4, same)], 0.6, 0.9, 0.75, ["g"]).collect()}
    want = {}
    for i, x, g, u in a:
        for j, y, h, v in b:
            s = (0.6 * share(x, y) + 0.4 * ((u > 0) == (v > 0))) / 1.0
            if g == h and s >= 0.75 and x and y:
                want[i, j] = (round(s, 9), "FUZZY" if s >= 0.9 else "REVIEW")
    assert got == want
    with pytest.raises(ValueError):
        fuzzy.match_names(da, db, "i", "x", "j", "y", [(0.4, same)], 0.6, 0.9, 0.3)


@pytest.mark.parametrize("rows", [16, 1024])
def test_blocks_equal_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(fuzzy, "ROWS", rows)  # many cells a block, then one
    a = [(i, x, i % 3 if i % 11 else None, i % 5 > 1 if i % 4 else None) for i, x in enumerate([*names(120, 5), "né", "日本", "x😀y"])]
    b = [(j, y, j % 3, j % 4 > 1) for j, y in enumerate([*names(90, 6), *names(120, 5)[:40], "ne", "日本", "x😀z"])]
    da, db = spark.createDataFrame(a, "i long, x string, g int, u boolean"), spark.createDataFrame(b, "j long, y string, g int, v boolean")
    out = fuzzy.match_blocks(da, db, "i", "x", "j", "y", ["g"], [(0.4, (F.col("u") == F.col("v")).cast("int"))], 0.6, 0.8, 0.5)
    got = {(r.i, r.j): (round(r.score, 9), r.status) for r in out.collect()}
    want = {}
    for i, x, g, u in a:
        for j, y, h, v in b:
            parts = [(0.6, None if x is None or y is None or not x + y else share(x, y)), (0.4, None if u is None else float(u == v))]
            parts = [(w, s) for w, s in parts if s is not None]
            s = sum(w * s for w, s in parts) / sum(w for w, _ in parts) if parts else 0
            if g == h and s >= 0.5:
                want[i, j] = (round(s, 9), "FUZZY" if s >= 0.8 else "REVIEW")
    assert got == want


def test_fuzzy_match_compares_names_as_arrays(spark):
    from rowmill import catalog

    plan = catalog.queries()["fuzzy_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "aggregate(" not in plan


def test_numbered_names_meet_on_many_marks(spark):
    """Names of one form share their constant marks: pairs of marks bring many that are not alike."""
    a = spark.range(0, 30000, 7).select(F.col("id").alias("i"), F.format_string("Customer#%09d", "id").alias("x"))
    b = spark.range(0, 30000, 101).select(F.col("id").alias("j"), F.format_string("Supplier#%09d", "id").alias("y"))
    pairs = fuzzy.candidate_pairs(a, b, "i", "x", "j", "y", 0.65)
    got = {(r.i, r.j) for r in pairs.collect()}
    like = {(i, j) for i in range(0, 30000, 7) for j in range(0, 30000, 101) if sum(p != q for p, q in zip(f"{i:09d}", f"{j:09d}", strict=True)) <= 1}
    assert like <= got
    assert len(got) <= 3 * len(like)
