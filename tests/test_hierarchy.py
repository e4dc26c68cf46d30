"""Mixtures and trees on planted blobs: their number is found, every node has its way to the root."""

import numpy as np
import pytest

from rowmill.operators import hierarchy, search


def frame(spark, v):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(v)], "id long, v array<double>")


def blobs(k, n, d, seed):
    rng = np.random.default_rng(seed)
    at = rng.standard_normal((k, d)) * 6
    return at[np.arange(n) % k] + rng.normal(size=(n, d)) * 0.5


def test_the_planted_number_is_found(spark):
    """Five blobs in 12 dimensions: principal components first, then a mixture of five parts."""
    df = frame(spark, blobs(5, 400, 12, 3))
    rows = hierarchy.soft_clusters(df, "id", "v").collect()
    of = {r.id: r.cluster for r in rows}
    assert len(rows) == len(of) == 400 and all(0 < r.p <= 1 + 1e-9 for r in rows)
    assert len(set(of.values())) == 5
    assert all(len({of[i] for i in range(b, 400, 5)}) == 1 for b in range(5))


def test_one_blob_is_one_part(spark):
    x = hierarchy.principal(frame(spark, blobs(1, 300, 3, 4)).withColumnRenamed("id", "node"))
    assert hierarchy.choose(x, 300).parts == 1


def test_mixture_equals_plain_rounds(spark):
    """One round against the same sums in numpy."""
    v = blobs(3, 90, 2, 5)
    x = frame(spark, v).withColumnRenamed("id", "node").withColumnRenamed("v", "x").repartition(4)
    m = hierarchy.Mixture(np.full(3, 1 / 3), v[:3].copy(), np.stack([np.eye(2)] * 3), np.nan)
    new, like = hierarchy._step(x, m)
    d2 = ((v[:, None] - m.means) ** 2).sum(-1)
    dens = np.exp(-d2 / 2) / (2 * np.pi) / 3
    p = dens / dens.sum(1, keepdims=True)
    assert like == pytest.approx(np.log(dens.sum(1)).sum())
    assert new.means == pytest.approx((p.T @ v) / p.sum(0)[:, None])


def test_tree_links_every_leaf_to_one_root(spark):
    df = frame(spark, blobs(12, 480, 4, 6))
    rows = hierarchy.cluster_tree(df, "id", "v", few=8).collect()
    levels = {}
    for r in rows:
        levels.setdefault(r.level, {})[r.node] = r.parent
    assert sorted(levels[0]) == list(range(480))
    for lv, up in levels.items():
        if lv + 1 in levels:
            assert set(up.values()) == set(levels[lv + 1])
    assert set(levels[max(levels)].values()) == {0}
    assert len(set(levels[0].values())) == 12
    assert search.flat_index(hierarchy.cluster_tree(df, "id", "v")).count() == 480


def test_awkward_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)] + [(40, None), (41, [None, 1.0]), (42, [float("nan"), 1.0])], "id long, v array<double>")
    rows = hierarchy.cluster_tree(df, "id", "v").collect()
    assert {(r.level, r.node, r.parent) for r in rows} >= {(0, i, 0) for i in range(30)} or len({r.node for r in rows if r.level == 0}) == 30
    none = df.where("id > 50")
    assert hierarchy.cluster_tree(none, "id", "v").count() == 0
    assert hierarchy.soft_clusters(none, "id", "v").count() == 0
