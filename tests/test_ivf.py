"""The inverted file against exact search: recall and the share of rows scored."""

import numpy as np
import pytest

from rowmill.operators import analytics, ivf


def recall(spark, df, key, vec, k, probes, lists=None):
    queries = df.where(f"{key} % 20 = 0")
    index = ivf.build(df, key, vec, lists)
    got = {(r.query_id, r.id) for r in ivf.search(index, queries, key, vec, k, probes).collect()}
    want = {(r.q_id, r.b_id) for r in analytics.knn(queries, df, k, key, vec).collect()}
    return len(got & want) / len(want), ivf.share_scored(index, queries, key, vec, probes), got, want


def test_recall_on_the_given_vectors(spark):
    """They are nearly isotropic, so a good recall needs many lists."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found, share, _, _ = recall(spark, df, "vec_id", "embedding", 5, 32)
    print(f"recall {found:.3f}, share of rows scored {share:.3f}")
    assert found >= 0.9 and share < 0.8


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 16)) * 3
    rows = [(i, [float(x) for x in centres[i % 60] + rng.standard_normal(16) * 0.4]) for i in range(6000)]
    return spark.createDataFrame(rows, "id long, v array<float>")


def test_few_rows_are_scored_where_vectors_are_clustered(spark, clustered):
    found, share, _, _ = recall(spark, clustered, "id", "v", 10, 4)
    assert found >= 0.95 and share < 0.1


def test_all_lists_give_the_exact_result_in_parts_and_blocks(spark, clustered, monkeypatch):
    monkeypatch.setattr(ivf, "PART", 100)
    monkeypatch.setattr(ivf, "BLOCK", 50)
    some = clustered.where("id < 900")
    found, share, got, want = recall(spark, some, "id", "v", 7, 8, lists=8)
    assert got == want and share == 1.0


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = ivf.search(ivf.build(df, "id", "v", 1), df.where("id = 0"), "id", "v", 3, 1).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(1, 1.0), (6, 0.0)]
    none = df.where("id > 9")
    assert ivf.search(ivf.build(none, "id", "v"), none, "id", "v", 3, 1).count() == 0
