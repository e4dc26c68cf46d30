"""The hash-prefix forest where it selects: shards far above what is scored at least."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.llm import ann


def clustered(n, d=64, parts=400):
    rng = np.random.default_rng(0)
    return rng.standard_normal((parts, d))[np.arange(n) % parts] + 0.35 * rng.standard_normal((n, d))


def run(x, ids, queries, k, share):
    tally = []
    rows, found, _ = ann.search(ids, x, ids[queries], x[queries], k, x.mean(0), ann.TREES, ann.BITS, share, ann.FOUND, ann.LEAST if share > 2 else 1, tally)
    hits = 0
    for t, q in enumerate(queries):
        near = x @ x[q]
        near[q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -near))[:k]]) & set(found[rows == t]))
    return hits / len(queries) / k, np.mean(tally) / len(ids)


@pytest.mark.parametrize(("share", "most"), [(2.0, 0.02), (ann.SHARE, 0.25)])
def test_few_rows_are_scored_in_a_large_shard(share, most):
    """20,000 rows in one shard: found by climbing little they are half a percent, by the production climb about a fifth."""
    x = clustered(20_000)
    recall, scored = run(x, np.arange(20_000), np.arange(0, 2000, 20), 20, share)
    assert recall >= 0.95 and scored < most


def test_recall_on_the_given_vectors_of_one_shard(spark):
    rows = spark.read.parquet("/root/testdata/check_s/embeddings.parquet").orderBy("vec_id").limit(8000).select("vec_id", F.col("embedding").cast("array<double>")).collect()
    x, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    recall, scored = run(x, ids, np.arange(0, 2000, 20), 20, ann.SHARE)
    assert recall >= 0.9 and scored < 0.3


def test_repeated_null_and_clashing(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)], 1, 2.0, "s") for i in range(30)] + [(0, [9.0, 9.0, 9.0], 1, 2.0, "s"), (None, [1.0, 1.0, 1.0], 1, 2.0, "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, score double, shard string")
    got = ann.nearest(df, F.col("id") % 20 == 0, k=3).collect()
    assert {r.query_id for r in got} == {0, 20} and all(r.vec_id != r.query_id and r.vec_id is not None for r in got)
    vec = {}
    for i, v, *_ in rows:
        vec.setdefault(i, []).append(np.array(v))
    for q in (20,):
        want = sorted(((-float(v @ vec[q][0]), i) for i, vs in vec.items() if i not in (None, q) for v in vs))[:3]
        assert [(-s, i) for s, i in want] == [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
