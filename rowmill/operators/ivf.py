"""Approximate nearest rows by cosine through an inverted file: lists of rows by their nearest coarse centroid."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.operators.cut import cut

#: Rows of the sample that centroids are fitted on, most lists, rows of a part of a list and queries of a block.
SAMPLE, MOST_LISTS, PART, BLOCK = 20_000, 1024, 8192, 8192


@dataclass(frozen=True)
class Index:
    """``rows`` (id, v, list): every row under the list of its nearest centroid, stored; ``centroids``: lists x dimensions."""

    rows: DataFrame
    centroids: np.ndarray


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    return np.asarray(col.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def unit_rows(df: DataFrame, key: str, vec: str, name: str) -> DataFrame:
    """``name`` and v, scaled to length 1; rows with a null, empty or zero vector or non-finite components are left out."""
    v = F.transform(vec, lambda x: x.cast("double"))
    rows = df.select(F.col(key).alias(name), v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where("norm > 0")
    return rows.select(name, F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def nearest_lists(rows: DataFrame, key: str, centroids: np.ndarray, n: int) -> DataFrame:
    """Each row (key, v) once for each of its ``n`` nearest centroids, as column list."""
    kind = rows.schema[key].dataType.simpleString()

    def assign(batches):
        for b in batches:
            near = _matrix(b.column("v")) @ centroids.T
            lists = np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)
            rows_of = pa.array(np.repeat(np.arange(b.num_rows), lists.shape[1]))
            yield pa.record_batch([b.column(key).take(rows_of), b.column("v").take(rows_of), pa.array(lists.ravel())], [key, "v", "list"])

    return rows.select(key, "v").mapInArrow(assign, f"{key} {kind}, v array<double>, list int")


def build(df: DataFrame, key: str, vec: str, lists: int | None = None, seed: int = 1) -> Index:
    """The index of all rows with a usable vector.  Without ``lists`` there are about as many as the square root of
    the rows, ``MOST_LISTS`` at most.  Centroids are fitted by k-means on a sample of about ``SAMPLE`` rows; all rows are indexed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = cut(unit_rows(df, key, vec, "id"))
    n = rows.count()
    lists = max(1, min(lists or round(n**0.5), MOST_LISTS, n))
    some = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(n, 1))))
    if lists == 1:
        return Index(rows.withColumn("list", F.lit(0)), np.zeros((1, len((rows.head() or {"v": [0]})["v"]))))
    fitted = KMeans(k=lists, seed=seed, maxIter=15).fit(some.select(array_to_vector("v").alias("features"))).clusterCenters()
    centroids = np.array(fitted)
    return Index(cut(nearest_lists(rows, "id", centroids, 1)), centroids)


def search(index: Index, queries: DataFrame, key: str, vec: str, k: int, probes: int) -> DataFrame:
    """(query_id, id, score, rank): the best k by cosine among the rows of the ``probes`` lists nearest to each query,
    never the query's own id, ties to the smaller id.

    Lists are dealt into parts of ``PART`` rows and a list's queries into blocks, so a task holds one part and one
    block whatever the sizes; each returns k rows a query at most."""
    sizes = index.rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    asked = nearest_lists(unit_rows(queries, key, vec, "query_id"), "query_id", index.centroids, probes)
    blocks = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    plan = F.broadcast(cut(sizes.join(blocks, "list")))  # at most a row a list
    own = index.rows.join(plan, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asks = asked.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = ["list", "part", "block"]

    def best(base: pa.Table, questions: pa.Table) -> pa.Table:
        ids, asking = np.asarray(base.column("id")), np.asarray(questions.column("query_id"))
        out = ([], [], [])
        if len(ids) and len(asking):
            x, q = (_matrix(t.column("v").combine_chunks()) for t in (base, questions))
            for at in range(0, len(q), 256):
                near = q[at : at + 256] @ x.T
                near[asking[at : at + 256, None] == ids] = -np.inf
                for j, row in enumerate(near):
                    some = np.argpartition(-row, k)[: k + 1] if len(row) > k + 1 else np.arange(len(row))
                    some = np.flatnonzero(row >= row[some].min()) if len(row) > k + 1 else some
                    some = some[np.lexsort((ids[some], -row[some]))][:k]
                    some = some[np.isfinite(row[some])]
                    for lst, values in zip(out, (np.full(len(some), asking[at + j]), ids[some], row[some]), strict=True):
                        lst.append(values)
        cat = lambda p, t: np.concatenate(p) if p else np.zeros(0, t)
        return pa.table([pa.array(cat(out[0], np.int64)), pa.array(cat(out[1], np.int64)), pa.array(cat(out[2], np.float64))], ["query_id", "id", "score"])

    met = own.select("id", "v", *cell).groupBy(*cell).cogroup(asks.select("query_id", "v", *cell).groupBy(*cell)).applyInArrow(best, "query_id long, id long, score double")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", n).where(F.col("rank") <= k)


def share_scored(index: Index, queries: DataFrame, key: str, vec: str, probes: int) -> float:
    """The share of all pairs of query and row that a search scores."""
    sizes = index.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    asked = nearest_lists(unit_rows(queries, key, vec, "query_id"), "query_id", index.centroids, probes)
    row = asked.join(F.broadcast(sizes), "list").agg(F.sum("n").alias("scored"), F.count_distinct("query_id").alias("q")).head()
    total = sizes.agg(F.sum("n")).head()[0]
    return (row.scored or 0) / max(1, (row.q or 0) * (total or 0))
