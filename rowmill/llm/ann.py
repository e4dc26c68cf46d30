"""Approximate nearest neighbours by a hash-prefix forest.

The rows are dealt at random to shards of about ``SHARD`` rows.  In a shard every
tree holds a sorted array of long hash strings (signs of random projections of
the centred vectors, one bit each).  A query descends each tree to the rows with
the longest common prefix, then ascends in all trees together, one bit at a
time, until the prefix groups of all trees hold ``SHARE`` times the shard's rows.
Rows found in ``FOUND`` of the trees or more are candidates and are scored exactly on the
original vectors; where these are fewer than ``LEAST`` times the neighbours asked for, the most
often found ones are (ties included).  The best k of all shards are the result.  A table of
fewer rows than that is scored whole.

Queries are a stated set; they meet every shard in blocks of ``BLOCK``, so a
task holds one shard and one block.  The centre is fitted on a sample of at most
``SAMPLE`` rows; every row is indexed.

Rows whose vector is null, all zero, has another length than most, or has null
or non-finite components take no part.  Equal vectors share all their hash
strings, so ties are never lost and are broken by the smaller id.  A repeated
id counts once for each of its rows, but never for a query of that id; null ids
take no part.  An empty table gives an empty result.  Ids are whole numbers; only
key and vector are read, so extra columns of any name are no matter; the results'
names are fixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD, BLOCK, SAMPLE = 8192, 16_384, 20_000
TREES, BITS, SHARE, FOUND, LEAST = 128, 16, 16.0, 22 / 128, 20


def hash_strings(x: np.ndarray, centre: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """trees x rows: the hash string of each row in each tree, as an integer of ``bits`` bits."""
    rng = np.random.default_rng(12)
    y = x - centre
    out = np.zeros((trees, len(x)), np.int64)
    for t in range(trees):
        signs = y @ rng.standard_normal((x.shape[1], bits)) > 0
        out[t] = signs @ (1 << np.arange(bits)[::-1])
    return out


def search(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, centre: np.ndarray, trees: int, bits: int, share: float, found_in: float, least: int, tally: list[int] | None = None):
    """(query row, id, score) of the k best candidates of each query in one shard; ``tally`` gets the number of rows scored."""
    n = len(ids)
    keys, asked = hash_strings(x, centre, trees, bits), hash_strings(q, centre, trees, bits)
    order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
    keys = np.take_along_axis(keys, order, 1)
    want = min(n * trees, share * n)
    lo, hi = np.zeros((bits + 1, trees, len(q)), np.int32), np.zeros((bits + 1, trees, len(q)), np.int32)
    for level in range(bits + 1):  # the length of the common prefix
        drop = bits - level
        for t in range(trees):
            start = asked[t] >> drop << drop
            lo[level, t], hi[level, t] = np.searchsorted(keys[t], start), np.searchsorted(keys[t], start + (1 << drop))
    enough = (hi - lo).sum(1) >= want
    level = np.where(enough.any(0), bits - enough[::-1].argmax(0), 0)
    rows, found, scores = [], [], []
    for j in range(len(q)):
        times = np.bincount(np.concatenate([order[t, a:b] for t, (a, b) in enumerate(zip(lo[level[j], :, j].tolist(), hi[level[j], :, j].tolist(), strict=True))]), minlength=n)
        times[ids == qids[j]] = -1
        few = max(found_in * trees, 1)
        if (times >= few).sum() < least * k:
            few = np.partition(times, n - least * k)[n - least * k] if n > least * k else 0
        cand = np.flatnonzero(times >= max(few, 0))
        if tally is not None:
            tally.append(len(cand))
        if not len(cand):
            continue
        near = x[cand] @ q[j]
        if len(cand) > k:
            cut = np.partition(near, len(cand) - k)[len(cand) - k]
            cand = cand[near >= cut - 1e-9 * (1 + abs(cut))]
        exact = (x[cand] * q[j]).sum(1)
        best = np.lexsort((ids[cand], -exact))[:k]
        rows.append(np.full(len(best), j))
        found.append(ids[cand[best]])
        scores.append(exact[best])
    cat = lambda p, kind: np.concatenate(p) if p else np.zeros(0, kind)
    return cat(rows, np.int64), cat(found, np.int64), cat(scores, np.float64)


def vectors(col: pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def usable(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Rows id, v (array<double>) that can take part."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def nearest(df: DataFrame, is_query, k: int = 20, key: str = "vec_id", vec: str = "embedding", trees: int = TREES, bits: int = BITS, share: float = SHARE, found_in: float = FOUND, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id and score: for each row with ``is_query`` (a condition
    over column id) the k nearest found among all other rows."""
    rows = usable(df, key, vec)
    facts = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).orderBy(F.desc("n"), "d").head()
    out = "query_id long, rank int, vec_id long, score double"
    if facts is None:
        return df.sparkSession.createDataFrame([], out)
    rows = rows.where(F.size("v") == facts.d)
    some = rows.where(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / facts.n)))
    mean = some.agg(*(F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(facts.d))).head()
    centre = np.array([x or 0.0 for x in mean])
    shards, blocks = max(1, -(-facts.n // SHARD)), max(1, -(-facts.q // BLOCK))

    data = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asks = rows.where(is_query).withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def cell(own: pa.Table, queries: pa.Table) -> pa.Table:
        ids, qids = own.column("id").to_numpy(), queries.column("id").to_numpy()
        names = ["query_id", "vec_id", "score"]
        if not len(ids) or not len(qids):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        j, found, score = search(ids, vectors(own.column("v")), qids, vectors(queries.column("v")), k, centre, trees, bits, share, found_in, least)
        return pa.table([pa.array(qids[j]), pa.array(found), pa.array(score)], names)

    got = data.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(cell, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
