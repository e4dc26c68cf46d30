"""Soft clusters of vectors and trees of them: principal components, Gaussian mixtures, and the number of parts by an information criterion."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.operators.cut import cut

#: Most principal components; most parts of a mixture; rounds of a fit; a change of the criterion or likelihood by less stops.
COMPONENTS, MOST_PARTS, ROUNDS, LEAST_CHANGE = 8, 256, 12, 0.01
RIDGE = 1e-5


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    criterion: float

    @property
    def parts(self) -> int:
        return len(self.weights)


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    return np.asarray(col.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _log_shares(x: np.ndarray, m: Mixture) -> np.ndarray:
    """Log of weight times density, rows x parts."""
    out = np.empty((len(x), m.parts))
    for k in range(m.parts):
        low = np.linalg.cholesky(m.covariances[k])
        z = np.linalg.solve(low, (x - m.means[k]).T)
        out[:, k] = math.log(max(m.weights[k], 1e-300)) - 0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
    return out


def _shares(x: np.ndarray, m: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """Each row's probabilities of the parts, and the log of its density."""
    logs = _log_shares(x, m)
    top = logs.max(1, keepdims=True, initial=-np.inf)
    total = np.exp(logs - top).sum(1, keepdims=True)
    return np.exp(logs - top) / total, (top + np.log(total)).ravel()


def principal(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(node, x): the vectors v by their principal components, or as they are where these are no fewer."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    row = rows.agg(F.max(F.size("v"))).head()
    if row[0] is None or row[0] <= components:
        return cut(rows.select("node", F.col("v").alias("x")))
    at = rows.select("node", array_to_vector("v").alias("f"))
    return cut(PCA(k=components, inputCol="f", outputCol="p").fit(at).transform(at).select("node", vector_to_array("p").alias("x")))


def _step(rows: DataFrame, m: Mixture) -> tuple[Mixture, float]:
    """One round of expectation and maximisation: sums in every task, added up by Spark; and the log likelihood."""
    k, d = m.means.shape

    def sums(batches):
        total = np.zeros(k * (1 + d + d * d) + 1)
        for b in batches:
            x = _matrix(b.column("x"))
            if len(x):
                p, like = _shares(x, m)
                xx = np.einsum("nk,ni,nj->kij", p, x, x)
                total += np.concatenate([p.sum(0), (p.T @ x).ravel(), xx.ravel(), [like.sum()]])
        yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "s"])

    got = rows.select("x").mapInArrow(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(k * (1 + d + d * d) + 1)
    for r in got:
        total[r.i] = r.s
    n, s, ss = total[:k], total[k : k + k * d].reshape(k, d), total[k + k * d : -1].reshape(k, d, d)
    held = np.maximum(n, 1e-12)
    means = np.where(n[:, None] > 1e-9, s / held[:, None], m.means)
    cov = ss / held[:, None, None] - np.einsum("ki,kj->kij", means, means)
    cov = np.where(n[:, None, None] > 1e-9, cov, m.covariances)
    cov = (cov + cov.transpose(0, 2, 1)) / 2
    scale = max(float(np.trace(cov.mean(0))) / d, 1e-9)
    for i in range(k):  # a part of few or equal rows keeps a positive spread
        low = np.linalg.eigvalsh(cov[i])[0]
        cov[i] += np.eye(d) * (RIDGE * scale + max(0.0, -low))
    return Mixture(n / n.sum(), means, cov, math.nan), float(total[-1])


def fit(rows: DataFrame, n: int, k: int, seed: int = 1) -> Mixture:
    """A mixture of ``k`` parts over rows (x), begun from k-means; its criterion is the Bayesian one (less is better)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    whole = rows.agg(F.array(*(F.struct(F.avg(c), F.coalesce(F.var_pop(c), F.lit(0.0))) for c in (F.col("x")[i] for i in range(len(rows.head().x)))))).head()[0]
    mean, spread = np.array([r[0] for r in whole]), np.array([r[1] for r in whole])
    centres = [mean]
    if k > 1:
        centres = KMeans(k=k, seed=seed, maxIter=10).fit(rows.select(array_to_vector("x").alias("features"))).clusterCenters()
    k, d = len(centres), len(mean)
    m = Mixture(np.full(k, 1 / k), np.array(centres), np.stack([np.diag(spread / k ** (2 / d) + RIDGE * max(spread.mean(), 1e-9))] * k), math.nan)
    before = -math.inf
    for _ in range(ROUNDS if k > 1 else 2):
        new, like = _step(rows, m)
        done = abs(like - before) < 1e-3 * abs(like)
        if done:
            break
        m, before = new, like
    free = k - 1 + k * d + k * d * (d + 1) / 2
    return Mixture(m.weights, m.means, m.covariances, free * math.log(n) - 2 * like)


def choose(rows: DataFrame, n: int, most: int | None = None, seed: int = 1) -> Mixture:
    """The mixture with the least criterion: the number of parts doubles while the criterion falls by ``LEAST_CHANGE`` of its
    size, up to the square root of the rows, and is then searched between half and double of the best."""
    most = max(1, min(most or MOST_PARTS, int(n**0.5)))
    tried = {1: fit(rows, n, 1, seed)}

    def try_(k: int) -> Mixture:
        if k not in tried:
            tried[k] = fit(rows, n, k, seed)
        return tried[k]

    best, k = tried[1], 2
    while k <= most:
        new = try_(k)
        gain = best.criterion - new.criterion
        if gain > 0:
            best = new
        if gain < LEAST_CHANGE * abs(best.criterion):
            break
        k *= 2
    at = max((k for k in tried if tried[k] is best), default=1)
    step = max(at // 2, 1) if at > 1 else 0
    while step >= 1:
        for k in (at - step, at + step):
            if 1 < k <= most and try_(k).criterion < best.criterion:
                best, at = tried[k], k
        step //= 2
    return best


def assigned(rows: DataFrame, m: Mixture, least: float = 0.72) -> DataFrame:
    """(node, cluster, p): the parts that have a row (node, x) with probability ``least`` or more, else the likeliest, ties to the first."""
    kind = rows.schema["node"].dataType.simpleString()

    def part(batches):
        for b in batches:
            p, _ = _shares(_matrix(b.column("x")), m)
            sure = p >= least
            none = ~sure.any(1)
            sure[none, p[none].argmax(1)] = True
            row, cluster = np.nonzero(sure)
            yield pa.record_batch([b.column("node").take(pa.array(row)), pa.array(cluster.astype(np.int32)), pa.array(p[row, cluster])], ["node", "cluster", "p"])

    return rows.select("node", "x").mapInArrow(part, f"node {kind}, cluster int, p double")


def _vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    v = F.transform(vec, lambda x: x.cast("double"))
    return df.select(F.col(key).alias("node"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def soft_clusters(df: DataFrame, key: str, vec: str, most: int | None = None, least: float = 0.72, seed: int = 1) -> DataFrame:
    """(key, cluster, p) of the mixture that the criterion chooses; rows without a usable vector are left out."""
    rows = principal(_vectors(df, key, vec))
    n = rows.count()
    if n == 0:
        return df.select(F.col(key), F.lit(0).alias("cluster"), F.lit(1.0).alias("p")).limit(0)
    return assigned(rows, choose(rows, n, most, seed), least).withColumnRenamed("node", key)


def cluster_tree(df: DataFrame, key: str, vec: str, depth: int = 5, few: int = 8, seed: int = 1) -> DataFrame:
    """(level, node, parent, p): rows (level 0) under soft clusters, clusters under clusters of their centres, up to one root.

    A level is the last below the root where the criterion finds no better mixture than one part, where
    it has ``few`` nodes or less, or at ``depth``.  Nodes above the rows are numbered from 0 in each level.  A tree
    of no usable rows is empty; the driver sees only mixtures, never rows."""
    rows = cut(_vectors(df, key, vec).withColumn("node", F.col("node").cast("long")))
    n, level, out = rows.count(), 0, None
    while n:
        x = principal(rows)
        m = choose(x, n, seed=seed) if n > few and level < depth - 1 else None
        if m is None or m.parts == 1:
            last = rows.select(F.lit(level).alias("level"), "node", F.lit(0).cast("long").alias("parent"), F.lit(1.0).alias("p"))
            return last if out is None else out.unionByName(last)
        got = assigned(x, m)
        first = F.row_number().over(Window.orderBy("cluster")) - 1  # of at most MOST_PARTS clusters
        named = got.groupBy("cluster").agg(F.count(F.lit(1)).alias("c")).withColumn("parent", first.cast("long")).drop("c")
        linked = cut(got.join(F.broadcast(named), "cluster").select(F.lit(level).alias("level"), "node", "parent", "p"))
        out = linked if out is None else out.unionByName(linked)
        d = len(rows.head().v)
        rows = cut(rows.join(linked, "node").groupBy(F.col("parent").alias("node")).agg(F.array(*(F.avg(F.col("v")[i]) for i in range(d))).alias("v")))
        n, level = rows.count(), level + 1
    return rows.select(F.lit(0).alias("level"), "node", F.col("node").alias("parent"), F.lit(1.0).alias("p"))
