"""Components of like sets, exactly and without the pairs of common members: sets cut into segments by hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.operators.cut import cut, drop
from rowmill.operators.matching import components

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    return (x ^ (x >> np.uint64(29))) * _MIX[2]


def _keys(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, need, key) of the sets (id, h): sets alike by ``threshold`` have as many keys in common as one of them needs, or more.

    Such sets of n and m members differ by d = (1 - t) / (1 + t) * (n + m) members at most, so cut by hash into s > d segments
    they agree in s - d of them at least.  Sizes fall into classes by the factor t, and sets that are alike into the
    same class or two neighbours: each set is cut twice, for the largest sizes of its class and the next, and of the one before and its own.
    An empty segment is a key only where s - d or more of a set's segments are empty; otherwise the set needs so many keys less."""
    share = (1 - threshold) / (1 + threshold)
    top = lambda c: np.floor(threshold ** -(c + 1.0) + 1e-9)  # noqa: E731  the largest size of a class

    def sign(batches):
        for batch in batches:
            col = batch.column("h")
            offs, flat = col.offsets.to_numpy().astype(np.int64), np.asarray(col.values, np.int64).view(np.uint64)
            ids = np.asarray(batch.column("id"))
            for lo in range(0, len(col), 512):  # sets at a time, so that memory does not grow with the batch
                hi = min(lo + 512, len(col))
                h, n = _mixed(flat[offs[lo] : offs[hi]]), np.diff(offs[lo : hi + 1])
                size_class = np.floor(np.log(n) / -np.log(threshold) + 1e-9)
                for anchor in (size_class, size_class - 1):
                    d = np.floor(share * (top(anchor) + top(anchor + 1)) + 1e-9).astype(np.int64)
                    s = d + d // 4 + 2
                    first = np.cumsum(s) - s
                    of = np.repeat(np.arange(len(n)), n)
                    at = first[of] + (h % s[of].astype(np.uint64)).astype(np.int64)
                    order = np.argsort(at, kind="stable")
                    there = np.flatnonzero(np.diff(at[order], prepend=-1))
                    total, full = np.zeros(int(s.sum()), np.uint64), np.zeros(int(s.sum()), bool)
                    total[at[order][there]] = np.add.reduceat(_mixed(h[order] * _MIX[0] + np.uint64(1)), there)
                    full[at[order][there]] = True
                    owner = np.repeat(np.arange(len(n)), s)
                    empty = np.bincount(owner[~full], minlength=len(n))
                    need = np.where(empty >= s - d, s - d, s - d - empty)
                    some = (full | (empty >= s - d)[owner]) & (d > 0)[owner]  # different sets that may not differ are no pair
                    place = (np.arange(len(owner)) - first[owner]).astype(np.uint64)
                    salt = _mixed((anchor.astype(np.int64)[owner].astype(np.uint64) << np.uint64(32)) + place + np.uint64(7))
                    key = _mixed(total + salt)[some].view(np.int64)
                    yield pa.record_batch([pa.array(ids[lo:hi][owner[some]]), pa.array(n[owner[some]]), pa.array(need[owner[some]]), pa.array(key)], ["id", "n", "need", "key"])

    return sets.select("id", "h").mapInArrow(sign, f"id {sets.schema['id'].dataType.simpleString()}, n long, need long, key long")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    end = lambda c: sets.select(F.col("id").alias(c), F.col("h").alias(f"_{c}"))
    both = pairs.join(end("src"), "src").join(end("dst"), "dst")
    shared = F.size(F.array_intersect("_src", "_dst"))
    return both.where(shared / (F.size("_src") + F.size("_dst") - shared) >= threshold).select("src", "dst")


def like_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of the different sets (id, h: hashes of the members) that are alike by at least ``threshold`` with another.

    Sets with common keys are first linked to the smallest set of a key; keys that still hold several components then
    pair those outside their largest one with the rest, so many near copies cost their number, not its square.
    Only pairs with as many common keys as like sets have are compared."""
    keys = _keys(sets, threshold)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min_by(F.struct("id", "n", "need"), "id").alias("least")).where("c > 1").select("key", "least")
    keys = cut(keys.join(shared, "key"))
    near = lambda n, m: F.least(n, m) >= threshold * F.greatest(n, m)

    def enough(pairs: DataFrame) -> DataFrame:
        """Pairs (src, dst, need: the lesser of both), one row for each common key, that have keys enough."""
        return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"), F.min("need").alias("need")).where("c >= need").select("src", "dst")

    stars = keys.where((F.col("id") != F.col("least.id")) & near("n", "least.n")).select(F.col("least.id").alias("src"), F.col("id").alias("dst"), F.least("need", "least.need").alias("need"))
    stars = cut(enough(stars))
    links = cut(_confirmed(stars, sets, threshold))
    comp = components(links)
    named = keys.drop("least").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    size = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = size.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", F.col("m.component").alias("largest"))
    open_ = cut(named.join(largest, "key"))
    left = open_.where("component <> largest").select("key", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("need").alias("needed"))
    once = (F.col("component") == F.col("largest")) | (F.col("a") < F.col("id"))  # each key brings a pair once
    across = left.join(open_, "key").where(once & near("n", "na") & (F.col("component") != F.col("ca")))
    across = enough(across.select(F.least("a", "id").alias("src"), F.greatest("a", "id").alias("dst"), F.least("need", "needed").alias("need")))
    more = cut(_confirmed(across.join(stars, ["src", "dst"], "left_anti"), sets, threshold))
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    drop(keys, open_, more, links, stars)
    return comp
