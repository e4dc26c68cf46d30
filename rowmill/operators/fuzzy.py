"""Fuzzy matching by position-wise overlap of names, without all pairs of a block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.operators.cut import cut, drop
from rowmill.operators.matching import overlap, weighted_score

#: Rows of each side of a block that meet in one task at a time.
ROWS = 1024
#: Most marks that names meet on together, rows that tell how many, and keys of one name.
MOST, SAMPLE, MOST_KEYS = 10, 500, 10_000


def _codes(names: pa.ChunkedArray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the names, filled up with ``blank``, and lengths, -1 for null."""
    texts = names.to_pylist()
    size = np.array([-1 if x is None else len(x) for x in texts], np.int64)
    out = np.full((len(texts), max(size.max(initial=0), 0)), blank, np.int32)
    flat = np.frombuffer("".join(x or "" for x in texts).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def overlaps(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of names: the share of the longer one's positions with the same character, and whether there is none
    (a null name, or two empty ones)."""
    (x, n), (y, m) = _codes(a, -1), _codes(b, -2)
    same = np.zeros((len(n), len(m)), np.int32)
    for i in range(min(x.shape[1], y.shape[1])):
        same += x[:, i, None] == y[None, :, i]
    long = np.maximum(n[:, None], m[None, :])
    void = (n[:, None] < 0) | (m[None, :] < 0) | (long == 0)
    return same / np.maximum(long, 1), void


def match_blocks(a: DataFrame, b: DataFrame, key_a: str, name_a: str, key_b: str, name_b: str, block: list[str], others: list[tuple[float, Column]], weight: float, hi: float, lo: float) -> DataFrame:
    """As ``match_names``, for limits that keep most pairs of a block: (``key_a``, ``key_b``, overlap, the other columns, score, status) of
    the pairs with equal ``block`` columns whose score reaches ``lo``.  A null or blank overlap counts as no part of the score.

    All pairs of a block are looked at, ``ROWS`` of each side at a time, and names are compared there position by
    position as arrays; work and output grow with the pairs of the blocks, a task's memory does not."""
    total = weight + sum(w for w, _ in others)
    filled = lambda df: df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in block))
    a, b = filled(a), filled(b)
    parts = lambda df, n: df.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias(n))
    plan = parts(a, "_na").join(parts(b, "_nb"), block)
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(plan, block).withColumn("_a", part(key_a, "_na")).withColumn("_b", every("_nb")).drop("_na", "_nb")
    right = b.join(plan, block).withColumn("_b", part(key_b, "_nb")).withColumn("_a", every("_na")).drop("_na", "_nb")
    keep_a, keep_b = ([f for f in df.schema.fields if f.name not in (*block, name)] for df, name in ((a, name_a), (b, name_b)))
    names_a, names_b = [f.name for f in keep_a], [f.name for f in keep_b]

    def pairs(x: pa.Table, y: pa.Table) -> pa.Table:
        share, void = overlaps(x.column(name_a), y.column(name_b))
        i, j = np.nonzero(void | (weight * share + (total - weight) >= lo * total - 1e-9))
        cols = [*x.select(names_a).take(i).columns, *y.select(names_b).take(j).columns, pa.array(share[i, j], mask=void[i, j])]
        return pa.table(cols, [*names_a, *names_b, "overlap"])

    cell = [*block, "_a", "_b"]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*keep_a, *keep_b])
    rows = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(pairs, f"{out}, overlap double")
    rows = rows.withColumn("score", weighted_score([(weight, F.col("overlap")), *others])).where(F.col("score") >= lo)
    return rows.withColumn("status", F.when(F.col("score") >= hi, "FUZZY").otherwise("REVIEW"))


def _needed(least: float, n: Column) -> Column:
    """How many positions a name of length n must share with any partner."""
    return F.ceil(F.lit(least) * n - 1e-9).cast("int")


def _marks(df: DataFrame, key: str, name: str, block: list[str]) -> DataFrame:
    """k, n (length), blocks, mark (a position with its character): one row a position; empty names have none."""
    places = F.sequence(F.lit(1), F.length(name))
    marks = F.transform(places, lambda i: F.concat(i.cast("string"), F.lit(":"), F.substr(F.col(name), i, F.lit(1))))
    return df.where(F.length(name) > 0).select(F.col(key).alias("k"), F.length(name).alias("n"), *block, F.explode(marks).alias("mark"))


def candidate_pairs(a: DataFrame, b: DataFrame, key_a: str, name_a: str, key_b: str, name_b: str, least: float, block: list[str] | None = None) -> DataFrame:
    """(``key_a``, ``key_b``), a superset of the pairs whose names have the same character in at least the share ``least``
    of the longer one's positions (and equal ``block`` columns, if given).

    A name is the set of its positions with their characters.  With all marks in one order, rarest first, two such
    names share t marks among the first n - needed + t of each, so they meet on sets of t marks; marks that the
    other side lacks come first in that order and bring nobody.  ``_marks_together`` chooses t; names so short that they may
    share fewer also meet on pairs of marks and on single ones."""
    block = block or []
    sides = [cut(_marks(df, key, name, block)) for df, key, name in ((a, key_a, name_a), (b, key_b, name_b))]
    often = [m.groupBy("mark").agg(F.count(F.lit(1)).alias(f"often_{i}")) for i, m in enumerate(sides)]
    order = often[0].join(often[1], "mark", "full").select("mark", (F.coalesce("often_0", F.lit(0)) * F.coalesce("often_1", F.lit(0))).alias("often"))

    def ordered(marks: DataFrame) -> DataFrame:
        rows = marks.join(order, "mark").groupBy("k", "n", *block).agg(F.array_sort(F.collect_list(F.struct("often", F.xxhash64("mark").alias("mark")))).alias("m"))
        return cut(rows.withColumn("needed", _needed(least, F.col("n"))))

    rows = [ordered(m) for m in sides]
    drop(*sides)
    t = _marks_together(*rows)

    def keys(rows: DataFrame, name: str) -> DataFrame:
        able = lambda n: F.transform(F.filter(F.slice("m", F.lit(1), n), lambda x: x["often"] > 0), lambda x: x["mark"])
        none = F.array().cast("array<bigint>")
        two = F.when(F.col("needed") < t, able(F.col("n") - F.col("needed") + 2)).otherwise(none) if t > 2 else none
        one = F.when(F.col("needed") < 2, able(F.col("n"))).otherwise(none)
        rows = rows.select(F.col("k").alias(name), *block, _subsets(t)(able(F.col("n") - F.col("needed") + t), two, one).alias("_keys"))
        return rows.select(name, *block, F.explode("_keys").alias("_key"))

    return keys(rows[0], key_a).join(keys(rows[1], key_b), [*block, "_key"]).select(key_a, key_b).distinct()


def _marks_together(a: DataFrame, b: DataFrame) -> int:
    """How many marks names should share to meet: the number, of 2 to ``MOST``, with the least keys and expected pairs.

    Any number is right.  Keys are counted over all rows; pairs are expected from about ``SAMPLE`` rows of the first side, as
    if marks were independent.  A number at which a name has more than ``MOST_KEYS`` keys is not taken, but for 2."""
    free = lambda t: F.size(F.filter(F.slice("m", F.lit(1), F.col("n") - F.col("needed") + t), lambda x: x["often"] > 0)).cast("double")

    def subsets(t: int) -> Column:
        out = F.lit(1.0)
        for i in range(t):
            out = out * F.greatest(free(t) - i, F.lit(0.0)) / (i + 1)
        return out

    every = range(2, MOST + 1)
    counted = [df.agg(F.count(F.lit(1)).alias("n"), *(f(subsets(t)).alias(f"{x}{t}") for t in every for x, f in (("s", F.sum), ("m", F.max)))).head() for df in (a, b)]
    rows, others = (r.n for r in counted)
    if not rows or not others:
        return 2
    some = a.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, SAMPLE / rows)))).select("n", "needed", F.col("m.often").alias("often")).collect()
    cost = {}
    for t in every:
        expected = 0.0
        for r in some:
            ways = [1.0] + [0.0] * t  # of choosing 0 to t marks, by how likely another row has them
            for x in r.often[: r.n - r.needed + t]:
                f = (x / rows / others) ** 0.5
                for i in range(t, 0, -1):
                    ways[i] += ways[i - 1] * f
            expected += ways[t]
        if t == 2 or max(r[f"m{t}"] for r in counted) <= MOST_KEYS:
            cost[t] = sum(r[f"s{t}"] for r in counted) + expected / max(1, len(some)) * rows * others
    return min(cost, key=cost.get)


def _subsets(t: int):
    """An Arrow UDF (marks, marks, marks) -> keys: a hash of each set of t marks of the first, two of the second, one of the third."""
    from itertools import combinations
    from math import comb

    @F.arrow_udf("array<bigint>")
    def keys(some: pa.Array, two: pa.Array, one: pa.Array) -> pa.Array:
        owner, found = [], []
        for level, size_of, col in ((0, t, some), (1, 2, two), (2, 1, one)):
            flat = np.asarray(col.flatten(), np.int64).view(np.uint64)
            flat = (flat ^ (flat >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            size = np.diff(col.offsets.to_numpy()).astype(np.int64)
            first = np.cumsum(size) - size
            for n in np.unique(size[size >= size_of]):
                at = np.flatnonzero(size == n)
                sets = np.fromiter((i for c in combinations(range(n), size_of) for i in c), np.int64, comb(int(n), size_of) * size_of).reshape(-1, size_of)
                for lo in range(0, len(at), max(1, 1_000_000 // len(sets))):
                    rows = at[lo : lo + max(1, 1_000_000 // len(sets))]
                    total = np.full((len(rows), len(sets)), np.uint64(level), np.uint64)
                    for i in range(size_of):
                        total += flat[first[rows, None] + sets[None, :, i]]
                    total = (total ^ (total >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                    owner.append(np.repeat(rows, len(sets)))
                    found.append(total.ravel().view(np.int64))
        owner, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, found))
        order = np.argsort(owner, kind="stable")
        offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(some)))))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found[order]))

    return keys


def match_names(a: DataFrame, b: DataFrame, key_a: str, name_a: str, key_b: str, name_b: str, others: list[tuple[float, Column]], weight: float, hi: float, lo: float, block: list[str] | None = None) -> DataFrame:
    """All pairs whose weighted score reaches ``lo``, with overlap, score and status FUZZY (at least ``hi``) or REVIEW.

    The score is the weighted mean of the names' overlap and of ``others`` (weights and columns over both rows,
    from 0 to 1), over the parts that are not null.  What the overlap must be at least, if all others are 1, bounds the candidates;
    where that is nothing the scores alone would keep every pair, and it is an error to ask."""
    total = weight + sum(w for w, _ in others)
    least = (lo * total - (total - weight)) / weight
    if least <= 0:
        raise ValueError("with these weights and this limit no name is too different")
    pairs = candidate_pairs(a, b, key_a, name_a, key_b, name_b, least, block)
    rows = pairs.join(a, key_a).join(b.drop(*(block or [])), key_b)
    rows = rows.withColumn("overlap", overlap(F.col(name_a), F.col(name_b)))
    rows = rows.withColumn("score", weighted_score([(weight, F.col("overlap")), *others])).where(F.col("score") >= lo)
    return rows.withColumn("status", F.when(F.col("score") >= hi, "FUZZY").otherwise("REVIEW"))
