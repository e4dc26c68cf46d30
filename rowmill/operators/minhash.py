"""Near-duplicate texts by MinHash signatures in bands, confirmed on exact sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.operators.cut import cut
from rowmill.operators.matching import components

PERMUTATIONS, WIDTH = 128, 6


def word_set(text: Column) -> Column:
    """The different lower-cased words of a text, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")))


def signatures(sets: DataFrame, permutations: int = PERMUTATIONS, width: int = WIDTH) -> DataFrame:
    """(id, band, digest) of the sets (id, h: hashes of the members): for each permutation the least
    permuted hash, ``width`` of them a band."""
    rng = np.random.default_rng(128)
    a, b = (rng.integers(1, 1 << 63, permutations, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    bands = permutations // width

    def sign(batches):
        for batch in batches:
            col = batch.column("h")
            offs, flat = col.offsets.to_numpy(), np.asarray(col.values, np.int64).view(np.uint64)
            flat = (flat ^ (flat >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            least = np.empty((len(col), permutations), np.uint64)
            for lo in range(0, len(col), 256):  # sets at a time, so that memory does not grow with the batch
                hi = min(lo + 256, len(col))
                part, at = flat[offs[lo] : offs[hi]], offs[lo:hi] - offs[lo]
                for p in range(permutations):
                    least[lo:hi, p] = np.minimum.reduceat(((part * a[p] + b[p]) >> np.uint64(16)) * np.uint64(0xBF58476D1CE4E5B9), at)
            digest = np.zeros((len(col), bands), np.uint64)
            for i in range(width):
                digest = (digest ^ least[:, i : bands * width : width]) * np.uint64(0x94D049BB133111EB) + np.uint64(i + 1)
                digest ^= digest >> np.uint64(29)
            ids = np.repeat(np.asarray(batch.column("id")), bands)
            yield pa.record_batch([pa.array(ids), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(col))), pa.array(digest.ravel().view(np.int64))], ["id", "band", "digest"])

    return sets.select("id", "h").mapInArrow(sign, "id long, band int, digest long")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (src, dst) whose sets (id, h) are alike by at least ``threshold``."""
    end = lambda c: sets.select(F.col("id").alias(c), F.col("h").alias(f"_{c}"))
    both = pairs.join(end("src"), "src").join(end("dst"), "dst")
    shared, n = F.size(F.array_intersect("_src", "_dst")), F.size("_src") + F.size("_dst")
    return both.where(shared >= threshold * (n - shared)).select("src", "dst")


def _rare_first(sets: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(id, word, n) of the rarest words of each member's set: two sets alike by ``threshold`` share one of these."""
    words = cut(sets.join(members.select("id").distinct(), "id", "left_semi").select("id", F.size("h").alias("n"), F.explode("h").alias("word")))
    often = words.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    order = words.join(often, "word").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("words"))
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1
    return order.select("id", "n", F.explode(F.slice("words", F.lit(1), keep)).alias("w")).select("id", "n", F.col("w.word").alias("word"))


def _across(buckets: DataFrame, comp: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a bucket that lie in different components and share a rare word.

    In a group of one bucket and word, the members outside its largest component meet the others;
    those of the largest do not meet each other, so a group of near copies costs its size, not its square."""
    named = buckets.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = named.groupBy("band", "digest").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", "digest")
    rows = cut(named.join(open_, ["band", "digest"], "left_semi"))
    rows = cut(rows.join(_rare_first(sets, rows, threshold), "id"))
    group = ["band", "digest", "word"]
    size = rows.groupBy(*group, "component").agg(F.count(F.lit(1)).alias("c"))
    largest = size.groupBy(*group).agg(F.max(F.struct("c", "component")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select(*group, F.col("m.component").alias("largest"))
    left = rows.join(largest, group).where("component <> largest").select(*group, F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"))
    near = (F.least("n", "na") >= threshold * F.greatest("n", "na")) & (F.col("component") != F.col("ca"))
    return left.join(rows, group).where(near).select(F.least("a", "id").alias("src"), F.greatest("a", "id").alias("dst")).distinct()


def minhash_dedup(df: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """(key, component, kept): texts whose word sets are alike by at least ``threshold``; the smallest key of
    a component is kept.  Texts without words, null ones too, are alone.

    Equal sets count once.  Candidates are sets that agree in a band of ``WIDTH`` of the 128 least hashes (at 0.8,
    0.2 % of pairs agree in none); all links are confirmed on the sets.  Each bucket first links its members to
    its smallest one; only buckets that still hold several components then pair members of different
    components, by rare words, so that a bucket of any size costs about its size."""
    words = cut(df.select(F.col(key).alias("key"), F.transform(word_set(F.col(text)), lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") > 0).withColumn("set", F.sha2(F.array_join(F.transform("h", lambda x: x.cast("string")), ","), 256)))
    classes = words.groupBy("set").agg(F.min("key").alias("id"), F.first("h").alias("h"))
    sets = cut(classes.select(F.col("id").cast("long").alias("id"), "set", "h"))
    buckets = signatures(sets)
    shared = buckets.groupBy("band", "digest").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("least")).where("c > 1").select("band", "digest", "least")
    buckets = cut(buckets.join(shared, ["band", "digest"]))
    stars = buckets.where("id <> least").select(F.col("least").alias("src"), F.col("id").alias("dst")).distinct()
    links = cut(confirmed(stars, sets, threshold))
    comp = components(links)
    across = cut(_across(buckets.drop("least"), comp, sets, threshold))
    if not across.isEmpty():
        comp = components(links.unionByName(confirmed(across, sets, threshold)))
    named = sets.join(comp.withColumnRenamed("node", "id"), "id", "left").select("set", F.coalesce("component", "id").alias("component"))
    out = words.select("key", "set").join(named, "set").select(F.col("key").alias(key), "component")
    return df.select(key).join(out, key, "left").select(key, F.coalesce("component", F.col(key)).alias("component")).withColumn("kept", F.col(key) == F.col("component"))
