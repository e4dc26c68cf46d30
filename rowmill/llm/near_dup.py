"""Near-duplicate documents by one-permutation hashing.

A document's set is its distinct k-word shingles (64-bit hashes; A-Z lower-cased,
words ``[^\\x20\\x09-\\x0D]+``; a text of fewer words is one shingle).  The range
of the hash is cut into bins; a bin's least shingle is its value, and an empty
bin borrows the value of a full one along its own fixed random order ("optimal"
densification).  Bands of bins are bucket keys.

Texts with equal sets are one class from the start.  In each bucket the classes
form a star around one centre instead of all pairs, so a bucket of n classes
costs n - 1 candidates.  The centre is the class that meets most others over all
its buckets, which in a group of copies is the text they were made from.
Candidates are confirmed on the full sets, and components are found by label
propagation over all confirmed links.  Where a bucket still holds more than one
component, it is dealt again around its next ``STEP`` centres, and only members
outside a centre's component are candidates; rounds go on for as long as they
find links.  What then still shares a bucket with another component is finished
exactly: of two sets as near as asked, the rarest shingles of one (its prefix)
hold one of the other's, so only members with a common prefix shingle are
confirmed.  No two texts of one bucket are left untested, and the pairs grow with
the members of buckets and with what their rarest shingles share.

Hot buckets are dealt to several tasks (their centres are copied to each), and so
are the pairs of a centre of many, with copies of its text; Spark's skew join
splits what else a key of very many rows brings together, rows without texts.

Null texts and texts without words have an empty set and are linked with
nothing; texts of any length are read whole; repeated rows of one id share its
component; a row with a null id has a null component and is kept.  Ties between
centres go by hash and id.  An empty table gives an empty result.  Keys are whole
numbers; only key and text are read, so extra columns of any name are no matter;
the results' names are fixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from rowmill.llm import text as T
from rowmill.llm.stored import drop, stored

WORDS, PERCENT, STEP = 5, 80, 8
#: Bins of a text, and the share of pairs at the limit that may share no band.
BINS, MISS = 440, 2e-4
#: So many ids (8 bytes each) are sent to every executor at most; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Members of a bucket, and pairs of a centre, that go to one task.
SPREAD, PAIRS = 4096, 1024


def shingle_sets(col: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) for every text with a word."""
    for lo, view, offs in T.views(col):
        h, row = T.words(view, offs)
        win, at = T.windows(h, row, k)
        wrow = row[at]
        cut, wcut = (np.searchsorted(x, np.arange(len(offs))) for x in (row, wrow))
        for r in range(len(offs) - 1):
            if wcut[r + 1] > wcut[r]:
                yield lo + r, np.unique(win[wcut[r] : wcut[r + 1]])
            elif cut[r + 1] > cut[r]:  # fewer than k words: the whole sequence, told from others by its length
                acc = np.array([cut[r + 1] - cut[r]], np.uint64)
                for i in range(cut[r], cut[r + 1]):
                    acc = T.mix(acc * T._POW[5] + h[i : i + 1])
                yield lo + r, acc


def probes(bins: int) -> np.ndarray:
    """For each bin a fixed random order of all bins."""
    return np.argsort(T.mix(T.seeds(bins * bins, 21)).reshape(bins, bins), axis=1)


def banding(percent: int) -> tuple[int, int]:
    """(bands, width): the widest bands of BINS bins in which at most MISS of the pairs
    that are ``percent`` alike share none."""
    width = max(w for w in range(1, BINS) if w == 1 or (1 - (percent / 100) ** w) ** (BINS // w) <= MISS)
    return BINS // width, width


def band_keys(s: np.ndarray, bands: int, width: int, order: np.ndarray) -> np.ndarray:
    """One 64-bit key a band for the sorted shingle hashes ``s``."""
    bins = bands * width
    which = ((s >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
    value, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    value[which[first]] = s[first]
    full[which[first]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        near = full[order[empty, :64]]
        lend = order[empty, near.argmax(1)]
        far = np.flatnonzero(~near.any(1))
        if len(far):
            lend[far] = order[empty[far], full[order[empty[far]]].argmax(1)]
        value[empty] = T.mix(value[lend] + empty.astype(np.uint64))  # a borrowed value is told from one's own
    # bins are dealt to bands in turn, so that a band's bins lie far apart
    acc = np.arange(bands, dtype=np.uint64)
    for i in range(width):
        acc = T.mix(acc * T._POW[6] + value[i * bands : (i + 1) * bands])
    return acc


def fingerprints(docs: DataFrame, key: str, text: str, k: int, bands: int, width: int) -> DataFrame:
    """id, n (set size), s1 and s2 (128 bits of the whole set; null if empty), bands."""

    def run(batches):
        order = probes(bands * width)
        for b in batches:
            m = b.num_rows
            n, s1, s2, has, keys = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, bool), [None] * m
            for r, s in shingle_sets(b.column(1), k):
                n[r], has[r] = len(s), True
                s1[r], s2[r] = T.mix(s).sum(dtype=np.uint64).astype(np.int64), np.bitwise_xor.reduce(T.mix(s ^ T.seeds(1, 33)[0])).astype(np.int64)
                keys[r] = band_keys(s, bands, width, order).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(s1, mask=~has), pa.array(s2, mask=~has), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "s1", "s2", "bands"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, s1 long, s2 long, bands array<long>")


def parts(c: Column, size: int) -> Column:
    return F.greatest(F.ceil(c / size), F.lit(1))


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(x, y) for the rows (a, b, x, y) of the stored ``pairs`` for which the full sets of
    a and b, from ``texts`` (id, text), have 100 * intersection >= percent * union.

    Where a has very many pairs, they are dealt to copies of its text."""
    heavy = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > PAIRS).select("a", parts(F.col("m"), PAIRS).alias("copies"))
    dealt = pairs.join(heavy, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1)))).drop("copies")
    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).join(heavy, "a", "left")
    ta = ta.select("a", "ta", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("part"))
    left = dealt.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = left.join(ta, ["a", "part"])

    @F.arrow_udf("boolean")
    def near(ta: pa.Array, tb: pa.Array) -> pa.Array:
        # a centre comes with many members: each different text is read once a batch
        size = len(ta)
        ok = np.zeros(size, bool)
        names = ta.dictionary_encode()
        texts = pa.concat_arrays([names.dictionary.cast(pa.large_string()), tb.cast(pa.large_string())])
        code = names.indices.to_numpy()
        m = len(names.dictionary)
        sets: list = [None] * (m + size)
        for r, s in shingle_sets(texts, k):
            sets[r] = s
        for i in range(size):
            x, y = sets[code[i]], sets[m + i]
            if x is None or y is None or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            z = np.concatenate([x, y])
            z.sort()
            common = int((z[1:] == z[:-1]).sum())
            ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
        return pa.array(ok)

    return both.select("x", "y", near.asNondeterministic()("ta", "tb").alias("ok")).where("ok").select("x", "y")


def prefix_pairs(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, x, y): all pairs a < b of ``members`` (rep, label) with other labels x and y
    that can be as near as ``percent``, by exact prefix and position filters.

    Shingles are ordered by how many members have them.  Those of one member only come
    first in its order and meet nobody, so they are counted and not carried on."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                part = b.slice(lo, 100)
                found = list(shingle_sets(part.column(3), k))
                if not found:
                    continue
                at, sizes = np.array([r for r, _ in found]), np.array([len(s) for _, s in found])
                each = pa.array(np.repeat(at, sizes))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(each) for i in range(3)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([s for _, s in found]).view(np.int64))], ["id", "label", "t", "n", "shingle"])

    have = members.select(F.col("rep").alias("id"), "label").distinct().join(texts, "id").select("id", "label", F.xxhash64("text").alias("t"), "text")
    sets = stored(have.mapInArrow(run, "id long, label long, t long, n long, shingle long"))
    common = sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("c > 1")
    one = Window.partitionBy("id", "t")
    place = F.row_number().over(one.orderBy("c", "shingle")) + F.col("n") - F.count(F.lit(1)).over(one)
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = sets.join(common, "shingle").withColumn("place", place).where(F.col("place") <= length).where("lo <> hi").select("id", "label", "n", "shingle", "place")
    other = prefix.select(F.col("id").alias("b"), F.col("label").alias("y"), F.col("n").alias("nb"), "shingle", F.col("place").alias("pb"))
    # the first shingle that two near sets have in common lies so early in both that enough can follow
    follow = 1 + F.least(F.col("n") - F.col("place"), F.col("nb") - F.col("pb"))
    near = (F.col("id") < F.col("b")) & (F.col("label") != F.col("y")) & ((100 + percent) * follow >= percent * (F.col("n") + F.col("nb")))
    pairs = stored(prefix.join(other, "shingle").where(near).select(F.col("id").alias("a"), "b", F.col("label").alias("x"), "y").distinct())
    drop(sets)
    return pairs


def components(links: DataFrame) -> DataFrame:
    """(id, component), stored: the smallest id reachable over links (x, y), for every id with one.

    Each round, every id takes the least label among its own and its neighbours',
    then its label's label.  Labels are stored each round, so no plan grows and a
    lost executor costs one round at most."""
    edges = stored(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = stored(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("component")))
    while True:
        seen = edges.join(labels.select(F.col("id").alias("y"), "component"), "y").groupBy(F.col("x").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(seen, "id").select("id", F.least("component", "m").alias("l"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("l"), F.col("component").alias("far"))
        new = stored(step.join(jump, "l").select("id", F.least("l", "far").alias("component"), "was"))
        done = new.where("component <> was").isEmpty()
        drop(labels)
        labels = new.select("id", "component")
        labels._stored_at = new._stored_at
        if done:
            drop(edges)
            return labels


def merged(old: DataFrame | None, label: DataFrame) -> DataFrame:
    """(id, component), stored: ``old`` carried on by ``label``, whose ids are components of old or new ids."""
    if old is None:
        return label
    on = old.join(label.select(F.col("id").alias("component"), F.col("component").alias("far")), "component", "left").select("id", F.coalesce("far", "component").alias("component"))
    out = stored(on.unionByName(label.join(old.select("id"), "id", "left_anti")))
    drop(old)
    drop(label)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int | None = None, width: int | None = None, step: int = STEP) -> DataFrame:
    """key (as long), n_shingles, component_id and kept for every row of ``docs``.

    Bands and width that are not given follow from ``percent``."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must hold whole numbers")
    own = banding(percent)
    bands, width = bands or own[0], width or own[1]
    prints = stored(fingerprints(docs, key, text, words, bands, width))
    sets = prints.where("s1 is not null and id is not null").groupBy("s1", "s2")
    classes = sets.agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    keys = classes.select("rep", "n", F.posexplode("bands").alias("band", "hash"))
    full = keys.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    found = stored(keys.join(full, ["band", "hash"]))
    meets = found.groupBy("rep").agg(F.sum("c").alias("meets"))
    part = F.pmod(F.xxhash64("rep"), parts(F.col("c"), SPREAD))
    members = stored(found.join(meets, "rep").withColumn("label", F.col("rep")).withColumn("part", part))
    drop(found)
    every = F.explode(F.sequence(F.lit(0).cast("long"), parts(F.col("c"), SPREAD) - 1)).alias("part")
    ids = members.select(F.col("rep").alias("id")).distinct()
    small = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = stored(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(small, "id", "left_semi").distinct())

    known: DataFrame | None = None
    had, centres = 0, 1
    while not members.isEmpty():
        rank = F.row_number().over(Window.partitionBy("band", "hash").orderBy(F.desc("meets"), F.xxhash64("rep"), "rep"))
        centre = members.withColumn("rank", rank).where(F.col("rank") <= centres).where(F.col("rank") > had).select("band", "hash", every, F.col("rep").alias("o"), F.col("n").alias("on"), F.col("label").alias("ol"))
        pairs = members.join(centre, ["band", "hash", "part"]).where((F.col("label") != F.col("ol")) & (100 * F.least("n", "on") >= percent * F.greatest("n", "on")))
        # a pair that meets in several buckets, or whose ends are both centres, is tested once
        first = F.col("rep") < F.col("o")
        pairs = pairs.groupBy(F.least("rep", "o").alias("lo"), F.greatest("rep", "o").alias("hi"), F.when(first, F.col("label")).otherwise(F.col("ol")).alias("x"), F.when(first, F.col("ol")).otherwise(F.col("label")).alias("y")).agg(F.min("o").alias("a"))
        pairs = stored(pairs.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"), "x", "y"))
        links = stored(confirm(pairs, texts, words, percent))
        drop(pairs)
        last = links.isEmpty()
        if last:
            drop(links)
            pairs = prefix_pairs(members, texts, words, percent)
            links = stored(confirm(pairs, texts, words, percent))
            drop(pairs)
            if links.isEmpty():
                drop(links)
                break
        label = components(links.select("x", "y").distinct())
        drop(links)
        if last:
            known = merged(known, label)
            break
        now = members.join(label, members.label == label.id, "left").withColumn("label", F.coalesce("component", "label")).drop("id", "component")
        # buckets of one component, and those whose members have all been centres, are done
        left = now.groupBy("band", "hash").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m"), F.first("c").alias("c")).where((F.col("lo") != F.col("hi")) & (F.col("m") > centres)).select("band", "hash", every)
        after = stored(now.join(left, ["band", "hash", "part"]))
        drop(members)
        known = merged(known, label)
        members, had, centres = after, centres, centres + step
    drop(members)
    drop(texts)

    joined = sets.agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("c"))
    if known is not None:
        joined = joined.join(known.withColumnRenamed("component", "far"), joined.component == known.id, "left").select("s1", "s2", "c", F.coalesce("far", "component").alias("component"))
    joined = stored(joined)
    # classes of very many copies are few: they are sent to the rows, which are not brought together
    hot, cold = (joined.where(x).drop("c") for x in (F.col("c") > PAIRS, F.col("c") <= PAIRS))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
    rows = prints.select("id", "n", "s1", "s2")
    full = rows.where("s1 is not null")
    out = full.join(hot, ["s1", "s2"]).unionByName(full.join(hot, ["s1", "s2"], "left_anti").join(cold, ["s1", "s2"], "left")).unionByName(rows.where("s1 is null").withColumn("component", F.lit(None).cast("long")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
