"""Banded MinHash against all pairs."""

import itertools
import random

from pyspark.sql import functions as F

from rowmill.operators import minhash

SCHEMA = "id long, text string"


def texts():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    out = [" ".join(word() for _ in range(rng.randrange(20, 120))) for _ in range(150)]
    for base in out[:40]:  # copies with some words changed, so that similarities lie on both sides of the limit
        w = base.split()
        for share in (0.02, 0.05, 0.08, 0.11, 0.15):
            out.append(" ".join(word() if rng.random() < share else x for x in w))
    hot = [f"h{i}" for i in range(100)]
    out += [" ".join([*hot[:i], f"own{i}", *hot[i + 1 :]]) for i in range(100)]  # a hot group of near copies, no two the same
    chain = [f"c{i}" for i in range(60)]
    out += [" ".join(chain[3 * i :] + [f"d{j}" for j in range(3 * i)]) for i in range(12)]  # linked only step by step
    return list(enumerate([*out, None, "", " \n", out[0], out[0].upper()]))


def pairs_of(rows, threshold):
    sets = {i: frozenset((t or "").lower().split()) for i, t in rows}
    alike = lambda a, b: a and b and len(a & b) >= threshold * len(a | b)
    return {(a, b) for a, b in itertools.combinations(sets, 2) if alike(sets[a], sets[b])}


def test_components_equal_all_pairs(spark):
    rows = texts()
    want = {i: i for i, _ in rows}
    links = pairs_of(rows, 0.8)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(want[a], want[b])
            changed |= (want[a], want[b]) != (low, low)
            want[a] = want[b] = low
    got = minhash.minhash_dedup(spark.createDataFrame(rows, SCHEMA), "id", "text").collect()
    assert all(r.kept == (r.id == r.component) for r in got)
    linked = {i for i in want if want[i] != i}
    found = {r.id for r in got if r.component != r.id}
    assert found <= linked and len(found) >= 0.98 * len(linked)
    assert sum(want[r.id] == r.component for r in got) >= 0.98 * len(got)


def test_recall_of_candidates_and_share_of_pairs_tested(spark):
    rows = [r for r in texts() if (r[1] or "").split()]
    sets = spark.createDataFrame(rows, SCHEMA).select("id", F.transform(minhash.word_set(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    b = minhash.signatures(sets)
    met = {(r.a, r.b) for r in b.alias("x").join(b.alias("y"), ["band", "digest"]).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().collect()}
    links = pairs_of(rows, 0.8)
    assert len(met & links) >= 0.98 * len(links)
    n = len(rows)
    assert len(met) < 0.1 * n * (n - 1) / 2


def test_empty(spark):
    assert minhash.minhash_dedup(spark.createDataFrame([], SCHEMA), "id", "text").count() == 0


def test_like_sets_equal_all_pairs(spark):
    """Sets of all sizes with copies a few words off, at and around the limit: components as over all pairs, and no
    pairs for words that all have."""
    import random

    from rowmill.operators import matching

    rng = random.Random(7)
    rows = []
    for size in [1, 2, 3, 5, 6, 7, 8, 12, 13, 20, 21, 33, 60, 111, 300]:
        for _ in range(6):
            base = [*rng.sample(range(10_000), size)]
            rows.append(base)
            for off in {0, 1, size // 13, size // 12, size // 7, size // 6}:
                rows.append([*base[off:], *range(20_000, 20_000 + rng.choice([0, off // 2, 0]))])
    rows = [r for r in rows if r]
    sets = [frozenset(r) for r in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) / len(x | sets[j]) >= 0.85:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame([(i, [str(w) for w in r]) for i, r in enumerate(rows)], "id long, t array<string>")
    got = {r.id: r.component for r in matching.dedup_jaccard(df, "id", "t", 0.85).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_like_sets_have_keys_enough(spark):
    """Sets of 40 words of which all have 36 in common."""
    from rowmill.operators import segments

    rows = [(i, [*range(36), *(100 + 10 * j + (i >> 2 * j) % 4 for j in range(4))]) for i in range(256)]
    keys = segments._keys(spark.createDataFrame([(i, [hash(w) for w in r]) for i, r in rows], "id long, h array<long>"), 0.85)
    both = keys.join(keys.withColumnsRenamed({"id": "b", "need": "needed", "n": "m"}), "key").where("id < b")
    met = both.groupBy("id", "b").agg({"need": "min", "needed": "min", "key": "count"}).where("`count(key)` >= least(`min(need)`, `min(needed)`)")
    like = sum(len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.85 for i, x in rows for j, y in rows if i < j)
    assert like <= met.count()
