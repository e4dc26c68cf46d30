"""Product codes against plain k-means in whole numbers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from rowmill.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, id long, codes string, n int"


def plain(data, d):
    rows = [r for r in data if r[1] is not None and len(r[1]) == d and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] for r in rows]
    w = d // 4
    order = sorted((r[0], v) for r, v in zip(rows, ints, strict=True) if r[0] is not None)[:256]
    books = [[v[p * w : p * w + w] for _, v in order] for p in range(4)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v, p: min((dist(v[p * w : p * w + w], e), i) for i, e in enumerate(books[p]))
    for step in range(5):
        near = [[pick(v, p) for p in range(4)] for v in ints]
        if step == 4:
            break
        for p in range(4):
            of = defaultdict(list)
            for v, n in zip(ints, near, strict=True):
                of[n[p][1]].append(v[p * w : p * w + w])
            for i, got in of.items():
                books[p][i] = [sum(c) // len(got) for c in zip(*got, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = defaultdict(int)
    for r, n in zip(rows, near, strict=True):
        total[r[2]] += sum(e for e, _ in n)
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in n), sum(e for e, _ in n), total[r[2]], sha) for r, n in zip(rows, near, strict=True)), key=str)


def table(n, d, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i * 3, [float(x) for x in rng.standard_normal(d) * spread], [None, 1, 1, 2][i % 4], 1, "c", 0) for i in range(n)]


@pytest.mark.parametrize(("n", "d", "spread"), [(700, 16, 0.2), (90, 8, 1.0), (400, 8, 0.004), (300, 8, 3000.0)])
def test_codes_equal_plain_k_means(spark, n, d, spread):
    """Also with many ties (tiny spread), with values beyond a double's products, and fewer rows than entries."""
    data = table(n, d, n, spread)
    data += [data[5], data[5], (None, data[7][1], None, 1, "c", 0), (9001, None, 1, 1, "c", 0), (9002, [float("nan")] * d, 1, 1, "c", 0)]
    data += [(9003, [None] * d, 1, 1, "c", 0), (9004, [float("inf")] * d, 1, 1, "c", 0), (9005, [1.0], 1, 1, "c", 0), (9006, [0.0] * d, 5, 1, "c", 0)]
    got = codebooks.compressed(spark.createDataFrame(data, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(data, d)


def test_empty_and_odd_lengths(spark):
    assert codebooks.compressed(spark.createDataFrame([], SCHEMA)).count() == 0
    got = codebooks.compressed(spark.createDataFrame([(i, [1.0, 2.0, float(i)], None, 1, "c", 0) for i in range(5)], SCHEMA)).collect()
    assert [r.error for r in got] == [0] * 5
    got = codebooks.compressed(spark.createDataFrame([(None, [1.0] * 4, None, 1, "c", 0)], SCHEMA)).collect()
    assert [(r.code, r.error) for r in got] == [("00000000", 0)]


def test_balls_measure_few_entries_where_parts_are_clustered():
    rng = np.random.default_rng(3)
    centres = rng.integers(-5000, 5000, (256, 16))
    x = centres[rng.integers(0, 256, 20_000)] + rng.integers(-40, 40, (20_000, 16))
    code, error = codebooks.nearest_of_all(x, centres)
    again, same, measured = codebooks.nearest_by_balls(x, code, centres)
    assert (again == code).all() and (same == error).all()
    assert measured < 1.1 * len(x)  # nearly all are in the stable core
    wrong = rng.integers(0, 256, len(x))
    again, same, _ = codebooks.nearest_by_balls(x, wrong, centres)
    assert (again == code).all() and (same == error).all()


def test_decoded_vectors_are_near(spark):
    data = table(600, 16, 1, 0.2)
    coded, books = codebooks.fit(spark.createDataFrame(data, SCHEMA))
    back = {r.id: np.array(r.approx) for r in codebooks.decoded(coded, books).collect()}
    gap = [np.square(back[r[0]] - np.array(r[1])).sum() / np.square(r[1]).sum() for r in data]
    assert np.mean(gap) < 0.3
