"""Exact duplicates against a plain grouping, with nulls, empties, ties, repeats and clashing names."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rowmill.llm import exact_dedup

SCHEMA = "doc_id long, text string, sha string, row int, again boolean, group_size int, _row int"


def rows():
    texts = [None, "", " ", "a", "a ", "A", "é", "é", "x" * 300_000, "x" * 300_000]
    out = [(i, t, "z", 1, None, 2, 3) for i, t in enumerate(texts)]
    out += [(100 + i, "same", None, i, True, 1, i) for i in range(900)]  # a third of all rows and more
    out += [(5000 + i, f"alone {i}", None, 0, False, 1, 0) for i in range(600)]
    out += [(5000 + i, f"alone {i * 2}", None, 0, False, 1, 0) for i in range(300)]
    return [*out, out[3], out[3], (None, "a", None, 0, None, 0, 0), (None, "only null", None, 0, None, 0, 0), (None, "only null", None, 0, None, 0, 0)]


def want(data):
    groups = defaultdict(list)
    for r in data:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        top, sha = max(known, default=None), hashlib.sha256(text.encode()).hexdigest()
        order = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        out += [(i, top, len(ids), at == 0, sha) for at, i in enumerate(order)]
    return sorted(out, key=str)


@pytest.mark.parametrize("max_bits", [exact_dedup.MAX_BITS, 10_000])
def test_groups_equal_a_plain_grouping(spark, max_bits):
    data = rows()
    got = exact_dedup.exact_groups(spark.createDataFrame(data, SCHEMA).repartition(5), max_bits=max_bits)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want(data)


def test_rows_that_stay_keep_all_their_columns(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = exact_dedup.deduplicated(df)
    assert got.columns == df.columns
    kept = sorted((str((r[0], r[1] or "")) for r in got.collect()))
    texts = {r[1] or "" for r in data}
    assert len(kept) == len(texts)
    assert kept == sorted(str((top, t)) for t, top in ((t, max((r[0] for r in data if (r[1] or "") == t and r[0] is not None), default=None)) for t in texts))


def test_first_pass_lets_most_lone_rows_pass(spark):
    """The share of rows without a copy that are shuffled is that of the formula, 1 - exp(-1/8) squared."""
    df = spark.range(40_000).select(exact_dedup.digest(F.col("id").cast("string")).alias("sha"))
    share = exact_dedup._tested(df, 40_000, exact_dedup.MAX_BITS).where("again").count() / 40_000
    assert 0.008 < share < 0.02


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.deduplicated(none).count() == 0
