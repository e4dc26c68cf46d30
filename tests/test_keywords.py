"""Keyword and hybrid search against plain cosines."""

import math
import re
from collections import Counter

import pytest

from rowmill.operators import keywords

TEXTS = {0: "rare apple the the", 1: "the rare pear", 2: "the the the", 3: "Apple, apple! pie", 4: None, 5: "", 6: "the pie"}


def cosine(a, b):
    a, b = (Counter(w for w in re.split(r"[\W\d_]+", (TEXTS[i] or "").lower()) if w) for i in (a, b))
    n = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(a[w] * b[w] for w in a) / n if n else 0.0


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id long, text string")


def test_scores_are_cosines_over_all_words(spark, docs):
    asked, index = keywords.keyword_index(docs, "id", "text", "query_id"), keywords.keyword_index(docs, "id", "text")
    pairs = spark.createDataFrame([(a, b) for a in TEXTS for b in TEXTS if a != b], "query_id long, id long")
    for r in keywords.keyword_scores(pairs, asked, index).collect():
        assert r.keyword == pytest.approx(cosine(r.query_id, r.id))
    few = keywords.keyword_index(docs, "id", "text", vocabulary=["pie"])
    assert {r.id: r.w for r in few.collect()} == {3: 1.0, 6: 1.0}


def test_common_words_find_nothing_but_count(docs):
    got = keywords.keyword_search(docs.where("id = 0"), docs, "id", "text", 5, most_rows=2).collect()
    assert [(r.id, r.keyword) for r in got] == [(3, pytest.approx(cosine(0, 3))), (1, pytest.approx(cosine(0, 1)))][:: 1 if cosine(0, 3) > cosine(0, 1) else -1]


def test_floors_and_prefetch(spark, docs):
    asked, index = keywords.keyword_index(docs, "id", "text", "query_id"), keywords.keyword_index(docs, "id", "text")
    semantic = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.44), (0, 3, 0.9), (0, 4, 0.6)], "query_id long, id long, score double")
    got = keywords.hybrid_search(semantic, asked, index, 2).collect()
    want = {i: round(0.4 * round(cosine(0, i), 10) + 0.6 * s, 8) for i, s in ((1, 0.5), (3, 0.9), (4, 0.6))}  # 2 is below the floor of meaning
    want = sorted(((h, i) for i, h in want.items() if h >= 0.4), key=lambda x: (-x[0], x[1]))[:2]
    assert [(r.hybrid, r.id) for r in got] == want
