"""Awkward inputs: extra columns with clashing names, very long texts, ties, repeated rows, empty tables."""

import pytest
from pyspark.sql import functions as F

from rowmill.llm import language, near_dup, packing, quality_model, quality_rules, queries, text, toxicity, url_filter
from rowmill.llm.queries import URL_RULES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "plain words about rivers and old bridges " * 40_000  # above text.CHUNK
CLASH = ["id", "n", "score", "shard", "bands", "row", "sha", "w", "h", "key", "size", "label", "y", "fold", "part"]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > text.CHUNK
    rows = [(i, f"some text {i % 7} about bridges and rivers " * (1 + i % 5), ["en", "de"][i % 2], "a", 1) for i in range(60)]
    return spark.createDataFrame([*rows, (100, LONG, "en", "a", 1), (101, None, None, None, None), (102, "", "en", "b", 0), rows[3], rows[3]], SCHEMA)


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_extra_columns_change_nothing(docs):
    wide = clashing(docs)
    cols = ["doc_id", "n_words", "base_failed", "kept"]
    same(quality_rules.quality_verdicts(docs).select(cols), quality_rules.quality_verdicts(wide).select(cols))
    same(near_dup.near_duplicates(docs, words=3, percent=85), near_dup.near_duplicates(wide, words=3, percent=85))
    keep = ["doc_id", "start", "length", "doc_tokens"]
    one, two = (packing.packed(d, tokenizer_path()).select(keep) for d in (docs, wide))
    assert one.groupBy("doc_id").agg(F.sum("length").alias("n")).orderBy("doc_id", "n").collect() == two.groupBy("doc_id").agg(F.sum("length").alias("n")).orderBy("doc_id", "n").collect()


def test_a_very_long_text_is_read_whole(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    for out in (quality_model.quality_scores(docs, labels), language.languages(docs), toxicity.toxic_passages(docs, toxicity.fit(docs, labels))):
        rows = out.where("doc_id = 100").collect()
        assert len(rows) == 1 and 0 <= rows[0].score <= 1
        assert out.count() == docs.count()
    sets = {r.doc_id: r.n_shingles for r in near_dup.near_duplicates(docs, words=3, percent=85).collect()}
    w = LONG.split()
    assert sets[100] == len({tuple(w[i : i + 3]) for i in range(len(w) - 2)})


def test_toxicity_predicts_one_at_one_half_or_more(docs, spark):
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxic_passages(docs, toxicity.fit(docs, labels)).collect()
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_repeated_urls_get_one_verdict(spark):
    rows = [(i, f"http://h{i % 5}.org/a") for i in range(40)] + [(3, "http://h3.org/a")] * 3
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()
    assert len(got) == 43 and len({(r.host, r.verdict, r.score) for r in got if r.page_id % 5 == 3}) == 1


def test_registered_queries_on_empty_tables(spark, tmp_path):
    for t in ("documents", "embeddings", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("op9_packing", "op10_neighbours", "op11_exact_dedup", "op12_vector_codes", "op13_conversation_trie"):
        assert queries()[name](spark, str(tmp_path)).count() == 0
