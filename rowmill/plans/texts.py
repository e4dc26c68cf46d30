"""Queries over documents, pages, embeddings and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog import query, read
from rowmill.operators import analytics
from rowmill.plans.summaries import rounded


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY 1")
def exact_dedup(spark, d):
    return analytics.exact_dedup(read(spark, d, "documents"), "doc_id", "text")


@query("""SELECT page_id, ((length(html)-length(replace(html,'<p>','')))/3)::INT AS p_open, ((length(html)-length(replace(html,'</p>','')))/4)::INT AS p_close, ((length(html)-length(replace(html,'<div','')))/4)::INT AS div_open, ((length(html)-length(replace(html,'</div>','')))/6)::INT AS div_close FROM pages""")
def balance_check(spark, d):
    return analytics.balance_check(read(spark, d, "pages"), "html", {"p": ("<p>", "</p>"), "div": ("<div", "</div>")}).drop("url", "html")


@query(r"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text,'[0-9]{3}') THEN 'digits' END, CASE WHEN regexp_matches(text,'[A-Z]{4}') THEN 'shout' END, CASE WHEN contains(text,'|') THEN 'table' END) AS tags,
 CASE WHEN regexp_matches(text,'[0-9]{3}') THEN 'digits' WHEN regexp_matches(text,'[A-Z]{4}') THEN 'shout' WHEN contains(text,'|') THEN 'table' END AS primary_tag FROM documents""")
def tag_patterns(spark, d):
    return analytics.tag_patterns(read(spark, d, "documents"), "text", {"digits": "[0-9]{3}", "shout": "[A-Z]{4}", "table": r"\|"}).select("doc_id", "tags", "primary_tag")


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages""")
def link_lineage(spark, d):
    return analytics.links(read(spark, d, "pages"), "page_id", "html")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000000000 AS dst FROM lineitem UNION SELECT DISTINCT l_suppkey + 1000000000000, l_partkey FROM lineitem),
k AS (SELECT min(l_partkey) AS node, 0 AS hops FROM lineitem UNION SELECT e.dst, k.hops+1 FROM k JOIN e ON e.src=k.node WHERE k.hops < 3) SELECT node, min(hops)::INT AS hops FROM k GROUP BY 1""")
def khop(spark, d):
    """Parts and suppliers within three steps of the smallest part key."""
    pairs = read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000_000).alias("dst")).distinct()
    edges = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return analytics.khop(edges, pairs.agg(F.min("src").alias("node")).dropna(), 3)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
k AS (SELECT DISTINCT l_partkey AS node, 0 AS hops FROM lineitem WHERE l_partkey % 20 = 0 UNION SELECT e.dst, k.hops+1 FROM k JOIN e ON e.src=k.node WHERE k.hops < 3) SELECT node, min(hops)::INT AS hops FROM k GROUP BY 1""")
def khop_all(spark, d):
    pairs = read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    edges = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return analytics.khop(edges, pairs.where("src % 20 = 0").select(F.col("src").alias("node")), 3)


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS q_id, b.vec_id AS b_id, list_cosine_similarity(q.e, b.embedding::DOUBLE[]) AS score FROM q JOIN embeddings b ON b.vec_id <> q.vec_id)
SELECT q_id, b_id, round(score,6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, b_id)::INT AS rank FROM s) WHERE rank <= 10""")
def knn_cosine(spark, d):
    e = read(spark, d, "embeddings")
    return rounded(analytics.knn(e.where("vec_id % 20 = 0"), e, 10, "vec_id", "embedding"), 6)


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS q_id, b.vec_id AS b_id, list_cosine_similarity(q.e, b.embedding::DOUBLE[]) AS score FROM q JOIN embeddings b ON b.vec_id <> q.vec_id)
SELECT q_id, b_id, round(score,6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, b_id)::INT AS rank FROM s) WHERE rank <= 5""")
def knn_cosine_all(spark, d):
    e = read(spark, d, "embeddings")
    return rounded(analytics.knn(e.where("vec_id % 20 = 0"), e, 5, "vec_id", "embedding"), 6)


@query("SELECT ts::DATE AS day, count(*)::BIGINT AS n, count(*) FILTER (value > 50)::BIGINT AS ok, round(100.0*count(*) FILTER (value > 50)/count(*),4) AS ok_pct, round(avg(value),6) AS mean_value FROM events GROUP BY 1")
def daily_stats(spark, d):
    g = read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("ok"), F.avg("value").alias("mean_value"))
    return g.select("day", "n", "ok", F.round(100 * F.col("ok") / F.col("n"), 4).alias("ok_pct"), F.round("mean_value", 6).alias("mean_value"))
