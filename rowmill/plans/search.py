"""Retrieval over embeddings and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog import query, read
from rowmill.operators import analytics, hierarchy, ivf, keywords, minhash, models, nearest, search
from rowmill.plans.summaries import rounded

COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
SCORED = f"""s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS label, round({COS}, 10) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


def _nearest(spark, d, k, group="label"):
    """The best k rows of each query, of its own label or of all, by scores of ten places."""
    e = read(spark, d, "embeddings")
    near = nearest.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", k, group=group, tie=1.5e-10)
    return search.top(near.withColumn("score", F.round("score", 10)), "query_id", "score", "id", k)


@query(f"WITH {SCORED} SELECT query_id, id, round(score, 8) AS score, rank::INT AS rank FROM r WHERE rank <= 5")
def knn_filtered(spark, d):
    """Nearest rows of the query's own label: the filter comes before ranking."""
    return rounded(_nearest(spark, d, 5), 8)


@query(f"WITH {SCORED} SELECT query_id, id, rank::INT AS rank FROM r WHERE rank <= CASE label % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 8 END")
def adaptive_k(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.when(F.col("label") % 3 == 0, 3).when(F.col("label") % 3 == 1, 5).otherwise(8).alias("k"))
    return _nearest(spark, d, 8).join(e, "query_id").where("rank <= k").select("query_id", "id", "rank")


VOCABULARY = ["the", "and", "of", "to", "in"]


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda v: v IN ('the','and','of','to','in')) AS ws FROM documents), c AS (SELECT doc_id, [len(list_filter(ws, lambda v: v = 'the')), len(list_filter(ws, lambda v: v = 'and')), len(list_filter(ws, lambda v: v = 'of')), len(list_filter(ws, lambda v: v = 'to')), len(list_filter(ws, lambda v: v = 'in'))]::DOUBLE[] AS k FROM w),
n AS (SELECT doc_id, k, sqrt(list_dot_product(k, k)) AS z FROM c) SELECT doc_id, round(CASE WHEN z > 0 THEN k[1] / z ELSE 0 END, 8) AS k0, round(CASE WHEN z > 0 THEN k[2] / z ELSE 0 END, 8) AS k1, round(CASE WHEN z > 0 THEN k[5] / z ELSE 0 END, 8) AS k4 FROM n""")
def keyword_vectors(spark, d):
    v = read(spark, d, "documents").select("doc_id", search.keyword_vector(F.col("text"), VOCABULARY).alias("v"))
    return v.select("doc_id", *(F.round(F.col("v")[i], 8).alias(f"k{i}") for i in (0, 1, 4)))


#: Words of the documents that have an embedding, by their share of the vector of counts.
WORDS = r"""c AS (SELECT doc_id AS id, word, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) WHERE word <> '' GROUP BY 1, 2),
x AS MATERIALIZED (SELECT id, word, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM c)"""


def _texts(spark, d):
    e = read(spark, d, "embeddings").select("vec_id")
    return read(spark, d, "documents").join(e, F.col("doc_id") == F.col("vec_id"), "left_semi").select("doc_id", "text")


@query(f"""WITH {SCORED}, {WORDS}, h AS (SELECT query_id, id, score FROM r WHERE rank <= 15 AND score >= 0.1),
k AS (SELECT h.*, round(coalesce((SELECT sum(a.w * b.w) FROM x a JOIN x b USING (word) WHERE a.id = h.query_id AND b.id = h.id), 0), 10) AS keyword FROM h),
y AS (SELECT *, round(0.4 * keyword + 0.6 * score, 8) AS hybrid FROM k WHERE 0.4 * keyword + 0.6 * score >= 0.15), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, id) AS rank FROM y)
SELECT query_id, id, round(keyword, 8)::DOUBLE AS keyword, hybrid::DOUBLE AS hybrid, rank::INT AS rank FROM z WHERE rank <= 5""")
def hybrid_search(spark, d):
    """Prefetch of 3k by meaning, then the words of the texts and meaning together, floors before the final rank."""
    t = _texts(spark, d)
    asked, index = keywords.keyword_index(t.where("doc_id % 20 = 0"), "doc_id", "text", "query_id"), keywords.keyword_index(t, "doc_id", "text")
    out = keywords.hybrid_search(_nearest(spark, d, 15), asked, index, 5, 0.1, 0.15)
    return out.select("query_id", "id", F.round("keyword", 8).alias("keyword"), "hybrid", "rank")


@query(f"""WITH {WORDS}, f AS (SELECT word FROM x GROUP BY 1 HAVING count(*) <= 20),
p AS (SELECT DISTINCT a.id AS query_id, b.id FROM x a JOIN x b USING (word) JOIN f USING (word) WHERE a.id % 20 = 0 AND a.id <> b.id),
s AS (SELECT p.query_id, p.id, round(sum(a.w * b.w), 10) AS keyword FROM p JOIN x a ON a.id = p.query_id JOIN x b ON b.id = p.id AND b.word = a.word GROUP BY 1, 2),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword DESC, id) AS rank FROM s) SELECT query_id, id, round(keyword, 8)::DOUBLE AS keyword, rank::INT AS rank FROM z WHERE rank <= 5""")
def keyword_search(spark, d):
    """Nearest texts by their words, found through words that 20 texts or less have."""
    t = _texts(spark, d)
    out = keywords.keyword_search(t.where("doc_id % 20 = 0"), t, "doc_id", "text", 5, 20)
    return out.select("query_id", "id", F.round("keyword", 8).alias("keyword"), "rank")


@query(f"""WITH {SCORED}, t AS (SELECT query_id, label, (SELECT min(id) FROM s x WHERE x.query_id = q.query_id) AS id FROM (SELECT DISTINCT query_id, label FROM s) q), f AS (SELECT t.label, min(r.rank) AS r FROM t LEFT JOIN (SELECT * FROM r WHERE rank <= 10) r USING (query_id, id) GROUP BY t.label, t.query_id)
SELECT label, count(*)::BIGINT AS n_queries, round(avg(coalesce((r <= 5)::INT, 0)), 6) AS hit_at_k, round(avg(coalesce(1 / r, 0)), 6) AS mrr FROM f GROUP BY 1""")
def retrieval_eval(spark, d):
    e = read(spark, d, "embeddings")
    truth = search.first_other(e.where("vec_id % 20 = 0"), e, "label", "vec_id")
    return rounded(search.retrieval_eval(_nearest(spark, d, 10), truth, "query_id", "id", "label", 5), 6)


@query("""WITH x AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id) AS n FROM documents) SELECT doc_id, lang, source FROM x WHERE n <= 3""")
def stratified_sample(spark, d):
    return search.stratified_sample(read(spark, d, "documents"), ["lang", "source"], "doc_id", 3, 7).select("doc_id", "lang", "source")


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR || ':3'), 1, 6))::BIGINT % 100 < 80 THEN 'TRAIN' ELSE 'VALID' END AS part FROM documents")
def train_valid_split(spark, d):
    return search.hash_split(read(spark, d, "documents"), "doc_id", 80, 3).select("doc_id", "part")


@query("""WITH a AS (SELECT DISTINCT conv_id, first_value(text) OVER w AS rejected, last_value(text) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS chosen FROM conversations WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)) SELECT conv_id, md5(rejected) AS rejected, md5(chosen) AS chosen FROM a WHERE rejected <> chosen""")
def preference_pairs(spark, d):
    c = read(spark, d, "conversations").where("role = 'assistant'")
    order = F.struct("turn", "text")
    pick = lambda f: c.groupBy("conv_id").agg(f("text", order).alias("text"))
    p = search.preference_pairs(pick(F.min_by), pick(F.max_by), "conv_id", "text")
    return p.select("conv_id", F.md5("rejected").alias("rejected"), F.md5("chosen").alias("chosen"))


@query("""WITH e AS (SELECT vec_id AS k, label AS l, label % 3 AS g, md5(vec_id::VARCHAR) AS h FROM embeddings), p AS (SELECT *, ('0x' || substr(h, 31, 2))::INT % 64 AS part FROM e),
x AS (SELECT k AS a, unnest([lead(k, 1) OVER w, lead(k, 2) OVER w]) AS b, 1.0 AS score FROM p WINDOW w AS (PARTITION BY l ORDER BY h, k)),
y AS (SELECT k AS a, unnest([lead({'k': k, 'l': l}, 1) OVER w, lead({'k': k, 'l': l}, 2) OVER w]) AS b, l FROM p WINDOW w AS (PARTITION BY g ORDER BY h, k)),
z AS (SELECT k AS a, unnest([lead({'k': k, 'g': g}, 1) OVER w, lead({'k': k, 'g': g}, 2) OVER w]) AS b, g FROM p WINDOW w AS (PARTITION BY part ORDER BY h, k)),
c AS (SELECT a, b.k AS b, 0.0 AS score FROM z WHERE b IS NOT NULL AND g <> b.g)
SELECT a, b, score::DOUBLE AS score FROM (SELECT * FROM x WHERE b IS NOT NULL UNION ALL SELECT a, b.k, 0.5 FROM y WHERE b IS NOT NULL AND l <> b.l UNION ALL (SELECT * FROM c ORDER BY md5(concat_ws(':', a, b)), a, b LIMIT 150) UNION ALL SELECT vec_id, vec_id, 0.8 FROM embeddings SEMI JOIN documents ON vec_id = doc_id)""")
def contrastive_pairs(spark, d):
    """Embeddings by label and group; a row's own counterpart is the document of its id, and pairs of score 0 are capped."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("own"))
    e = read(spark, d, "embeddings").withColumn("broad", F.col("label") % 3).join(docs, "vec_id", "left")
    return search.contrastive_pairs(e, "vec_id", "label", "broad", partner="own", most={0.0: 150})


@query(f"""WITH {SCORED}, f0 AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label, round({COS}, 10) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f0), t AS (SELECT query_id, label, id FROM r WHERE rank = 1),
p AS (SELECT t.label, t.query_id, max(r.rank) FILTER (r.rank <= 10) AS ra, max(f.rank) FILTER (f.rank <= 10) AS rb FROM t LEFT JOIN r USING (query_id, id) LEFT JOIN f USING (query_id, id) GROUP BY 1, 2),
e AS (SELECT label, count(*) AS n, avg(coalesce((ra <= 5)::INT, 0)) AS ha, avg(coalesce(1 / ra, 0)) AS ma, avg(coalesce((rb <= 5)::INT, 0)) AS hb, avg(coalesce(1 / rb, 0)) AS mb FROM p GROUP BY ROLLUP (label))
SELECT label, n AS n_queries, round(ha, 6)::DOUBLE AS hit_0, round(hb, 6)::DOUBLE AS hit_1, round(ha - hb, 6)::DOUBLE AS hit_gain, round(ma - mb, 6)::DOUBLE AS mrr_gain FROM e""")
def retrieval_compare(spark, d):
    """An index that filters by label first against a flat one: how often each ranks the nearest row of the query's label."""
    e = read(spark, d, "embeddings")
    filtered, flat = _nearest(spark, d, 10), _nearest(spark, d, 10, None)
    truth = filtered.where("rank = 1").select("query_id", "id").join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    of = lambda hits: search.retrieval_eval(hits, truth, "query_id", "id", "label", 5)
    return rounded(search.retrieval_delta(of(filtered), of(flat), "label"), 6)


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label = b.label AS same, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p), q AS (SELECT query_id, max(score) AS best, min(CASE WHEN same THEN rank END) AS f FROM r WHERE rank <= 5 GROUP BY 1)
SELECT count(*)::BIGINT AS n, round(avg(coalesce((f = 1)::INT, 0)), 6) AS top1, round(avg((f IS NOT NULL)::INT), 6) AS topk, round(avg(coalesce(1 / f, 0)), 6) AS mrr, round(avg((best < 0.55)::INT), 6) AS below FROM q""")
def label_retrieval(spark, d):
    """Leave one out: whether the nearest rows carry the row's label."""
    e = read(spark, d, "embeddings")
    near = analytics.knn(e.where("vec_id % 20 = 0"), e, 5, "vec_id", "embedding")
    lab = lambda c, n: e.select(F.col("vec_id").alias(c), F.col("label").alias(n))
    r = near.withColumnsRenamed({"q_id": "query_id", "b_id": "id"}).join(lab("query_id", "la"), "query_id").join(lab("id", "lb"), "id")
    q = r.groupBy("query_id").agg(F.max("score").alias("best"), F.min(F.when(F.col("la") == F.col("lb"), F.col("rank"))).alias("f"))
    hit = lambda x: F.avg(F.coalesce(x.cast("double"), F.lit(0.0)))
    return rounded(q.agg(F.count(F.lit(1)).alias("n"), hit(F.col("f") == 1).alias("top1"), hit(F.col("f").isNotNull()).alias("topk"), hit(1 / F.col("f")).alias("mrr"), hit(F.col("best") < 0.55).alias("below")), 6)


@query()
def soft_clusters(spark, d):
    """Clusters of a mixture whose number of parts the information criterion chooses."""
    return hierarchy.soft_clusters(read(spark, d, "embeddings"), "vec_id", "embedding")


@query()
def mixture_fit(spark, d):
    """How well two to eight clusters fit the vectors, by a criterion that charges for parameters."""
    return models.mixture_fit(read(spark, d, "embeddings"), "embedding", [2, 4, 8], 8)


@query()
def cluster_tree(spark, d):
    return hierarchy.cluster_tree(read(spark, d, "embeddings"), "vec_id", "embedding")


@query("SELECT 0 AS level, vec_id AS node FROM embeddings")
def leaf_index(spark, d):
    """The leaves of the tree of clusters, as a flat index."""
    tree = hierarchy.cluster_tree(read(spark, d, "embeddings"), "vec_id", "embedding")
    return search.flat_index(tree).select("level", "node")


MARKS = {"code": "[{}]", "digits": "[0-9]{4}", "table": r"\|"}


@query(r"""WITH g AS (SELECT lang, source, count(*)::BIGINT AS n_blocks, sum(len(regexp_extract_all(text, '\n')) + 1)::BIGINT AS n_lines, bool_or(regexp_matches(text, '[{}]')) AS c, bool_or(regexp_matches(text, '[0-9]{4}')) AS d, bool_or(contains(text, '|')) AS t FROM documents WHERE text IS NOT NULL GROUP BY 1, 2)
SELECT lang, source, n_blocks, n_lines, CASE WHEN c OR d OR t THEN concat_ws(', ', CASE WHEN c THEN 'code' END, CASE WHEN d THEN 'digits' END, CASE WHEN t THEN 'table' END) ELSE 'general' END AS constructs, CASE WHEN n_lines < 50 THEN 'LOW' WHEN n_lines < 200 THEN 'MODERATE' ELSE 'HIGH' END AS tier FROM g""")
def cluster_summary(spark, d):
    return search.cluster_summary(read(spark, d, "documents").where("text is not null"), ["lang", "source"], "text", MARKS)


@query()
def lsh_neighbours(spark, d):
    e = read(spark, d, "embeddings")
    return search.lsh_top(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)


@query()
def ivf_neighbours(spark, d):
    """Approximate neighbours through an inverted file; tests hold recall and the share of rows scored."""
    e = read(spark, d, "embeddings")
    return ivf.search(ivf.build(e, "vec_id", "embedding"), e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, 32)


@query(r"""WITH RECURSIVE w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) AS s FROM documents),
k AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM w WHERE len(s) > 0 GROUP BY s), e AS (SELECT rep, n, unnest(s) AS x FROM k),
l AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
r AS (SELECT rep AS a, rep AS b FROM k UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), c AS (SELECT a AS rep, min(b) AS component FROM r GROUP BY 1)
SELECT doc_id, coalesce(component, doc_id) AS component, coalesce(component, doc_id) = doc_id AS kept FROM w LEFT JOIN k USING (s) LEFT JOIN c USING (rep)""")
def minhash_dedup(spark, d):
    return minhash.minhash_dedup(read(spark, d, "documents"), "doc_id", "text")
