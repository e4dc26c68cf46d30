"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm import ann, codebooks, exact_dedup, html_main, language, mixing, near_dup, packing, quality_model, quality_rules, samples, toxicity, trie, url_filter

URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_verdicts(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    out = toxicity.toxic_passages(docs, model)
    return out.select("doc_id", samples.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(_read(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_read(spark, sf_dir, "documents")).drop("source", "tie")


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"), words=3, percent=85)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed(_read(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compressed(_read(spark, sf_dir, "embeddings"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(_read(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_url_filter, op2_quality_rules, op3_quality_model, op4_language, op5_toxicity, op6_main_text, op7_mixing, op8_near_dup, op9_packing, op10_neighbours, op11_exact_dedup, op12_vector_codes, op13_conversation_trie, pipeline)
    return {f.__name__: f for f in ops}


#: All pairs of classes of equal sets, then the smallest id reachable over links.
NEAR_DUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3
      THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
each_one AS (SELECT rep, n, unnest(s) AS shingle FROM classes),
links AS (
  SELECT a.rep AS x, b.rep AS y
  FROM each_one a JOIN each_one b ON a.shingle = b.shingle AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS x, rep AS y FROM classes UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
component AS (SELECT x AS rep, min(y) AS component_id FROM reach GROUP BY x)
SELECT t.doc_id, CAST(coalesce(len(t.s), 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, t.doc_id) AS component_id,
  coalesce(c.component_id, t.doc_id) = t.doc_id AS kept
FROM sets t LEFT JOIN classes k ON t.s = k.s LEFT JOIN component c ON c.rep = k.rep
"""


#: Groups of equal texts; of rows equal in id and text, any one stays.
EXACT_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""


#: One round of k-means: assignment a{t} by codebook b{t}, then codebook b{t + 1}.
CODES_ROUND = """
a{t} AS MATERIALIZED (
  SELECT rid, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d
  FROM (SELECT p.rid, p.part, b.entry, p.pp - 2 * list_inner_product(p.p, b.p) + list_inner_product(b.p, b.p) AS d FROM parts p JOIN b{t} b USING (part))
  GROUP BY rid, part),
m{t} AS (
  SELECT part, entry, list(m ORDER BY pos) AS p
  FROM (SELECT part, entry, pos, floor(sum(x) / count(*)) AS m
    FROM (SELECT part, a.entry, unnest(p.p) AS x, unnest(range(len(p.p))) AS pos FROM parts p JOIN a{t} a USING (rid, part)) GROUP BY part, entry, pos)
  GROUP BY part, entry),
b{u} AS MATERIALIZED (SELECT part, entry, coalesce(m.p, b.p) AS p FROM b{t} b LEFT JOIN m{t} m USING (part, entry)),
"""
CODES_SQL = (
    """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT *, list_inner_product(p, p) AS pp
  FROM (SELECT rid, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS p FROM kept, range(4) r(part))),
b0 AS MATERIALIZED (SELECT part, rid AS entry, p FROM parts WHERE rid < 256),
"""
    + "".join(CODES_ROUND.format(t=t, u=t + 1) for t in range(codebooks.ROUNDS))
    + """
last AS (
  SELECT rid, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d
  FROM (SELECT p.rid, p.part, b.entry, p.pp - 2 * list_inner_product(p.p, b.p) + list_inner_product(b.p, b.p) AS d FROM parts p JOIN b{t} b USING (part))
  GROUP BY rid, part),
coded AS (
  SELECT rid, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d) AS error FROM last GROUP BY rid),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(p, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS sha FROM b{t})
SELECT vec_id, code, error::BIGINT AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM kept JOIN coded USING (rid), book
""".format(t=codebooks.ROUNDS)
)

#: Prefixes as lists of turns.  The first list_reduce computes crc32 bit by bit.
TRIE_SQL = r"""
WITH ordered AS (
  SELECT conv_id AS c, struct_pack(role := role, text := text) AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role)::VARCHAR || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT c, list(t ORDER BY pos) AS turns FROM ordered GROUP BY c),
heads AS (
  SELECT c, turns, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 9 AS h
  FROM own),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 5),
paths AS (SELECT c, len(turns) AS length, d AS depth, sha256(turns[1:d]::VARCHAR) AS node, CASE WHEN d > 0 THEN sha256(turns[1:d - 1]::VARCHAR) END AS up,
    CASE WHEN d > 0 THEN strlen(turns[d].text) ELSE 0 END AS bytes
  FROM rebuilt, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
nodes AS (
  SELECT depth, node, any_value(up) AS up, any_value(bytes) AS bytes, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (length = depth), '')) AS ends_sha256
  FROM paths GROUP BY depth, node),
counted AS (
  SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.up = n.node) AS n_children FROM nodes n),
below AS (
  SELECT p.depth, p.node, count_if(u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved_tokens
  FROM counted u JOIN paths p ON p.c = u.conv_id AND p.depth <= u.depth GROUP BY p.depth, p.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN below b ON b.depth = n.depth AND b.node = n.node LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.up
"""


def oracle_sql() -> dict[str, str]:
    """op8's result is exact, and has SQL.  The others are not plain SQL: models are
    trained, draws are made, or neighbours are approximate.  tests/llm hold op1, op2,
    op6, op7, op8, op9, op10 and run() of the pipeline against brute force, op3's
    updates against plain Python, and op3, op4 and op5 against held-out labels."""
    return {"op8_near_dup": NEAR_DUP_SQL, "op11_exact_dedup": EXACT_DEDUP_SQL, "op12_vector_codes": CODES_SQL, "op13_conversation_trie": TRIE_SQL}
