"""Documents and pages as a corpus: statements, lineage, graphs, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog import query, read
from rowmill.operators import analytics, corpus, lineage, matching, models, spans, variables
from rowmill.plans.summaries import rounded


@query(r"""WITH p AS (SELECT doc_id, string_split(text, '.') AS ps FROM documents), e AS (SELECT doc_id, len(ps) AS n, unnest(range(len(ps))) AS i, unnest(ps) AS s FROM p),
l AS (SELECT *, (sum(len(string_split(s, chr(10))) - 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) + 1)::BIGINT AS line_end, trim(regexp_replace(s, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS body FROM e)
SELECT doc_id, (i + 1)::INT AS statement, line_end, md5(body) AS body_hash, i = n - 1 AS incomplete FROM l WHERE body <> '' OR i < n - 1""")
def assemble_statements(spark, d):
    s = corpus.statements(read(spark, d, "documents"), "doc_id", "text", ".")
    return s.select("doc_id", "statement", "line_end", F.md5("body").alias("body_hash"), "incomplete")


@query("""WITH b AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM conversations),
x AS (SELECT *, coalesce(max((role = 'assistant')::INT) OVER (PARTITION BY conv_id, block ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM b)
SELECT conv_id, block, min(turn) AS line_start, max(turn) AS line_end, count(*)::BIGINT AS n_rows, max((role = 'assistant')::INT) = 1 AS closed FROM x WHERE block > 0 AND done = 0 GROUP BY 1, 2""")
def block_spans(spark, d):
    c = read(spark, d, "conversations")
    return corpus.block_spans(c, ["conv_id"], ["turn", "role", "text"], F.col("role") == "user", F.col("role") == "assistant", F.col("turn"))


def _sentences(spark, d, ends, key):
    """Sentences as spans of lines, their kind by what they hold; detected ones also end at ! and ?."""
    from pyspark.sql import Window

    s = corpus.statements(read(spark, d, "documents"), "doc_id", "text", ends)
    kind = F.when(F.col("body").rlike("[0-9]"), "number").when(F.length("body") > 60, "long").otherwise("short")
    start = F.coalesce(F.lag("line_end").over(Window.partitionBy("doc_id").orderBy("statement")), F.lit(1))
    return s.select(F.col("doc_id").alias("file"), kind.alias("kind"), start.alias("start"), F.col("line_end").alias("end"), (F.col("doc_id") * 1_000_000 + F.col("statement")).alias(key))


SPANS = "WITH " + ", ".join(
    rf"""{t}1 AS (SELECT doc_id, string_split_regex(text, '{ends}') AS ps FROM documents), {t}2 AS (SELECT doc_id, len(ps) AS n, unnest(range(len(ps))) AS i, unnest(ps) AS s FROM {t}1),
{t}3 AS (SELECT *, (sum(len(string_split(s, chr(10))) - 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) + 1)::BIGINT AS line_end, trim(regexp_replace(s, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS body FROM {t}2),
{t} AS (SELECT doc_id AS file, CASE WHEN regexp_matches(body, '[0-9]') THEN 'number' WHEN length(body) > 60 THEN 'long' ELSE 'short' END AS kind, coalesce(lag(line_end) OVER (PARTITION BY doc_id ORDER BY i), 1) AS s, line_end AS e, doc_id * 1000000 + i + 1 AS id FROM {t}3 WHERE body <> '' OR i < n - 1)"""
    for t, ends in (("g", "[.]"), ("p", "[.!?,]"))
) + """, m AS (SELECT g.*, (SELECT min(p.id) FROM p WHERE p.file = g.file AND p.kind = g.kind AND abs(p.s - g.s) <= 1 AND abs(p.e - g.e) <= 1) AS pid FROM g)
"""


@query(SPANS + """SELECT file, detected, coalesce(gold, 0) AS gold, coalesce(correct, 0) AS correct, round(correct / gold, 4) AS accuracy
FROM (SELECT file, count(*) AS detected FROM p GROUP BY 1) LEFT JOIN (SELECT file, count(*) AS gold, count(pid) AS correct FROM m GROUP BY 1) USING (file)""")
def span_files(spark, d):
    pred = _sentences(spark, d, ".!?,", "pid")
    return spans.span_files(pred, spans.match_spans(pred, _sentences(spark, d, ".", "gid"), 1))


@query(SPANS + """, n AS (SELECT m.id, m.kind, arg_min(p.kind, abs(p.s - m.s) * 1000000000000 + p.id) AS taken_for FROM m JOIN p USING (file) WHERE pid IS NULL GROUP BY 1, 2)
SELECT taken_for, kind, count(*) AS missed FROM n GROUP BY 1, 2""")
def span_confusion(spark, d):
    pred = _sentences(spark, d, ".!?,", "pid")
    return spans.span_confusion(spans.match_spans(pred, _sentences(spark, d, ".", "gid"), 1))


@query("""WITH r AS (SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 3 = 0 GROUP BY 2), f AS (SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY 2)
SELECT doc_id, content_hash FROM r UNION ALL SELECT doc_id, content_hash FROM f WHERE content_hash NOT IN (SELECT content_hash FROM r)""")
def registry_upsert(spark, d):
    docs = read(spark, d, "documents").where("text is not null")
    known = docs.where("doc_id % 3 = 0").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "content_hash")
    return corpus.register(docs, known, "doc_id", "text")


@query(r"""WITH l AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS folder, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS ref FROM pages), f AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) || '/' || regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS p FROM pages UNION SELECT 'about')
SELECT count(*)::BIGINT AS n_refs, count(*) FILTER (folder || '/' || ref IN (SELECT p FROM f) OR ref IN (SELECT p FROM f))::BIGINT AS resolved, count(DISTINCT page_id)::BIGINT AS pages FROM l""")
def resolve_references(spark, d):
    p = read(spark, d, "pages")
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    refs = p.select("page_id", host.alias("folder"), F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))).alias("ref"))
    files = p.select(F.concat(host, F.lit("/"), F.regexp_extract("url", r"://[^/?#]*/([^?#]*)", 1)).alias("path")).unionByName(spark.createDataFrame([("about",)], "path string"))
    out = corpus.resolve_refs(refs, files, "folder", "ref", "path")
    return out.agg(F.count(F.lit(1)).alias("n_refs"), F.count_if("resolved").alias("resolved"), F.count_distinct("page_id").alias("pages"))


def _edges(spark, d):
    """Customers and suppliers' nations as a directed graph: an order links nations by its priority."""
    li, s, o, c = (read(spark, d, t) for t in ("lineitem", "supplier", "orders", "customer"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.select(F.col("s_suppkey").alias("src"), (F.col("c_custkey") + 1_000_000).alias("dst"), "o_orderstatus", "l_returnflag")


EDGES = """j AS (SELECT s_suppkey, c_custkey + 1000000 AS cust, o_orderstatus, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
e AS (SELECT DISTINCT s_suppkey AS src, cust AS dst FROM j WHERE l_returnflag = 'A' UNION SELECT DISTINCT cust, s_suppkey FROM j WHERE l_returnflag = 'R' AND o_orderstatus = 'F')"""


def _two_way(spark, d):
    """Deliveries lead from suppliers to customers, returns of filled orders back."""
    e = _edges(spark, d)
    return e.where("l_returnflag = 'A'").select("src", "dst").unionByName(e.where("l_returnflag = 'R' and o_orderstatus = 'F'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


@query("""WITH w AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS p FROM lineitem WHERE l_returnflag = 'N'), r AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R')
SELECT DISTINCT w.k AS src, r.k AS dst FROM w JOIN r USING (p) WHERE w.k <> r.k""")
def dependency_edges(spark, d):
    li = read(spark, d, "lineitem")
    return corpus.dependency_edges(li.where("l_returnflag = 'N'"), li.where("l_returnflag = 'R'"), "l_partkey", "l_suppkey")


#: Prose has no program keywords, so common words play the roles: what follows "the" is read, what follows "of" is written.
PROSE_RULES = [lineage.Rule("READ", r"\bthe (\w+)"), lineage.Rule("WRITE", r"\bof (\w+)"), lineage.Rule("READ", r"^in (.+)$", many=True), lineage.Rule("DEFINE", r"\bthat (\w+)"), lineage.Rule("CALL", r"\band (\w+)")]


def _symbol_uses(spark, d):
    docs = read(spark, d, "documents").withColumn("text", lineage.blank_comments(F.col("text")))
    return lineage.symbol_uses(corpus.statements(docs, "doc_id", "text", "."), "doc_id", PROSE_RULES, [])


USES = r"""WITH c AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s)(/\*.*?\*/|''[^'']*''|"[^"]*"|[^/''"]+|.)', 1),
 lambda x: CASE WHEN length(x) > 3 AND starts_with(x, '/*') THEN regexp_replace(x, '[^\n]', ' ', 'g')
 WHEN length(x) > 1 AND (starts_with(x, '''') OR starts_with(x, '"')) THEN x[1] || regexp_replace(x[2:-2], '[^\n]', ' ', 'g') || x[1] ELSE x END), '') AS text FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(string_split(text, '.')) + 1)) AS statement, lower(trim(regexp_replace(unnest(string_split(text, '.')), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS body FROM c),
r AS (SELECT doc_id, statement, 'READ' AS role, unnest(regexp_extract_all(body, '\bthe ([A-Za-z0-9_]+)', 1)) AS name FROM s
 UNION SELECT doc_id, statement, 'WRITE', unnest(regexp_extract_all(body, '\bof ([A-Za-z0-9_]+)', 1)) FROM s
 UNION SELECT doc_id, statement, 'READ', unnest(regexp_extract_all(regexp_replace(substr(body, 4), '\([^()]*(?:\([^()]*\)[^()]*)*\)', ' ', 'g'), '([A-Za-z0-9_.]+)', 1)) FROM s WHERE regexp_matches(body, '^in .')
 UNION SELECT doc_id, statement, 'DEFINE', unnest(regexp_extract_all(body, '\bthat ([A-Za-z0-9_]+)', 1)) FROM s
 UNION SELECT doc_id, statement, 'CALL', unnest(regexp_extract_all(body, '\band ([A-Za-z0-9_]+)', 1)) FROM s),
u AS MATERIALIZED (SELECT * FROM r WHERE name <> '' AND NOT starts_with(name, '_'))
"""


@query(USES + "SELECT doc_id, role, count(*) AS uses, count(DISTINCT name) AS names FROM u GROUP BY 1, 2")
def symbol_uses(spark, d):
    """Table-level reads and writes, definitions and calls of each document's statements."""
    return _symbol_uses(spark, d).groupBy("doc_id", "role").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("name").alias("names"))


PRODUCERS = USES + """, o AS (SELECT doc_id, statement, name, role IN ('DEFINE', 'CALL') AS macro, role IN ('WRITE', 'DEFINE') AS makes, {'d': doc_id, 's': statement} AS spot FROM u),
l AS (SELECT *, last_value(CASE WHEN makes THEN spot END IGNORE NULLS) OVER (PARTITION BY macro, name ORDER BY doc_id, statement, makes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o)
SELECT doc_id, statement, name, m.d AS made_doc_id, m.s AS made_statement, CASE WHEN macro THEN 'macro_call' WHEN m.d = doc_id THEN 'dataset' ELSE 'cross_file' END AS kind
FROM l WHERE NOT makes AND m IS NOT NULL"""


@query(PRODUCERS)
def producer_edges(spark, d):
    return lineage.producer_edges(_symbol_uses(spark, d), "doc_id")


#: In prose, "the" marks a reference, and a sentence that begins with "in" assigns what follows its next word to that word.
IN_PROSE = r"(?id)^in (\w+) (.*)$"  # d: only \n ends a line, as in SQL


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, unnest(range(1, len(string_split(t, '.')) + 1)) AS statement, trim(regexp_replace(unnest(string_split(t, '.')), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS body FROM (SELECT doc_id, regexp_replace(replace(text, '&', ' '), '\bthe ', '&', 'g') AS t FROM documents)),
a AS MATERIALIZED (SELECT doc_id, statement, lower(regexp_extract(body, '(?i)^in ([A-Za-z0-9_]+) (.*)$', 1)) AS name, regexp_extract(body, '(?i)^in ([A-Za-z0-9_]+) (.*)$', 2) AS value FROM s WHERE regexp_matches(body, '(?i)^in ([A-Za-z0-9_]+) (.*)$')),
d AS (SELECT DISTINCT doc_id, statement, lower(unnest(regexp_extract_all(body, '&([A-Za-z0-9_]+)', 1))) AS name FROM s),
n AS (SELECT * FROM d UNION SELECT n.doc_id, n.statement, lower(unnest(regexp_extract_all(a.value, '&([A-Za-z0-9_]+)', 1))) FROM n JOIN a ON a.doc_id = n.doc_id AND a.name = n.name AND a.statement = (SELECT max(b.statement) FROM a b WHERE b.doc_id = n.doc_id AND b.name = n.name AND b.statement < n.statement)),
v AS MATERIALIZED (SELECT n.*, a.value FROM n LEFT JOIN a ON a.doc_id = n.doc_id AND a.name = n.name AND a.statement = (SELECT max(b.statement) FROM a b WHERE b.doc_id = n.doc_id AND b.name = n.name AND b.statement < n.statement)),
e AS MATERIALIZED (SELECT DISTINCT doc_id, statement, name, lower(unnest(regexp_extract_all(value, '&([A-Za-z0-9_]+)', 1))) AS need FROM v),
r AS (SELECT doc_id, statement, name, need FROM e UNION SELECT r.doc_id, r.statement, r.name, e.need FROM r JOIN e ON e.doc_id = r.doc_id AND e.statement = r.statement AND e.name = r.need),
c AS (SELECT DISTINCT doc_id, statement, name FROM r WHERE name = need),
bad AS (SELECT * FROM c UNION SELECT r.doc_id, r.statement, r.name FROM r JOIN c ON c.doc_id = r.doc_id AND c.statement = r.statement AND c.name = r.need),
u AS (SELECT doc_id, statement, name FROM v WHERE value IS NULL UNION SELECT r.doc_id, r.statement, r.name FROM r JOIN v ON v.doc_id = r.doc_id AND v.statement = r.statement AND v.name = r.need WHERE v.value IS NULL),
m AS MATERIALIZED (SELECT doc_id, statement, map_from_entries(list((name, value)) FILTER (value IS NOT NULL)) AS vals FROM v GROUP BY 1, 2),
x AS (SELECT doc_id, statement, name, 0 AS round, coalesce(value, '&' || name) AS text, vals FROM v JOIN m USING (doc_id, statement) WHERE (doc_id, statement, name) NOT IN (FROM bad)
 UNION ALL SELECT doc_id, statement, name, round + 1, array_to_string(list_transform(regexp_extract_all(text, '(?s)(&[A-Za-z0-9_]+\.?|[^&]+|&)', 1), lambda p: CASE WHEN regexp_matches(p, '^&[A-Za-z0-9_]') THEN coalesce(vals[lower(regexp_extract(p, '^&([A-Za-z0-9_]+)', 1))], p) ELSE p END), ''), vals FROM x WHERE round < 20 AND regexp_matches(text, '&[A-Za-z0-9_]'))
SELECT v.doc_id, v.statement, v.name, d.name IS NOT NULL AS direct, md5(t.text) AS text_hash, CASE WHEN b.name IS NOT NULL THEN 'CYCLE' WHEN u.name IS NOT NULL THEN 'UNDEFINED' ELSE 'RESOLVED' END AS status
FROM v LEFT JOIN d USING (doc_id, statement, name) LEFT JOIN bad b USING (doc_id, statement, name) LEFT JOIN u USING (doc_id, statement, name) LEFT JOIN (SELECT doc_id, statement, name, arg_max(text, round) AS text FROM x GROUP BY ALL) t USING (doc_id, statement, name)""")
def variable_references(spark, d):
    text = F.regexp_replace(F.replace("text", F.lit("&"), F.lit(" ")), r"(?<![A-Za-z0-9_])the ", "&")  # Java's \b takes é for a part of a word, SQL's does not
    s = corpus.statements(read(spark, d, "documents").withColumn("text", text), "doc_id", "text", ".")
    return variables.references(s, "doc_id", IN_PROSE).select("doc_id", "statement", "name", "direct", F.md5("text").alias("text_hash"), "status")


@query()
def strong_components(spark, d):
    """Strongly connected components of the whole graph; tests hold the operator against brute force."""
    return matching.strong_components(_two_way(spark, d))


@query("WITH " + EDGES + ", n AS (SELECT src AS v FROM e UNION SELECT dst FROM e) SELECT (SELECT count(*) FROM n)::BIGINT AS n_nodes, (SELECT count(*) FROM e)::BIGINT AS n_edges")
def graph_counts(spark, d):
    return corpus.graph_counts(_two_way(spark, d))


TRADE = """t AS (SELECT s_nationkey AS src, c_nationkey AS dst, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY v DESC, dst) AS n FROM t) WHERE n <= 2)"""


def _trade(spark, d):
    """Each nation's suppliers lead to the two nations whose customers buy most from them."""
    from pyspark.sql import Window

    li, s, o, c = (read(spark, d, t) for t in ("lineitem", "supplier", "orders", "customer"))
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    t = j.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.sum("l_extendedprice").alias("v"))
    n = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("v"), "dst"))
    return t.withColumn("n", n).where("n <= 2").select("src", "dst")


@query("WITH RECURSIVE " + TRADE + """, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), n AS (SELECT src AS v FROM e UNION SELECT dst FROM e),
s AS (SELECT v AS node, least(v, coalesce((SELECT min(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = v), v)) AS scc FROM n), g AS (SELECT scc, count(*) AS n_nodes FROM s GROUP BY 1 HAVING count(*) > 1)
SELECT node, s.scc, n_nodes FROM s JOIN g USING (scc)""")
def component_members(spark, d):
    """The members of each strongly connected component of several nations, and their number."""
    scc = matching.strong_components(_trade(spark, d))
    return scc.join(corpus.component_sizes(scc).drop("first"), "scc").select("node", "scc", "n_nodes")


@query()
def condensed_depth(spark, d):
    """Edges between components, and the longest path over them, 10 at most."""
    e = _two_way(spark, d)
    c = corpus.condense(e, matching.strong_components(e))
    return c.agg(F.count(F.lit(1)).alias("n_edges")).withColumn("hop_cap", F.lit(corpus.hop_cap(c)))


PATTERNS = {"exclaim": "!", "upper": "[A-Z]", "digit": "[0-9]"}


@query(r"""SELECT doc_id, (len(regexp_extract_all(text, '\n')) + 1)::BIGINT AS n_lines, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))::BIGINT AS n_words, round(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]')) / nullif(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0), 0), 6) AS mean_word,
 round(coalesce(len(regexp_extract_all(text, '[0-9]')) / nullif(length(text), 0), 0), 6) AS digit_share, len(regexp_extract_all(text, '!'))::BIGINT AS n_exclaim, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper FROM documents""")
def document_features(spark, d):
    f = corpus.block_features(read(spark, d, "documents"), "doc_id", "text", {k: PATTERNS[k] for k in ("exclaim", "upper")})
    return rounded(f.drop("nesting"), 6)


PAGE_FLAGS = {"script": "(?i)<script", "form": "(?i)<form", "table": "(?i)<table", "list": "(?i)<li>", "style": "(?i)<style", "bold": "(?i)<b>", "rule": "(?i)<hr|<br"}
PAGE_WEIGHTS = {"http": 1.0, "https": 0.5}


@query(r"""WITH p AS (SELECT page_id, html, regexp_extract(url, '^([a-z]+)://', 1) AS kind, len(string_split(html, chr(10))) AS n, len(list_distinct(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: lower(x)))) AS refs, len(regexp_extract_all(html, '<p>')) AS ps,
 list_reduce(list_prepend({'o': 0, 'c': 0, 'now': 0, 'top': 0}, list_transform(string_split(html, chr(10)), lambda l: {'o': len(regexp_extract_all(l, '<(div|ul|nav)\b'))::INT, 'c': len(regexp_extract_all(l, '</(div|ul|nav)>'))::INT, 'now': 0, 'top': 0})), lambda a, x: {'o': 0, 'c': 0, 'now': greatest(a.now + x.o - x.c, 0)::INT, 'top': greatest(a.top, a.now + x.o)::INT}).top AS top FROM pages)
SELECT page_id, n / 200 AS line_count_norm, top / 5 AS nesting_norm, round(least(1.5, len(regexp_extract_all(html, '%')) / n), 8)::DOUBLE AS macro_pct, CASE kind WHEN 'http' THEN 1.0 WHEN 'https' THEN 0.5 ELSE 1.0 END::DOUBLE AS type_weight, (html NOT LIKE '%</html>%')::INT::DOUBLE AS is_ambiguous, round(least(refs / 5, 1.5), 8)::DOUBLE AS dataset_count_norm, round(least(ps / n, 1.0), 8)::DOUBLE AS conditional_density,
 regexp_matches(html, '(?i)<script')::INT::DOUBLE AS has_script, regexp_matches(html, '(?i)<form')::INT::DOUBLE AS has_form, regexp_matches(html, '(?i)<table')::INT::DOUBLE AS has_table, regexp_matches(html, '(?i)<li>')::INT::DOUBLE AS has_list, regexp_matches(html, '(?i)<style')::INT::DOUBLE AS has_style, regexp_matches(html, '(?i)<b>')::INT::DOUBLE AS has_bold, regexp_matches(html, '(?i)<hr|<br')::INT::DOUBLE AS has_rule FROM p""")
def block_vectors(spark, d):
    """Pages as blocks, by all 14 features; the seven flags are of page text."""
    p = read(spark, d, "pages").withColumn("kind", F.regexp_extract("url", "^([a-z]+)://", 1)).withColumn("odd", ~F.col("html").contains("</html>"))
    v = corpus.block_vector(p, "page_id", "html", F.col("kind"), F.col("odd"), ("<(div|ul|nav)\\b", "</(div|ul|nav)>"), 'href="([^"]*)"', "<p>", PAGE_FLAGS, PAGE_WEIGHTS)
    return rounded(v, 8)


@query(r"""WITH f AS (SELECT doc_id, lang, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS w, len(regexp_extract_all(text, '!')) AS x FROM documents), r AS (SELECT *, CASE WHEN x > 20 THEN 'HIGH' WHEN w > 400 THEN 'MODERATE' ELSE 'LOW' END AS risk, CASE WHEN x > 20 THEN 0.9 WHEN w > 400 THEN 0.7 ELSE 0.8 END::DOUBLE AS confidence FROM f)
SELECT doc_id, risk, confidence, CASE WHEN risk = 'HIGH' THEN 'MANUAL_REVIEW' WHEN lang IN ('en') AND risk = 'LOW' THEN 'RULES' WHEN risk = 'LOW' THEN 'DIRECT' ELSE 'ASSISTED' END AS strategy FROM r""")
def risk_and_strategy(spark, d):
    docs = read(spark, d, "documents")
    f = corpus.block_features(docs, "doc_id", "text", PATTERNS)
    r = corpus.risk_rules(f, [(F.col("n_exclaim") > 20, "HIGH", 0.9), (F.col("n_words") > 400, "MODERATE", 0.7)], ("LOW", 0.8))
    return r.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "risk", "confidence", corpus.strategy(F.col("risk"), F.col("lang"), ["en"]).alias("strategy"))


@query()
def risk_model(spark, d):
    """Learns the tiers that the rules give from the features of the texts."""
    f = corpus.block_features(read(spark, d, "documents"), "doc_id", "text", PATTERNS)
    tiers = corpus.risk_rules(f, [(F.col("n_exclaim") > 20, "HIGH", 0.9), (F.col("n_words") > 400, "MODERATE", 0.7)], ("LOW", 0.8))
    x = tiers.withColumns({f"log_{c}": F.log1p(F.col(c).cast("double")) for c in ("n_words", "n_exclaim", "n_lines")})
    return rounded(models.risk_model(x, "doc_id", "risk", ["log_n_words", "log_n_exclaim", "log_n_lines", "digit_share"]), 6)


@query(r"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\b(the|and|license|idiot)\b', 1)) AS name FROM documents), c AS (SELECT name, doc_id, count(*) AS c FROM e GROUP BY 1, 2) SELECT name, count(*)::BIGINT AS documents, sum(c)::BIGINT AS uses FROM c GROUP BY 1""")
def function_usage(spark, d):
    return corpus.function_usage(read(spark, d, "documents"), "doc_id", "text", ["the", "and", "license", "idiot"])


@query(r"""WITH s AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS p, lag(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
x AS (SELECT conv_id, turn, role, md5(text) AS h, list_filter([CASE WHEN regexp_matches(text, '[0-9]') THEN 'digit' END, CASE WHEN contains(text, '?') THEN 'ask' END, CASE WHEN contains(text, '.') THEN 'stop' END], lambda v: v IS NOT NULL) AS a, list_filter([CASE WHEN regexp_matches(p, '[0-9]') THEN 'digit' END, CASE WHEN contains(p, '?') THEN 'ask' END, CASE WHEN contains(p, '.') THEN 'stop' END], lambda v: v IS NOT NULL) AS b, role = r AS same FROM s WHERE p IS NOT NULL)
SELECT conv_id, turn, h, round(least(1.0, coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 1.0) + CASE WHEN same THEN 0.05 ELSE 0 END), 6)::DOUBLE AS similarity FROM x""")
def op_similarity(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rules = {"digit": "[0-9]", "ask": r"\?", "stop": r"\."}
    s = read(spark, d, "conversations").withColumn("p", F.lag("text").over(w)).withColumn("r", F.lag("role").over(w)).where("p is not null")
    return s.select("conv_id", "turn", F.md5("text").alias("h"), F.round(corpus.op_similarity(corpus.op_set(F.col("text"), rules), corpus.op_set(F.col("p"), rules), F.col("role") == F.col("r")), 6).alias("similarity"))


@query("""SELECT c AS column, t AS inferred, (SELECT count(*) FROM orders)::BIGINT AS n_filled FROM (VALUES ('o_orderkey','long'), ('price','double'), ('day','date'), ('o_orderpriority','string')) v(c, t)""")
def infer_types(spark, d):
    df = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("price"), F.col("o_orderdate").cast("date").cast("string").alias("day"), "o_orderpriority")
    return corpus.infer_types(df, ["o_orderkey", "price", "day", "o_orderpriority"])


@query("""WITH w AS (SELECT user_id, event_type, min(ts) AS written_at FROM events WHERE value > 80 GROUP BY 1, 2) SELECT event_id, written_at FROM events JOIN w USING (user_id, event_type) WHERE value < 20 AND ts > written_at""")
def reload_violations(spark, d):
    e = read(spark, d, "events")
    return corpus.reload_violations(e.where("value < 20"), e.where("value > 80"), ["user_id"], "event_type", "ts").select("event_id", "written_at")


@query("""WITH RECURSIVE s AS (SELECT min(l_partkey) AS node FROM lineitem), r AS (SELECT node, 0 AS hops FROM s UNION SELECT l.l_suppkey + 1000000, hops + 1 FROM r JOIN lineitem l ON l.l_partkey = r.node WHERE hops < 1) SELECT node, min(hops)::INT AS hops FROM r GROUP BY 1""")
def supplier_reach(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst")).distinct()
    seeds = read(spark, d, "lineitem").agg(F.min("l_partkey").alias("node"))
    return analytics.khop(e, seeds, 1)
