"""Joins, loads, reconciliation and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog import query, read
from rowmill.operators import etl, joins, pairing, recon, setops
from rowmill.plans.summaries import rounded


@query("""SELECT coalesce(c.c_custkey, o.o_custkey) AS k, c.c_custkey IS NOT NULL AS in_a, o.o_custkey IS NOT NULL AS in_b, c.c_acctbal, o.n FROM (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0) c FULL JOIN (SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1) o ON c.c_custkey=o.o_custkey""")
def merge_in_flags(spark, d):
    c = read(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), "c_acctbal")
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return joins.merge_by(c, o, ["k"])


@query("""WITH a AS (SELECT c_nationkey AS k, c_custkey AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) n FROM customer), b AS (SELECT s_nationkey AS k, s_suppkey AS y, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) n FROM supplier),
j AS (SELECT coalesce(a.k,b.k) k, coalesce(a.n,b.n) n, x, y FROM a FULL JOIN b ON a.k=b.k AND a.n=b.n)
SELECT k, n::INT AS _seq, last_value(x IGNORE NULLS) OVER w AS x, last_value(y IGNORE NULLS) OVER w AS y FROM j WINDOW w AS (PARTITION BY k ORDER BY n ROWS UNBOUNDED PRECEDING)""")
def zip_merge(spark, d):
    a = read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("x"))
    b = read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("y"))
    return joins.zip_merge(a, b, ["k"], ["x"], ["y"])


@query("""WITH a AS (SELECT user_id, count(*)::BIGINT AS clicks FROM events WHERE event_type='click' GROUP BY 1), b AS (SELECT user_id, count(*)::BIGINT AS views FROM events WHERE event_type='view' GROUP BY 1), c AS (SELECT user_id, count(*)::BIGINT AS buys FROM events WHERE event_type='purchase' GROUP BY 1)
SELECT user_id, clicks, views, buys, clicks IS NOT NULL AS in_click, views IS NOT NULL AS in_view, buys IS NOT NULL AS in_purchase FROM a FULL JOIN b USING (user_id) FULL JOIN c USING (user_id)""")
def panel_full_join(spark, d):
    e = read(spark, d, "events")
    wave = lambda t, n: e.where(F.col("event_type") == t).groupBy("user_id").agg(F.count(F.lit(1)).alias(n))
    return joins.panel_join({"click": wave("click", "clicks"), "view": wave("view", "views"), "purchase": wave("purchase", "buys")}, "user_id")


@query("""SELECT c_custkey, coalesce(n.n_name,'UNKNOWN') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON c_nationkey=n_nationkey""")
def lookup_default(spark, d):
    dim = read(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.lookup(read(spark, d, "customer").select("c_custkey", "c_nationkey"), dim, ["c_nationkey"], {"n_name": "UNKNOWN"}).drop("c_nationkey")


@query("""WITH b AS (SELECT p_size AS band, min(p_retailprice) lo, max(p_retailprice) hi FROM part GROUP BY 1) SELECT o_orderkey, band FROM (SELECT o_orderkey, o_totalprice/100 AS v FROM orders) o JOIN b ON v BETWEEN lo AND hi""")
def range_join_bands(spark, d):
    b = read(spark, d, "part").groupBy(F.col("p_size").alias("band")).agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("v"))
    return joins.range_join(o, b, "v", "lo", "hi", 200.0).select("o_orderkey", "band")


@query("""SELECT a.event_id AS touch, b.event_id AS buy FROM events a JOIN events b ON a.user_id=b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3 DAY WHERE a.event_type='click' AND b.event_type='purchase'""")
def window_join_3d(spark, d):
    e = read(spark, d, "events")
    a = e.where("event_type='click'").select("user_id", F.col("event_id").alias("touch"), F.col("ts").alias("ta"))
    b = e.where("event_type='purchase'").select("user_id", F.col("event_id").alias("buy"), F.col("ts").alias("tb"))
    return joins.window_join(a, b, "user_id", "ta", "tb", 3).select("touch", "buy")


@query("""WITH m AS (SELECT o_orderstatus, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS revenue FROM orders GROUP BY 1,2)
SELECT a.o_orderstatus, a.month, round(a.revenue,2) AS revenue, round(b.revenue,2) AS revenue_prior FROM m a LEFT JOIN m b ON a.o_orderstatus=b.o_orderstatus AND a.month=(b.month + INTERVAL 12 MONTH)::DATE""")
def yoy_join(spark, d):
    m = read(spark, d, "orders").groupBy("o_orderstatus", F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("revenue"))
    return rounded(joins.yoy_join(m, "o_orderstatus", "month", "revenue"), 2)


ONE_TO_ONE = """WITH RECURSIVE a0 AS (SELECT o_custkey AS ref, o_orderkey AS id, o_totalprice AS amount FROM orders),
b0 AS (SELECT o_custkey + CASE WHEN o_orderkey % 13 = 0 THEN 1000000 ELSE 0 END AS ref, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1000 WHEN o_orderkey % 7 = 0 THEN o_totalprice + 0.005 WHEN o_orderkey % 17 = 0 THEN o_totalprice - 900 ELSE o_totalprice END AS amount FROM orders WHERE o_orderkey % 11 <> 0),
x AS (SELECT ref, amount, a.id AS ia, b.id AS ib FROM (SELECT *, row_number() OVER (PARTITION BY ref, amount ORDER BY id) AS n FROM a0) a FULL JOIN (SELECT *, row_number() OVER (PARTITION BY ref, amount ORDER BY id) AS n FROM b0) b USING (ref, amount, n)),
l AS (SELECT ref, list({'x': amount, 'id': ia} ORDER BY amount, ia) FILTER (ib IS NULL) AS la, list({'x': amount, 'id': ib} ORDER BY amount, ib) FILTER (ia IS NULL) AS lb FROM x WHERE ia IS NULL OR ib IS NULL GROUP BY ref),
s AS (SELECT ref, coalesce(la, []) AS la, coalesce(lb, []) AS lb, 1 AS i, 1 AS j, NULL::BIGINT AS ia, NULL::BIGINT AS ib, NULL::DOUBLE AS xa, NULL::DOUBLE AS xb FROM l
 UNION ALL SELECT ref, la, lb, i + (t <> 'b')::INT, j + (t <> 'a')::INT, CASE WHEN t <> 'b' THEN la[i].id END, CASE WHEN t <> 'a' THEN lb[j].id END, CASE WHEN t <> 'b' THEN la[i].x END, CASE WHEN t <> 'a' THEN lb[j].x END
 FROM (SELECT *, CASE WHEN j > len(lb) THEN 'a' WHEN i > len(la) THEN 'b' WHEN abs(la[i].x - lb[j].x) <= 1000 THEN 'both' WHEN la[i].x < lb[j].x THEN 'a' ELSE 'b' END AS t FROM s WHERE i <= len(la) OR j <= len(lb))),
m AS (SELECT ref, ia, ib, xa, xb FROM s WHERE ia IS NOT NULL OR ib IS NOT NULL)
SELECT ref, ia, ib, amount AS amount_a, amount AS amount_b, 'EXACT' AS status, NULL AS reason FROM x WHERE ia IS NOT NULL AND ib IS NOT NULL
UNION ALL SELECT ref, ia, ib, xa, xb, CASE WHEN ib IS NULL THEN 'ONLY_A' WHEN ia IS NULL THEN 'ONLY_B' ELSE 'TOLERANCE' END,
 CASE WHEN ib IS NULL THEN CASE WHEN EXISTS (FROM b0 WHERE b0.ref = m.ref AND abs(b0.amount - xa) <= 1000) THEN 'USED' WHEN EXISTS (FROM b0 WHERE b0.ref = m.ref) THEN 'DIFFERENCE' ELSE 'NONE' END
 WHEN ia IS NULL THEN CASE WHEN EXISTS (FROM a0 WHERE a0.ref = m.ref AND abs(a0.amount - xb) <= 1000) THEN 'USED' WHEN EXISTS (FROM a0 WHERE a0.ref = m.ref) THEN 'DIFFERENCE' ELSE 'NONE' END END FROM m"""


@query(ONE_TO_ONE)
def one_to_one_match(spark, d):
    """Orders against a ledger of them that lacks some, moves some references and alters some amounts, within 1,000."""
    o = read(spark, d, "orders")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    a = o.select(F.col("o_custkey").alias("ref"), k.alias("ia"), p.alias("amount"))
    altered = F.when(k % 5 == 0, p + 1000).when(k % 7 == 0, p + 0.005).when(k % 17 == 0, p - 900).otherwise(p)
    b = o.where(k % 11 != 0).select((F.col("o_custkey") + F.when(k % 13 == 0, 1_000_000).otherwise(0)).alias("ref"), k.alias("ib"), altered.alias("amount"))
    return pairing.match_one_to_one(a, b, "ref", "amount", "ia", "ib", 1000.0)


@query("SELECT o_orderkey, round(m,7) AS group_mean FROM (SELECT o_orderkey, o_totalprice, avg(o_totalprice) OVER (PARTITION BY o_custkey) m FROM orders) WHERE o_totalprice > 1.2*m")
def above_group_mean(spark, d):
    return rounded(joins.vs_group_mean(read(spark, d, "orders"), ["o_custkey"], "o_totalprice", 1.2).select("o_orderkey", "group_mean"), 7)


@query("""SELECT c_custkey, o.k AS last_order FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1) o ON o.o_custkey=c_custkey""")
def attach_latest(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_orderkey").alias("k"))
    return joins.attach_latest(read(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], "at").select("c_custkey", F.col("latest.k").alias("last_order"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice > 300000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='P')")
def semi_anti(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.anti(joins.semi(read(spark, d, "customer").select("c_custkey"), o.where("o_totalprice > 300000"), ["c_custkey"]), o.where("o_orderstatus='P'"), ["c_custkey"])


@query("""PIVOT (SELECT o_custkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) n FROM orders) WHERE n=1) ON o_orderstatus IN ('F','O','P') USING first(o_totalprice) GROUP BY o_custkey""")
def transpose_wide(spark, d):
    top = setops.nodupkey(read(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["-o_totalprice", "o_orderkey"])
    return setops.transpose(top, ["o_custkey"], "o_orderstatus", "o_totalprice", ["F", "O", "P"])


@query("SELECT c_custkey, 'c_acctbal' AS name, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::DOUBLE FROM customer")
def untranspose(spark, d):
    return setops.untranspose(read(spark, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("double")), ["c_custkey"], ["c_acctbal", "c_nationkey"])


@query("SELECT c_custkey AS k, c_acctbal AS bal, NULL::VARCHAR AS s_name, 'customer' AS source_table FROM customer UNION ALL SELECT s_suppkey, NULL, s_name, 'supplier' FROM supplier")
def outer_union(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return setops.stack_tables({"customer": c, "supplier": read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")})


CHANGED = "CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment || '*' ELSE c_mktsegment END"


@query(f"""WITH dim AS (SELECT c_custkey AS dim_key, c_custkey, c_mktsegment, DATE '1995-01-01' AS effective_from, DATE '9999-12-31' AS effective_to, true AS current_flag FROM customer WHERE c_custkey % 7 <> 0), stage AS (SELECT c_custkey, {CHANGED} AS c_mktsegment FROM customer WHERE c_custkey % 4 <> 1),
chg AS (SELECT s.* FROM stage s LEFT JOIN dim d USING (c_custkey) WHERE d.c_custkey IS NULL OR d.c_mktsegment <> s.c_mktsegment)
SELECT dim_key::BIGINT AS dim_key, c_custkey, c_mktsegment, effective_from, CASE WHEN c_custkey IN (SELECT c_custkey FROM chg) THEN DATE '2001-12-31' ELSE effective_to END AS effective_to, c_custkey NOT IN (SELECT c_custkey FROM chg) AS current_flag FROM dim
UNION ALL SELECT ((SELECT max(dim_key) FROM dim) + row_number() OVER (ORDER BY c_custkey))::BIGINT, c_custkey, c_mktsegment, DATE '2002-01-01', DATE '9999-12-31', true FROM chg""")
def scd2_merge(spark, d):
    c = read(spark, d, "customer")
    dim = c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("dim_key"), "c_custkey", "c_mktsegment", F.lit("1995-01-01").cast("date").alias("effective_from"), F.lit("9999-12-31").cast("date").alias("effective_to"), F.lit(True).alias("current_flag"))
    stage = c.where("c_custkey % 4 <> 1").select("c_custkey", F.expr(CHANGED).alias("c_mktsegment"))
    return etl.scd2(dim, stage, "c_custkey", ["c_mktsegment"], "2002-01-01")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert_delta(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return etl.upsert(o, o.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), "o_orderkey")


@query(f"""WITH prev AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0), curr AS (SELECT c_custkey, {CHANGED} AS c_mktsegment FROM customer WHERE c_custkey % 9 <> 0)
SELECT coalesce(c.c_custkey,p.c_custkey) AS c_custkey, CASE WHEN p.c_custkey IS NULL THEN 'INSERT' WHEN c.c_custkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation FROM curr c FULL JOIN prev p USING (c_custkey) WHERE p.c_custkey IS NULL OR c.c_custkey IS NULL OR p.c_mktsegment <> c.c_mktsegment""")
def cdc_md5(spark, d):
    c = read(spark, d, "customer")
    return etl.cdc(c.where("c_custkey % 9 <> 0").select("c_custkey", F.expr(CHANGED).alias("c_mktsegment")), c.where("c_custkey % 7 <> 0"), "c_custkey", ["c_mktsegment"])


@query("""SELECT o_orderkey, 'customer_sk' AS missing_keys FROM orders WHERE o_custkey % 6 = 0""")
def orphans(spark, d):
    dim = read(spark, d, "customer").where("c_custkey % 6 <> 0").select("c_custkey", F.col("c_custkey").alias("sk"))
    f = etl.resolve_keys(read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer")), {"customer": (dim, "c_custkey", "sk")})
    return etl.orphans(f, ["customer_sk"]).select("o_orderkey", "missing_keys")


@query("""SELECT o_orderkey, o_totalprice AS price, round(o_totalprice*0.1,4) AS tax, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'other' END AS status FROM orders WHERE o_totalprice > 100000""")
def rule_table_transform(spark, d):
    r = [{"category": "FILTER", "priority": 1, "target": "", "expression": "price > 100000"}, {"category": "RENAME", "priority": 1, "target": "price", "expression": "o_totalprice"}, {"category": "DERIVE", "priority": 1, "target": "tax", "expression": "round(price*0.1,4)"}, {"category": "RECODE", "priority": 1, "target": "status", "expression": "case o_orderstatus when 'O' then 'open' else 'other' end"}, {"category": "DERIVE", "priority": 2, "target": "x", "expression": "1", "active": False}]
    return etl.apply_rules(read(spark, d, "orders"), r).select("o_orderkey", "price", "tax", "status")


@query("WITH n AS (SELECT count(*)::BIGINT AS rows_a, count(*) FILTER (o_orderkey % 50 <> 0)::BIGINT AS rows_b FROM orders) SELECT rows_a, rows_b, (rows_b-rows_a)::BIGINT AS difference, round(100.0*(rows_b-rows_a)/rows_a,6) AS pct, CASE WHEN rows_a=rows_b THEN 'PASS' ELSE 'FAIL' END AS result FROM n")
def count_recon(spark, d):
    o = read(spark, d, "orders")
    return rounded(recon.count_reconcile(o, o.where("o_orderkey % 50 <> 0")), 6)


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 20 <> 3), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 30 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders)
SELECT b.o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'ONLY_B' ELSE 'VALUE' END AS kind, 'o_orderstatus' AS "column", a.o_orderstatus AS value_a, b.o_orderstatus AS value_b FROM b LEFT JOIN a USING (o_orderkey) WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def column_compare(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return recon.column_compare(o.where("o_orderkey % 20 <> 3"), o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 30 == 0, "X").otherwise(F.col("o_orderstatus"))), ["o_orderkey"], ["o_orderstatus"])


@query("""WITH a AS (SELECT o_custkey, sum(o_totalprice) v FROM orders GROUP BY 1), b AS (SELECT o_custkey, sum(o_totalprice) v FROM orders WHERE o_orderkey % 40 <> 0 GROUP BY 1)
SELECT coalesce(a.o_custkey,b.o_custkey) AS o_custkey, round(a.v,2) AS o_totalprice_a, round(b.v,2) AS o_totalprice_b, CASE WHEN abs(coalesce(a.v,0)-coalesce(b.v,0)) <= 1 THEN 'MATCH' ELSE 'BREAK' END AS status FROM a FULL JOIN b ON a.o_custkey=b.o_custkey""")
def sum_recon(spark, d):
    o = read(spark, d, "orders")
    return rounded(recon.sum_reconcile(o, o.where("o_orderkey % 40 <> 0"), ["o_custkey"], ["o_totalprice"], 1.0), 2)


@query("SELECT c_custkey AS k, 'B' AS missing_from FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'A' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def missing_keys(spark, d):
    return recon.missing_keys(read(spark, d, "customer").withColumnRenamed("c_custkey", "k"), read(spark, d, "orders").withColumnRenamed("o_custkey", "k"), ["k"])


@query("SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 8 <> 0)")
def fk_check(spark, d):
    return recon.fk_check(read(spark, d, "lineitem"), read(spark, d, "supplier").where("s_suppkey % 8 <> 0"), "l_suppkey", "s_suppkey").select("l_orderkey", "l_suppkey")


def _disc(c, q):
    return f"quantile_disc({c}, {q})::DOUBLE"


def _none(c, q):
    return "NULL::DOUBLE"


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*)::BIGINT AS n_rows, count(*) FILTER ({c} IS NULL)::BIGINT AS nulls, count(DISTINCT {c})::BIGINT AS distinct_values, {q(c, 0.25)} AS q25, {q(c, 0.5)} AS q50, {q(c, 0.75)} AS q75 FROM customer" for c, t, q in (("c_custkey", "bigint", _disc), ("c_name", "string", _none), ("c_nationkey", "int", _disc), ("c_acctbal", "double", _disc), ("c_mktsegment", "string", _none))))
def profile_table(spark, d):
    return recon.profile(read(spark, d, "customer"))


@query("""SELECT 'text' AS "column", count(nullif(trim(text),''))::BIGINT AS filled, count(*)::BIGINT AS n_rows, round(100.0*count(nullif(trim(text),''))/count(*),4) AS pct, 'PASS' AS result FROM documents UNION ALL SELECT 'lang', count(CASE WHEN lang<>'en' THEN lang END)::BIGINT, count(*)::BIGINT, round(100.0*count(CASE WHEN lang<>'en' THEN lang END)/count(*),4), 'FAIL' FROM documents""")
def completeness(spark, d):
    df = read(spark, d, "documents").select("text", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"))
    return rounded(recon.completeness(df, ["text", "lang"], 95.0))


@query("""SELECT 'positive' AS rule, count(*) FILTER (NOT o_totalprice > 0)::BIGINT AS violations, count(*)::BIGINT AS n_rows, round(100-100.0*count(*) FILTER (NOT o_totalprice > 0)/count(*),4) AS pct, CASE WHEN 100-100.0*count(*) FILTER (NOT o_totalprice > 0)/count(*) >= 99 THEN 'PASS' ELSE 'FAIL' END AS result FROM orders
UNION ALL SELECT 'open_small', count(*) FILTER (NOT (o_orderstatus <> 'O' OR o_totalprice < 200000))::BIGINT, count(*)::BIGINT, round(100-100.0*count(*) FILTER (NOT (o_orderstatus <> 'O' OR o_totalprice < 200000))/count(*),4), CASE WHEN 100-100.0*count(*) FILTER (NOT (o_orderstatus <> 'O' OR o_totalprice < 200000))/count(*) >= 99 THEN 'PASS' ELSE 'FAIL' END FROM orders""")
def validity_rules(spark, d):
    return rounded(recon.validity(read(spark, d, "orders"), {"positive": "o_totalprice > 0", "open_small": "o_orderstatus <> 'O' or o_totalprice < 200000"}, 99.0))


@query("""SELECT 'o_totalprice' AS "column", round(quantile_cont(o_totalprice,0.01),3) AS lower, round(quantile_cont(o_totalprice,0.99),3) AS upper FROM orders""")
def outlier_bounds(spark, d):
    return rounded(recon.outlier_bounds(read(spark, d, "orders"), ["o_totalprice"], 0.01, 0.99), 3)
