"""Loads, reconciliation, quality measures and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog import query, read
from rowmill.operators import etl, matching, recon
from rowmill.operators.quantiles import exact_quantiles
from rowmill.plans.summaries import rounded


def _delta(spark, d):
    """Changed and new customers: every 10th with another balance, and some with new keys."""
    c = read(spark, d, "customer")
    return c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(c.where("c_custkey % 25 = 3").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))


@query("SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 10000000, c_acctbal FROM customer WHERE c_custkey % 25 = 3")
def scd1_overwrite(spark, d):
    return etl.upsert(read(spark, d, "customer"), _delta(spark, d), "c_custkey").select("c_custkey", "c_acctbal")


@query("""WITH n AS (SELECT count(*)::BIGINT AS b, count(*) FILTER (c_custkey % 10 = 0)::BIGINT AS r, count(*) FILTER (c_custkey % 25 = 3)::BIGINT AS f FROM customer)
SELECT 'incremental' AS load_mode, b AS rows_before, r + f AS rows_source, r AS rows_replaced, b + f AS rows_after, 'PASS' AS result FROM n UNION ALL SELECT 'full', b, r + f, r, r + f, 'PASS' FROM n""")
def load_counts(spark, d):
    c, x = read(spark, d, "customer"), _delta(spark, d)
    one = lambda full: etl.reconciled_load(c, x, "c_custkey", full)[1].select(F.lit("full" if full else "incremental").alias("load_mode"), "*")
    return one(False).unionByName(one(True))


@query("SELECT o_orderkey, o_orderdate > TIMESTAMP '2000-06-30' AS recent FROM orders WHERE o_orderdate > TIMESTAMP '1999-12-31'")
def extract_since(spark, d):
    got = etl.extract_since(read(spark, d, "orders"), "o_orderdate", "1999-12-31")
    return got.select("o_orderkey", (F.col("o_orderdate") > F.lit("2000-06-30").cast("timestamp")).alias("recent"))


@query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2001-08-01') > 1000 AS archived FROM orders")
def archive_split(spark, d):
    keep, old = etl.split_by_age(read(spark, d, "orders"), "o_orderdate", "2001-08-01", 1000)
    return keep.select("o_orderkey", F.lit(False).alias("archived")).unionByName(old.select("o_orderkey", F.lit(True).alias("archived")))


@query("SELECT 'R1' AS run_id, 'orders' AS table_name, count(*)::BIGINT AS n_rows, max(o_orderdate)::TIMESTAMP AS high_water FROM orders UNION ALL SELECT 'R1', 'events', count(*), max(ts)::TIMESTAMP FROM events")
def load_log(spark, d):
    return etl.load_log({t: read(spark, d, t) for t in ("orders", "events")}, {"orders": "o_orderdate", "events": "ts"}, "R1")


@query("""WITH x AS (SELECT o_orderkey, o_orderdate::DATE AS dt FROM orders) SELECT o_orderkey, date_trunc('month', dt)::DATE AS mth_from, last_day(dt) AS mth_to, date_trunc('quarter', dt)::DATE AS qtr_from, (date_trunc('quarter', dt) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS qtr_to,
 date_trunc('year', dt)::DATE AS ytd_from, dt AS ytd_to, make_date(year(dt), 12, 31) AS yr_to FROM x""")
def period_ranges(spark, d):
    dt = F.col("o_orderdate").cast("date")
    p = {k: etl.period_range(dt, k) for k in ("MTH", "QTR", "YTD", "YR")}
    return read(spark, d, "orders").select("o_orderkey", p["MTH"][0].alias("mth_from"), p["MTH"][1].alias("mth_to"), p["QTR"][0].alias("qtr_from"), p["QTR"][1].alias("qtr_to"), p["YTD"][0].alias("ytd_from"), p["YTD"][1].alias("ytd_to"), p["YR"][1].alias("yr_to"))


@query("SELECT c_mktsegment, c_nationkey, count(*)::BIGINT AS n, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1, 2")
def for_each_group(spark, d):
    return rounded(etl.for_each_group(read(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], {"n": F.count(F.lit(1)), "mean": F.avg("c_acctbal")}), 6)


@query("""SELECT count(*)::BIGINT AS rows_a, (SELECT count(*) FROM customer WHERE c_custkey % 50 <> 1)::BIGINT AS rows_b, (SELECT count(*) FROM customer WHERE c_custkey % 50 <> 1 AND c_custkey % 7 = 0)::BIGINT AS values_differ, 3 * (SELECT count(*) FROM customer WHERE c_custkey % 50 = 1)::BIGINT AS cells_missing, 'c_name' AS missing_columns, 'extra' AS extra_columns, 'SCHEMA' AS category FROM customer""")
def frame_diff(spark, d):
    a = read(spark, d, "customer")
    b = a.where("c_custkey % 50 <> 1").withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 7 == 0, 0.01).otherwise(0.00001)).withColumn("extra", F.lit(1)).drop("c_name")
    return recon.classify_diff(recon.frame_diff(a, b, ["c_custkey"]))


@query("""SELECT n_regionkey, n_nationkey, count, side FROM (SELECT n_regionkey, n_nationkey, 1::BIGINT AS count, 'A' AS side FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_regionkey, n_nationkey + 100, 1, 'B' FROM nation WHERE n_nationkey % 5 = 0)""")
def multiset_diff(spark, d):
    a = read(spark, d, "nation").select("n_regionkey", "n_nationkey")
    b = a.withColumn("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, F.col("n_nationkey") + 100).otherwise(F.col("n_nationkey")))
    return recon.compare_frames(a, b)


@query("SELECT 4::BIGINT AS n_checks, 3::BIGINT AS passed, 75.0::DOUBLE AS score, 'REJECT' AS recommendation, count(*)::BIGINT AS n_orders FROM orders")
def check_score(spark, d):
    """Pluggable checks of a derived table against its source, and their score."""
    o = read(spark, d, "orders")
    after = o.where("o_orderkey % 2 = 0").withColumn("year", F.year("o_orderdate"))
    checks = recon.check_all([(n, recon.CHECKS[n]) for n in ("ROW_PRESERVATION", "ROW_REDUCTION", "OUTPUT_NONEMPTY", "COLUMN_SUPERSET")], o, after)
    return recon.quality_score(checks.withColumn("result", F.when(F.col("passed"), "PASS").otherwise("FAIL"))).join(F.broadcast(o.agg(F.count(F.lit(1)).alias("n_orders"))))


@query("SELECT 'SUM_PRESERVATION' AS name, true AS passed, '0.00' AS observed, (SELECT count(*) FROM lineitem)::BIGINT AS n_rows")
def sum_preserved(spark, d):
    li = read(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("long"))
    after = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("l_quantity"))
    out = recon.check_all([("SUM_PRESERVATION", recon.sum_preserved("l_quantity"))], li, after)
    return out.join(F.broadcast(li.agg(F.count(F.lit(1)).alias("n_rows"))))


@query("""WITH x AS (SELECT least(c_nationkey, s_nationkey)::INT AS party_a, greatest(c_nationkey, s_nationkey)::INT AS party_b, c_nationkey, s_nationkey, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
n AS (SELECT party_a, party_b, round(sum(CASE WHEN c_nationkey = party_a THEN q ELSE 0 END), 4) AS a_to_b, round(sum(CASE WHEN c_nationkey = party_b THEN q ELSE 0 END), 4) AS b_to_a FROM x GROUP BY 1, 2)
SELECT *, round(abs(a_to_b - b_to_a), 4) AS difference, CASE WHEN abs(a_to_b - b_to_a) <= 5 THEN 'ELIMINATED' WHEN abs(a_to_b - b_to_a) <= 200 THEN 'MINOR' ELSE 'MATERIAL' END AS status FROM n""")
def net_pairs(spark, d):
    li, o, c, s = (read(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return rounded(recon.net_pairs(x.select("c_nationkey", "s_nationkey", "l_quantity"), "c_nationkey", "s_nationkey", "l_quantity", 5, 200))


@query("""WITH n AS (SELECT count(*)::BIGINT AS n, 'negative_balance' AS table_name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT count(*), 'big_orders' FROM orders WHERE o_totalprice > 1e12 UNION ALL SELECT count(*), 'discounts' FROM lineitem WHERE l_discount > 0.05)
SELECT *, CASE WHEN n >= 1000 THEN 'HIGH' WHEN n >= 100 THEN 'MEDIUM' WHEN n > 0 THEN 'LOW' ELSE 'NONE' END AS severity FROM n""")
def consolidate(spark, d):
    return recon.consolidate({"negative_balance": read(spark, d, "customer").where("c_acctbal < 0"), "big_orders": read(spark, d, "orders").where("o_totalprice > 1e12"), "discounts": read(spark, d, "lineitem").where("l_discount > 0.05")}, 1000, 100)


@query("""WITH t AS (SELECT 'open' AS category, count(*)::BIGINT AS items, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'debit', count(*), round(sum(c_acctbal), 2) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'none', 0, 0.0)
SELECT *, abs(total) > 50000 AS material, CASE WHEN abs(total) > 50000 THEN 'Investigate ' || category ELSE 'Within limits' END AS note FROM t""")
def recon_summary(spark, d):
    c = read(spark, d, "customer")
    return rounded(recon.recon_summary({"open": (read(spark, d, "orders").where("o_orderstatus = 'O'"), "o_totalprice"), "debit": (c.where("c_acctbal < 0"), "c_acctbal"), "none": (c.where("c_custkey < 0"), "c_acctbal")}, 50000), 2)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 50 = 1 THEN 'ONLY_A' WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 'MISMATCH' ELSE 'MATCH' END AS status,
 CASE WHEN c_custkey % 50 = 1 THEN '' ELSE concat_ws(',', CASE WHEN c_custkey % 7 = 0 THEN 'c_name' END, CASE WHEN c_custkey % 11 = 0 THEN 'c_acctbal' END) END AS mismatches FROM customer""")
def consistency(spark, d):
    a = read(spark, d, "customer")
    k = F.col("c_custkey")
    b = a.where("c_custkey % 50 <> 1").withColumn("c_name", F.when(k % 7 == 0, "x").otherwise(F.col("c_name"))).withColumn("c_acctbal", F.when(k % 11 != 0, F.col("c_acctbal")))
    return recon.consistency(a, b, "c_custkey", ["c_name", "c_acctbal"])


@query("""WITH m AS (SELECT event_type, max(ts)::DATE AS latest FROM events GROUP BY 1) SELECT event_type, latest, (DATE '2024-02-10' - latest)::INT AS lag_days, CASE WHEN DATE '2024-02-10' - latest > 5 THEN 'STALE' ELSE 'CURRENT' END AS status, greatest(0, 100 - 5 * greatest(0, DATE '2024-02-10' - latest - 5))::INT AS score FROM m""")
def timeliness(spark, d):
    return recon.timeliness(read(spark, d, "events"), "ts", "2024-02-10", 5, ["event_type"])


@query("""WITH s AS (SELECT c_nationkey, 100.0 * avg((c_acctbal > 0)::INT) AS a, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 100.0 * avg((c_mktsegment <> 'BUILDING')::INT) END AS b FROM customer GROUP BY 1),
g AS (SELECT *, (a * 0.7 + coalesce(b * 0.3, 0)) / (0.7 + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END) AS c FROM s)
SELECT c_nationkey, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS composite, CASE WHEN c >= 90 THEN 'A' WHEN c >= 80 THEN 'B' WHEN c >= 70 THEN 'C' WHEN c >= 60 THEN 'D' ELSE 'F' END AS grade FROM g""")
def scorecard(spark, d):
    share = lambda x: 100 * F.avg(x.cast("int"))
    s = read(spark, d, "customer").groupBy("c_nationkey").agg(share(F.col("c_acctbal") > 0).alias("a"), share(F.col("c_mktsegment") != "BUILDING").alias("b"))
    return rounded(recon.graded(s.withColumn("b", F.when(F.col("c_nationkey") % 3 != 0, F.col("b"))), {"a": 0.7, "b": 0.3}), 6)


@query("""WITH x AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS brand FROM part), m AS (SELECT quantile_cont(price, 0.5) AS med FROM x)
SELECT p_partkey, round(coalesce(price, med), 6) AS price, coalesce(brand, 'UNKNOWN') AS brand, price IS NULL AS price_imputed, brand IS NULL AS brand_imputed FROM x, m""")
def impute(spark, d):
    k = F.col("p_partkey")
    x = read(spark, d, "part").select("p_partkey", F.when(k % 7 != 0, F.col("p_retailprice")).alias("price"), F.when(k % 5 != 0, F.col("p_brand")).alias("brand"))
    x = x.join(F.broadcast(exact_quantiles(x, [], "price", {"med": 0.5})))
    return rounded(recon.impute(x, {"price": F.col("med"), "brand": F.lit("UNKNOWN")}).drop("med"), 6)


@query("""WITH x AS (SELECT p_partkey, p_size % 5 + 1 AS q1, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 5 + 1 END AS q2, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size % 5 + 1 END AS q3 FROM part), f AS (SELECT *, list_filter([q1, q2, q3], lambda v: v IS NOT NULL) AS g FROM x),
y AS (SELECT p_partkey, len(g) > 1 AND list_min(g) = list_max(g) AS straight_line, len(g) < 2.4 AS low_completion, len(list_filter(g, lambda v: v > 1 AND v < 5)) = 0 AS extreme FROM f)
SELECT *, concat_ws(';', CASE WHEN straight_line THEN 'straight_line' END, CASE WHEN low_completion THEN 'low_completion' END, CASE WHEN extreme THEN 'extreme' END) AS note FROM y""")
def survey_flags(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size") % 5 + 1
    x = read(spark, d, "part").select("p_partkey", s.alias("q1"), F.when(k % 3 != 0, k % 5 + 1).alias("q2"), F.when(k % 6 != 0, s).alias("q3"))
    return recon.survey_flags(x, ["q1", "q2", "q3"], 1, 5).drop("q1", "q2", "q3")


@query("""SELECT c AS column, t AS type_before, a AS type_after, r AS result, (SELECT count(*) FROM customer)::BIGINT AS n_rows FROM (VALUES ('c_custkey','bigint','string','NOT_NUMERIC'), ('c_name','string',NULL,'MISSING'), ('c_nationkey','int','int','PASS'), ('c_acctbal','double','double','PASS'), ('c_mktsegment','string','string','PASS')) v(c, t, a, r)""")
def schema_check(spark, d):
    c = read(spark, d, "customer")
    out = recon.schema_check(c, c.drop("c_name").withColumn("c_custkey", F.col("c_custkey").cast("string")))
    return out.join(F.broadcast(c.agg(F.count(F.lit(1)).alias("n_rows"))))


MONITOR = """WITH l AS (SELECT *, CASE WHEN value > 60 THEN 'SUCCESS' WHEN value > 30 THEN 'PARTIAL' ELSE 'REVIEW' END AS status FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)"""


@query(MONITOR + """, s AS (SELECT count(*)::BIGINT AS n, round(avg((status='SUCCESS')::INT), 6) AS success_rate, round(avg((status='PARTIAL')::INT), 6) AS partial_rate, round(avg((status='REVIEW')::INT), 6) AS review_rate, round(avg(value / 100), 6) AS mean_confidence, round((SELECT max(c) FROM (SELECT count(*) c FROM l GROUP BY event_type)) / count(*), 6) AS top_mode_share FROM l)
SELECT *, concat_ws(',', CASE WHEN success_rate < 0.7 THEN 'LOW_SUCCESS' END, CASE WHEN mean_confidence < 0.75 THEN 'LOW_CONFIDENCE' END, CASE WHEN top_mode_share > 0.4 THEN 'ONE_MODE' END) AS alerts FROM s""")
def quality_monitor(spark, d):
    v = F.col("value")
    e = read(spark, d, "events").withColumn("status", F.when(v > 60, "SUCCESS").when(v > 30, "PARTIAL").otherwise("REVIEW")).withColumn("confidence", v / 100)
    return rounded(recon.quality_monitor(e, [F.desc("ts"), F.desc("event_id")], 200, "status", "confidence", "event_type"), 6)


@query("""WITH b AS (SELECT ts::DATE AS day, avg((value > 60)::INT) AS success_rate FROM events GROUP BY 1), x AS (SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-15')::BIGINT AS growth, round(abs(avg(value / 100) - avg((value > 60)::INT)), 6) AS ece, round(avg((event_type = 'view')::INT), 6) AS top_share FROM events),
l AS (SELECT count(*) FILTER (success_rate < 0.7)::BIGINT AS low_batches FROM (SELECT * FROM b ORDER BY day DESC LIMIT 2)), r AS (SELECT *, concat_ws(',', CASE WHEN growth >= 500 THEN 'GROWTH' END, CASE WHEN ece > 0.12 THEN 'CALIBRATION' END, CASE WHEN low_batches = 2 THEN 'QUALITY' END, CASE WHEN top_share > 0.4 THEN 'ONE_MODE' END) AS reasons FROM x, l)
SELECT *, reasons <> '' AS retrain FROM r""")
def retrain_decision(spark, d):
    e = read(spark, d, "events")
    ok = (F.col("value") > 60).cast("int")
    batches = e.groupBy(F.col("ts").cast("date").alias("day")).agg(F.avg(ok).alias("success_rate"))
    return rounded(recon.retrain_decision(e, F.count_if(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")), batches, [F.desc("day")], F.abs(F.avg(F.col("value") / 100) - F.avg(ok)), F.avg((F.col("event_type") == "view").cast("int"))), 6)


@query("""WITH x AS (SELECT user_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT 'lag_at_group_start' AS contract, count(*) FILTER (l IS DISTINCT FROM g)::BIGINT AS differ, count(*)::BIGINT AS n_rows FROM x UNION ALL SELECT 'null_as_zero', count(*) FILTER (v IS DISTINCT FROM coalesce(v, 0)), count(*) FROM x""")
def divergence(spark, d):
    from pyspark.sql import Window

    e = read(spark, d, "events")
    lag = lambda k: F.lag("value").over(Window.partitionBy(k).orderBy("ts", "event_id"))
    x = e.select(lag("user_id").alias("l"), lag("event_type").alias("g"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("v"))
    return recon.divergence(x, {"lag_at_group_start": (F.col("l"), F.col("g")), "null_as_zero": (F.col("v"), F.coalesce("v", F.lit(0.0)))})


@query("""SELECT c_custkey, trim(regexp_replace(regexp_replace(upper(c_name), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name, nullif(right(regexp_replace('+1 (555) ' || c_custkey || '-0199', '[^0-9]', '', 'g'), 10), '') AS phone, CASE WHEN c_custkey % 4 > 0 THEN 'c' || c_custkey || '@example.org' END AS email, c_custkey || ' MAIN ST APT 4' AS address FROM customer""")
def standardize(spark, d):
    k = F.col("c_custkey").cast("string")
    df = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.concat(F.lit("+1 (555) "), k, F.lit("-0199")).alias("phone"), F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit(" C"), k, F.lit("@Example.org "))).otherwise("none").alias("email"), F.concat(k, F.lit(" Main Street,  Apartment 4")).alias("address"))
    return matching.standardize(df, ["name"], ["phone"], ["email"], ["address"])


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 100 = s_suppkey % 100 WHERE c_custkey % 3 > 0")
def exact_match(spark, d):
    key = lambda c: F.lpad((F.col(c) % 100).cast("string"), 4, "0").alias("phone")
    c = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("last"), F.when(F.col("c_custkey") % 3 > 0, key("c_custkey")).otherwise(" ").alias("phone"))
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("last"), key("s_suppkey"))
    return matching.exact_match(c, s, ["last", "phone"], "c_custkey", "s_suppkey")


@query("SELECT count(*)::BIGINT AS n_records, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders))::BIGINT AS matched, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders))::BIGINT AS unmatched, round(100.0 * count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) / count(*), 6) AS match_rate FROM customer")
def match_report(spark, d):
    pairs = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return rounded(matching.match_report(read(spark, d, "customer"), pairs, "c_custkey"), 6)


@query("""WITH RECURSIVE f AS (SELECT o_orderdate, min(o_custkey) AS dst FROM orders GROUP BY 1), e AS (SELECT DISTINCT o_custkey AS a, dst AS b FROM orders JOIN f USING (o_orderdate) WHERE o_custkey <> dst), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM u UNION (SELECT u.a, min(r.component) FROM r JOIN u ON r.node=u.b JOIN recurring.r AS o ON o.node=u.a GROUP BY u.a HAVING min(r.component) < min(o.component))),
c AS (SELECT coalesce(r.component, c_custkey) AS component, c_custkey, c_name, c_mktsegment FROM customer LEFT JOIN r ON r.node = c_custkey)
SELECT component, count(*)::BIGINT AS n_records, arg_min(c_name, c_custkey) FILTER (trim(c_name) <> '') AS c_name, arg_min(c_mktsegment, c_custkey) FILTER (trim(c_mktsegment) <> '') AS c_mktsegment FROM c GROUP BY 1""")
def golden_of_clusters(spark, d):
    """Clusters of matched pairs (customers that ordered on one day), and one golden record for each."""
    o = read(spark, d, "orders")
    first = o.groupBy("o_orderdate").agg(F.min("o_custkey").alias("dst"))
    pairs = o.join(first, "o_orderdate").select(F.col("o_custkey").alias("src"), "dst").where("src <> dst")
    labels = matching.components(pairs)
    c = read(spark, d, "customer")
    records = c.join(labels, c.c_custkey == labels.node, "left").withColumn("component", F.coalesce("component", "c_custkey"))
    return matching.golden(records, ["component"], [F.col("c_custkey")], ["c_name", "c_mktsegment"])


@query()
def dedup_jaccard(spark, d):
    df = read(spark, d, "documents").select("doc_id", F.split(F.lower("text"), r"\s+").alias("tokens"))
    return matching.dedup_jaccard(df, "doc_id", "tokens", 0.85)
