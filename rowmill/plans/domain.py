"""Scorecards, finance, trials, stock, surveys, models and operational reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog import query, read
from rowmill.functions import numbers as num
from rowmill.operators import agg, domain, models, ordered, rows, search
from rowmill.plans.summaries import rounded


@query("""WITH p AS (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 40 WHEN c_acctbal > 0 THEN 20 ELSE 0 END AS pts_balance, CASE WHEN c_mktsegment = 'BUILDING' THEN 15 ELSE 0 END AS pts_segment, c_nationkey FROM customer), t AS (SELECT *, pts_balance + pts_segment AS total FROM p)
SELECT c_custkey, pts_balance::INT AS pts_balance, pts_segment::INT AS pts_segment, total::INT AS total, CASE WHEN c_nationkey = 7 THEN 'DECLINE' WHEN total >= 40 THEN 'APPROVE' ELSE 'REFER' END AS decision, CASE WHEN c_nationkey = 7 THEN 'COUNTRY' ELSE 'SCORE' END AS reason FROM t""")
def points_scorecard(spark, d):
    b = F.col("c_acctbal")
    df = read(spark, d, "customer").withColumns(domain.points({"balance": [(b > 5000, 40), (b > 0, 20)], "segment": [(F.col("c_mktsegment") == "BUILDING", 15)]}))
    decision, reason = domain.override(F.when(F.col("total") >= 40, "APPROVE").otherwise("REFER"), [(F.col("c_nationkey") == 7, "DECLINE", "COUNTRY")])
    return df.select("c_custkey", "pts_balance", "pts_segment", "total", decision.alias("decision"), reason.alias("reason"))


@query("""WITH x AS (SELECT event_id, value / 100 AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 100) / 100.0::DOUBLE END AS b, CASE WHEN event_type = 'purchase' THEN 0.5 ELSE 0.0 END::DOUBLE AS lo FROM events), y AS (SELECT event_id, least(1.0, greatest(CASE WHEN b IS NULL THEN a ELSE 0.6 * a + 0.4 * b END, lo)) AS s FROM x)
SELECT event_id, round(s, 8) AS score, CASE WHEN s >= 0.8 THEN 'FRAUD' WHEN s >= 0.5 THEN 'ANALYST' ELSE 'NONE' END AS queue, CASE WHEN s >= 0.8 THEN 4 WHEN s >= 0.5 THEN 24 ELSE 0 END::INT AS sla_hours FROM y""")
def blended_routing(spark, d):
    k = F.col("event_id")
    floor = F.when(F.col("event_type") == "purchase", 0.5).otherwise(0.0)
    s = domain.blend(F.col("value") / 100, F.when(k % 5 != 0, (k % 100) / 100), 0.6, floor)
    df = read(spark, d, "events").select("event_id", s.alias("score"))
    return domain.route_alerts(df, "score", [(0.5, "ANALYST", 24), (0.8, "FRAUD", 4)], ("NONE", 0)).withColumn("score", F.round("score", 8))


@query("""WITH c AS (SELECT sum(c_acctbal + 1000) OVER (ORDER BY c_acctbal, c_custkey ROWS UNBOUNDED PRECEDING) / sum(c_acctbal + 1000) OVER () AS s, c_acctbal, c_custkey FROM customer), l AS (SELECT s, coalesce(lag(s) OVER (ORDER BY c_acctbal, c_custkey), 0) AS b FROM c)
SELECT count(*)::BIGINT AS n, round(1 - 2 * sum((s + b) / 2) / count(*), 8) AS gini, abs(1 - 2 * sum((s + b) / 2) / count(*) - 0.4) > 0.1 AS drift FROM l""")
def lorenz_gini(spark, d):
    df = read(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") + 1000).alias("v"))
    return rounded(domain.gini(df, "v", ["v", "c_custkey"], 0.4, 0.1), 8)


@query("SELECT o_orderkey, round(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 0.2 WHEN 'O' THEN 0.5 ELSE 1.0 END, 4) AS standardised FROM orders")
def rwa_standard(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.round(domain.rwa_standard(F.col("o_totalprice"), F.col("o_orderstatus"), {"F": 0.2, "O": 0.5}, 1.0), 4).alias("standardised"))


@query()
def rwa_internal(spark, d):
    """By the internal-ratings formula; tests hold it against the formula in plain Python."""
    pd = 0.001 + F.col("l_discount") / 5
    df = read(spark, d, "lineitem").groupBy(pd.alias("pd")).agg(F.sum("l_extendedprice").alias("exposure"))
    return df.select("pd", F.round(domain.rwa_internal(F.col("exposure"), F.col("pd"), F.lit(0.45)), 4).alias("rwa"))


@query("""WITH s AS (SELECT sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS t1, sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice ELSE 0 END) AS tot, sum(o_totalprice) * 2 AS r FROM orders)
SELECT 'tier1' AS ratio, round(100 * t1 / r, 6) AS pct, 30.0::DOUBLE AS minimum, 100 * t1 / r < 30 AS breach FROM s UNION ALL SELECT 'total', round(100 * tot / r, 6), 40.0, 100 * tot / r < 40 FROM s""")
def capital_ratios(spark, d):
    p, st = F.col("o_totalprice"), F.col("o_orderstatus")
    s = read(spark, d, "orders").agg(F.sum(F.when(st == "F", p).otherwise(0)).alias("t1"), F.sum(F.when(st != "P", p).otherwise(0)).alias("tot"), (F.sum(p) * 2).alias("r"))
    return rounded(domain.capital_ratios(s, {"tier1": "t1", "total": "tot"}, "r", {"tier1": 30.0, "total": 40.0}), 6)


@query("""WITH p AS (SELECT event_id AS purchase_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), t AS (SELECT p.purchase_id, p.value, e.event_type AS channel FROM p JOIN events e ON e.user_id = p.user_id AND e.event_type <> 'purchase' AND p.ts >= e.ts AND p.ts <= e.ts + INTERVAL 2 DAY),
s AS (SELECT channel, value / count(*) OVER (PARTITION BY purchase_id) AS c FROM t), a AS (SELECT channel, sum(c) AS attributed, count(*)::BIGINT AS touches FROM s GROUP BY 1), k AS (SELECT event_type AS channel, count(*) * 0.5::DOUBLE AS cost FROM events GROUP BY 1)
SELECT channel, round(attributed, 4) AS attributed, touches, round(cost, 4) AS cost, round((attributed - cost) / cost, 6) AS roi FROM a JOIN k USING (channel)""")
def touch_attribution(spark, d):
    from rowmill.operators import joins

    e = read(spark, d, "events")
    touches = e.where("event_type <> 'purchase'").select("user_id", F.col("ts").alias("touched"), F.col("event_type").alias("channel"))
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("purchase_id"), "value")
    cost = e.groupBy(F.col("event_type").alias("channel")).agg((F.count(F.lit(1)) * 0.5).alias("cost"))
    out = domain.touch_attribution(joins.window_join(touches, buys, "user_id", "touched", "bought", 2), "value", "channel", cost)
    return out.select("channel", F.round("attributed", 4).alias("attributed"), "touches", F.round("cost", 4).alias("cost"), F.round("roi", 6).alias("roi"))


@query("""WITH x AS (SELECT l_partkey, l_shipdate::DATE AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), s AS (SELECT l_partkey, avg(q) AS m, coalesce(stddev_samp(q), 0) AS sd, (l_partkey % 300)::BIGINT AS stock FROM x GROUP BY 1), y AS (SELECT *, 1.645 * sd * sqrt(4) AS ss FROM s)
SELECT l_partkey, round(ss, 6) AS safety_stock, round(m * 4 + ss, 6) AS reorder_point, round(stock / m, 6) AS days_of_supply, CASE WHEN stock <= 0 THEN 'OUT' WHEN stock < ss THEN 'CRITICAL' WHEN stock < m * 4 + ss THEN 'REORDER' ELSE 'OK' END AS stock_status FROM y""")
def inventory_status(spark, d):
    x = read(spark, d, "lineitem").groupBy("l_partkey", F.col("l_shipdate").cast("date").alias("d")).agg(F.sum("l_quantity").alias("q"))
    s = x.groupBy("l_partkey").agg(F.avg("q").alias("m"), F.stddev_samp("q").alias("sd")).withColumn("stock", F.col("l_partkey") % 300)
    return rounded(domain.inventory(s, "m", "sd", "stock", 4).drop("m", "sd", "stock"), 6)


@query("""WITH a AS (SELECT o_custkey, sum(o_totalprice) AS actual FROM orders GROUP BY 1), t AS (SELECT o_custkey, 100 * actual / nullif((o_custkey % 7) * 399989, 0) AS p FROM a), r AS (SELECT o_custkey, p, CASE WHEN p IS NULL THEN NULL ELSE rank() OVER (PARTITION BY p IS NULL ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 END AS rk, count(p) OVER () AS n FROM t)
SELECT o_custkey, round(p, 3) AS attained, CASE WHEN p >= 120 THEN 'STAR' WHEN p >= 100 THEN 'MET' WHEN p >= 80 THEN 'NEAR' WHEN p IS NOT NULL THEN 'BELOW' ELSE 'NO_QUOTA' END AS band, floor(rk * 4 / (n + 1))::BIGINT AS quartile FROM r""")
def quota_attainment(spark, d):
    a = read(spark, d, "orders").groupBy("o_custkey").agg(ordered.steady_sum("o_totalprice").alias("actual")).withColumn("quota", (F.col("o_custkey") % 7 * 399989).cast("double"))
    out = ordered.proc_rank(domain.attainment(a, "actual", "quota"), "attained", 4, "quartile")
    return out.select("o_custkey", F.round("attained", 3).alias("attained"), "band", "quartile")


@query("""WITH x AS (SELECT c_custkey, c_custkey % 5 + 1 AS a, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey % 5 + 1 END AS b, c_custkey % 3 + 1 AS c, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey % 5 END AS z FROM customer)
SELECT c_custkey, round((a + coalesce(6 - b, 0) + c) / (2.0 + (b IS NOT NULL)::INT), 6)::DOUBLE AS score, CASE WHEN z IS NULL THEN 'ATTRITION' WHEN z - c > 0.5 THEN 'IMPROVED' WHEN c - z > 0.5 THEN 'DECLINED' ELSE 'STABLE' END AS path FROM x""")
def survey_scores(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    x = read(spark, d, "customer").select("c_custkey", (k % 5 + 1).alias("a"), F.when(k % 4 != 0, n % 5 + 1).alias("b"), (k % 3 + 1).alias("c"), F.when(k % 11 != 0, n % 5).alias("z"))
    return x.select("c_custkey", F.round(domain.composite(["a", "b", "c"], ["b"], 5, 2), 6).alias("score"), domain.trajectory(F.col("c"), F.col("z"), 0.5).alias("path"))


@query("""WITH q AS (SELECT o_custkey, year(o_orderdate) * 10 + quarter(o_orderdate) AS quarter, count(*)::BIGINT AS n, sum(o_totalprice) AS total, max(o_totalprice) AS peak FROM orders GROUP BY 1, 2), j AS (SELECT q.*, total / nullif(c_acctbal, 0) AS u, c_acctbal AS credit_limit FROM q LEFT JOIN customer ON c_custkey = o_custkey)
SELECT o_custkey, quarter::INT AS quarter, n, round(total, 4) AS total, peak, credit_limit, round(u, 6) AS utilisation, round(60 * least(1.0, coalesce(u, 0)) + 40 * least(1.0, n / 10), 6) AS risk_score FROM j""")
def account_summary(spark, d):
    limit = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("credit_limit"))
    out = domain.account_summary(read(spark, d, "orders"), "o_custkey", F.year("o_orderdate") * 10 + F.quarter("o_orderdate"), "o_totalprice", limit)
    return out.withColumns({"total": F.round("total", 4), "utilisation": F.round("utilisation", 6), "risk_score": F.round("risk_score", 6)})


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, max((o_orderstatus = 'F')::INT) AS f, max((o_orderstatus = 'P')::INT) AS p FROM orders GROUP BY 1)
SELECT c_custkey, true AS itt, n IS NOT NULL AS safety, coalesce(n > 0 AND f = 1 AND p = 0, false) AS per_protocol FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def subject_flags(spark, d):
    st = F.col("o_orderstatus")
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max((st == "F").cast("int")).alias("f"), F.max((st == "P").cast("int")).alias("p"))
    df = read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return domain.subject_flags(df, F.col("n") > 0, F.col("f") == 1, F.col("p") == 1).select("c_custkey", "itt", "safety", "per_protocol")


@query("""WITH a AS (SELECT c_mktsegment, count(DISTINCT c_custkey)::BIGINT AS n_arm FROM customer GROUP BY 1), e AS (SELECT c_mktsegment, o_orderpriority, count(DISTINCT c_custkey)::BIGINT AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' GROUP BY 1, 2), g AS (SELECT c_mktsegment, n_arm, o_orderpriority FROM a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM e))
SELECT g.c_mktsegment, g.o_orderpriority, n_arm, coalesce(n, 0)::BIGINT AS n, round(100.0 * coalesce(n, 0) / n_arm, 6) AS rate FROM g LEFT JOIN e ON e.c_mktsegment = g.c_mktsegment AND e.o_orderpriority = g.o_orderpriority""")
def incidence_rates(spark, d):
    c = read(spark, d, "customer")
    e = read(spark, d, "orders").where("o_orderstatus = 'P'").join(c, F.col("c_custkey") == F.col("o_custkey"))
    return rounded(domain.incidence(e, c, "c_mktsegment", "o_orderpriority", "c_custkey"), 6)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE WHEN l_shipdate::DATE - o_orderdate::DATE >= 0 THEN l_shipdate::DATE - o_orderdate::DATE + 1 ELSE l_shipdate::DATE - o_orderdate::DATE END)::INT AS study_day, greatest(1, abs(l_shipdate::DATE - o_orderdate::DATE) + 1)::INT AS duration, l_shipdate::DATE >= o_orderdate::DATE AS emergent FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def event_days(spark, d):
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    a, b = F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", domain.study_day(a, b).alias("study_day"), F.greatest(F.lit(1), F.abs(F.date_diff(a, b)) + 1).alias("duration"), (a >= b).alias("emergent"))


@query("""WITH p AS (SELECT p_partkey, p_brand, p_retailprice * (1 + p_size / 100.0) * CASE WHEN p_size % 4 = 0 THEN 1.0 ELSE 0.9 END AS raw, avg(p_retailprice) OVER (PARTITION BY p_brand) AS market FROM part), q AS (SELECT *, least(1500.0, greatest(900.0, raw)) AS premium FROM p)
SELECT p_partkey, round(premium, 4) AS premium, CASE WHEN premium > 1.1 * market THEN 'ABOVE' WHEN premium < 0.9 * market THEN 'BELOW' ELSE 'AT_MARKET' END AS position FROM q""")
def premium_position(spark, d):
    s = F.col("p_size")
    df = agg.remerge(read(spark, d, "part"), ["p_brand"], {"market": F.avg("p_retailprice")})
    p = domain.premium(F.col("p_retailprice"), [1 + s / 100, F.when(s % 4 != 0, 0.9)], 900.0, 1500.0, F.col("market"))
    return df.select("p_partkey", F.round(p["premium"], 4).alias("premium"), p["position"].alias("position"))


@query("""WITH m AS (SELECT o_orderpriority, sum(o_totalprice) FILTER (year(o_orderdate) = 1997) AS a, sum(o_totalprice) FILTER (year(o_orderdate) = 1996) AS b FROM orders GROUP BY 1)
SELECT o_orderpriority, round(a - b, 4) AS variance, round(100 * (a - b) / abs(b), 6) AS variance_pct, CASE WHEN b IS NULL OR b = 0 OR a IS NULL THEN 'NONE' WHEN abs(100 * (a - b) / abs(b)) <= 5 THEN 'GREEN' WHEN abs(100 * (a - b) / abs(b)) <= 10 THEN 'AMBER' ELSE 'RED' END AS light FROM m""")
def budget_variance(spark, d):
    at = lambda y: F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")))
    m = read(spark, d, "orders").groupBy("o_orderpriority").agg(at(1997).alias("a"), at(1996).alias("b"))
    v = domain.variance(F.col("a"), F.col("b"))
    return m.select("o_orderpriority", F.round(v["variance"], 4).alias("variance"), F.round(v["variance_pct"], 6).alias("variance_pct"), v["light"].alias("light"))


@query("""SELECT l_suppkey, count(*)::BIGINT AS frequency, round(avg(l_extendedprice), 4) AS severity, round(sum(CASE WHEN l_extendedprice > 80000 THEN l_extendedprice ELSE 0 END), 4) AS catastrophe, round(sum(CASE WHEN l_extendedprice > 80000 THEN 0 ELSE l_extendedprice END), 4) AS attritional,
 round((count(*) FILTER (l_returnflag = 'R') * 0.7 + count(*) FILTER (l_returnflag = 'A') * 0.3) / count(*), 6) AS peril_score, round(ln(1 + count(*)) * ln(1 + greatest(avg(l_extendedprice), 0)), 6) AS score FROM lineitem GROUP BY 1""")
def claim_scores(spark, d):
    flag = F.col("l_returnflag")
    out = domain.claim_scores(read(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", F.col("l_extendedprice") > 80000, {"theft": (flag == "R", 0.7), "water": (flag == "A", 0.3)})
    return out.withColumns({c: F.round(c, 4) for c in ("severity", "catastrophe", "attritional")} | {c: F.round(c, 6) for c in ("peril_score", "score")})


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'ASSETS' WHEN o_orderpriority = '1-URGENT' THEN 'LIABILITIES' ELSE 'EQUITY' END AS section, round(sum(o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END), 2) AS net, count(DISTINCT o_custkey)::BIGINT AS accounts FROM orders GROUP BY 1""")
def balance_sheet(spark, d):
    st = F.col("o_orderstatus")
    out = domain.balance_sheet(read(spark, d, "orders"), "o_custkey", "o_totalprice", [(st == "F", "ASSETS", 1), (F.col("o_orderpriority") == "1-URGENT", "LIABILITIES", -1), (F.lit(True), "EQUITY", -1)])
    return rounded(out, 2)


@query("""SELECT term, round(v, 4) AS coefficient FROM (SELECT 'intercept' AS term, regr_intercept(l_extendedprice, l_quantity) AS v FROM lineitem UNION ALL SELECT 'l_quantity', regr_slope(l_extendedprice, l_quantity) FROM lineitem)""")
def regression_terms(spark, d):
    """Stepwise over one candidate: the line itself where it enters."""
    out = models.stepwise(read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], 1.0, 1.0)
    return out.select("term", F.round("coefficient", 4).alias("coefficient"))


@query()
def stepwise_selection(spark, d):
    li = read(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") + 5000 * F.col("l_discount"))
    return models.stepwise(li, "y", ["l_quantity", "l_discount", "l_tax", "l_linenumber"])


@query()
def logistic_odds(spark, d):
    return models.proc_logistic(read(spark, d, "lineitem"), F.col("l_returnflag") == "R", ["l_quantity", "l_discount"], ["l_linestatus"])


@query()
def entropy_tree(spark, d):
    return models.proc_tree(read(spark, d, "lineitem"), F.col("l_returnflag") == "R", ["l_quantity", "l_discount"], ["l_linestatus"])


@query()
def ancova_means(spark, d):
    return rounded(models.ancova(read(spark, d, "customer").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")), "c_acctbal", "c_mktsegment", ["n_regionkey"]), 6)


@query()
def calibrated_score(spark, d):
    """A logistic score, Platt's calibration of it, and the calibration error of both."""
    li = read(spark, d, "lineitem").withColumn("raw", 4 * F.col("l_discount"))
    p = models.calibrated(li, "raw", F.col("l_returnflag") == "R")
    y = (F.col("l_returnflag") == "R").cast("double")
    return p.agg(F.round(F.abs(F.avg("raw") - F.avg(y)), 6).alias("raw_gap"), F.round(F.abs(F.avg("probability") - F.avg(y)), 6).alias("calibrated_gap"), F.count(F.lit(1)).alias("n"))


COST = """c AS (SELECT event_type, ts, event_id % 1000 / 1000.0 * CASE event_type WHEN 'view' THEN 0.5 WHEN 'click' THEN 1.5 WHEN 'purchase' THEN 3.0 ELSE 0 END AS cost FROM events), l AS (SELECT * FROM c WHERE ts::DATE > DATE '2024-01-30' - 10 AND ts::DATE <= DATE '2024-01-30')"""


@query(f"WITH {COST} SELECT 'model' AS kind, event_type AS item, count(*)::BIGINT AS n, round(sum(cost), 6)::DOUBLE AS cost FROM l GROUP BY 2 UNION ALL SELECT 'day', ts::DATE::VARCHAR, count(*), round(sum(cost), 6) FROM l GROUP BY 2 UNION ALL SELECT 'total', 'ALL', count(*), round(sum(cost), 6) FROM l")
def cost_summary(spark, d):
    rates = read(spark, d, "events").where("event_type in ('view', 'click', 'purchase')").groupBy("event_type").agg(F.max(F.when(F.col("event_type") == "view", 0.5).when(F.col("event_type") == "click", 1.5).otherwise(3.0)).alias("rate"))
    e = domain.estimate_cost(read(spark, d, "events").withColumn("tokens", F.col("event_id") % 1000), rates, "event_type", "tokens")
    return rounded(domain.cost_summary(e, "ts", "event_type", "2024-01-30", 10), 6)


@query("SELECT event_type, count(*)::BIGINT AS n, round(avg((value > 50)::INT), 8) AS accuracy FROM events GROUP BY 1")
def mode_accuracy(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") > 50).cast("int")), 8).alias("accuracy"))


@query("""WITH q AS (SELECT o_orderkey, o_orderstatus AS status, o_orderdate AS updated FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50), s AS (SELECT l_orderkey, arg_min(l_shipmode, l_linenumber) AS f FROM (SELECT l_orderkey, min(l_returnflag) AS l_shipmode, l_linenumber FROM lineitem WHERE l_discount > 0.07 GROUP BY ALL) GROUP BY 1)
SELECT o_orderkey, status, updated, f AS failed_stage FROM q LEFT JOIN s ON l_orderkey = o_orderkey""")
def error_queue(spark, d):
    items = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated"))
    stages = read(spark, d, "lineitem").where("l_discount > 0.07").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("stage_no")).agg(F.min("l_returnflag").alias("stage"), F.lit(False).alias("ok"))
    return domain.error_queue(items, stages, "o_orderkey", ["F", "P"])


REPORT = "count(*)::BIGINT AS n, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS n_f, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS n_o, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS pct"


@query(f"SELECT o_custkey, {REPORT} FROM orders GROUP BY 1")
def file_report(spark, d):
    return rounded(domain.report_by(read(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O"]), 6)


@query(f"SELECT o_orderpriority, {REPORT} FROM orders GROUP BY 1")
def regression_report(spark, d):
    return rounded(domain.report_by(read(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O"]), 6)


@query("SELECT coalesce(source, 'ALL') AS source, count(*)::BIGINT AS n, count(DISTINCT lang)::BIGINT AS languages FROM documents GROUP BY ROLLUP (source)")
def coverage(spark, d):
    return read(spark, d, "documents").rollup("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("languages")).withColumn("source", F.coalesce("source", F.lit("ALL")))


@query("SELECT user_id, event_id, row_number() OVER (ORDER BY ts, event_id)::INT AS version FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def change_history(spark, d):
    e = read(spark, d, "events")
    return domain.history(e, "user_id", e.agg(F.min("user_id")).head()[0], ["ts", "event_id"]).select("user_id", "event_id", "version")


@query("""WITH v AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders), l AS (SELECT min(o_custkey) AS k FROM orders)
SELECT o_orderkey, version::INT AS version, CASE WHEN o_custkey = k THEN version = 2 ELSE version = max(version) OVER (PARTITION BY o_custkey) END AS is_current FROM v, l""")
def version_rollback(spark, d):
    o = read(spark, d, "orders")
    v = o.withColumn("version", F.row_number().over(ordered.win(["o_custkey"], ["o_orderdate", "o_orderkey"])))
    return domain.rollback(v, "o_custkey", "version", {o.agg(F.min("o_custkey")).head()[0]: 2}).select("o_orderkey", "version", "is_current")


@query("SELECT event_id, coalesce(c >= 0.7, false) AS accepted, CASE WHEN c >= 0.7 THEN 'ACCEPTED' WHEN c IS NULL THEN 'NO_CONFIDENCE' ELSE 'LOW_CONFIDENCE' END AS reason FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / 100 END AS c FROM events)")
def ingest_feedback(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 13 != 0, F.col("value") / 100).alias("c"))
    return domain.ingest_feedback(e, "c", 0.7).drop("c")


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, round(avg(o_totalprice), 6) AS mean FROM orders WHERE o_totalprice > 50000 GROUP BY 1")
def table_macro(spark, d):
    """One parameterised transform, filled in and applied."""
    big = models.macro(lambda df, var, low, by: df.where(F.col(var) > low).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(var).alias("mean")), var="o_totalprice", low=50000, by="o_orderpriority")
    return rounded(read(spark, d, "orders").transform(big), 6)


@query("SELECT p_partkey, k::INT AS k, p_retailprice * k AS price FROM part, (SELECT unnest(range(1, 4)) AS k) WHERE k <= p_size % 4")
def expand_rows(spark, d):
    """Several rows a row, as many as its data asks for."""
    p = read(spark, d, "part").where("p_size % 4 > 0")
    return p.select("p_partkey", "p_retailprice", F.explode(F.sequence(F.lit(1), F.col("p_size") % 4)).alias("k")).select("p_partkey", "k", (F.col("p_retailprice") * F.col("k")).alias("price"))


@query("""WITH x AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT user_id, round(sum(CASE WHEN n % 2 = 1 THEN value ELSE -value END), 6) AS alternating FROM x GROUP BY 1""")
def grouped_python(spark, d):
    """A fold over each user's rows in Python; a user's events fit one task."""

    def fold(rows):
        import pandas as pd

        v = rows.sort_values(["ts", "event_id"])["value"].to_numpy()
        return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "alternating": [round(float(v[::2].sum() - v[1::2].sum()), 6)]})

    return domain.grouped(read(spark, d, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], fold, "user_id long, alternating double")


@query()
def adversarial_rows(spark, d):
    return domain.adversarial(read(spark, d, "orders"), "o_orderkey")


@query("""SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR || ':11'), 1, 6))::BIGINT % 100 < 70 THEN 'TRAIN' ELSE 'VALID' END AS part FROM labels""")
def partition_by_percent(spark, d):
    return search.hash_split(read(spark, d, "labels"), "doc_id", 70, 11).select("doc_id", "part")


@query("SELECT l_returnflag, round(avg(l_discount), 8) AS mean, round(avg(l_discount) - 1.645 * stddev_samp(l_discount), 8) AS var_95 FROM lineitem GROUP BY 1")
def parametric_var(spark, d):
    """The 5 % quantile by the normal law; the quantile is the one of three digits."""
    z = F.round(num.probit(F.lit(0.95)), 3)
    s = read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("mean"), F.stddev_samp("l_discount").alias("sd"))
    return rounded(s.select("l_returnflag", "mean", (F.col("mean") - z * F.col("sd")).alias("var_95")), 8)


@query("SELECT c_mktsegment, c_custkey FROM customer WHERE (c_acctbal IS NULL OR c_acctbal < 0) AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def where_compound(spark, d):
    return read(spark, d, "customer").where(rows.sas_cmp(F.col("c_acctbal"), "<", 0) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_mktsegment", "c_custkey")
