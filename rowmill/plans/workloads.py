"""Queries of matching, graph components and domain workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog import query, read
from rowmill.operators import fuzzy, matching, workloads
from rowmill.plans.summaries import rounded

END = "2001-08-01"


@query("""WITH RECURSIVE e AS (SELECT 'O'||o_orderkey AS a, 'C'||o_custkey AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM u UNION (SELECT u.a, min(r.component) FROM r JOIN u ON r.node=u.b JOIN recurring.r AS o ON o.node=u.a GROUP BY u.a HAVING min(r.component) < min(o.component))) SELECT node, component FROM r""")
def graph_components(spark, d):
    """Orders and customers: many components, one of each customer with orders."""
    o = read(spark, d, "orders")
    return matching.components(o.select(F.concat(F.lit("O"), "o_orderkey").alias("src"), F.concat(F.lit("C"), "o_custkey").alias("dst")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'P'||l_partkey AS a, 'S'||l_suppkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM u UNION (SELECT u.a, min(r.component) FROM r JOIN u ON r.node=u.b JOIN recurring.r AS o ON o.node=u.a GROUP BY u.a HAVING min(r.component) < min(o.component))) SELECT node, component FROM r""")
def graph_components_all(spark, d):
    pairs = read(spark, d, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"))
    return matching.components(pairs)


@query("""WITH p AS (SELECT c_custkey, s_suppkey, c_name, s_name, c_acctbal, s_acctbal FROM customer JOIN supplier ON c_nationkey=s_nationkey AND right(c_name,1)=right(s_name,1)),
s AS (SELECT c_custkey, s_suppkey, (0.6*list_sum(list_transform(range(1,least(length(c_name),length(s_name))+1), lambda i: CASE WHEN substr(c_name,i,1)=substr(s_name,i,1) THEN 1 ELSE 0 END))/greatest(length(c_name),length(s_name)) + 0.4*CASE WHEN (c_acctbal > 0)=(s_acctbal > 0) THEN 1 ELSE 0 END)/(0.6+0.4) AS score FROM p)
SELECT c_custkey, s_suppkey, round(score,6) AS score, CASE WHEN score >= 0.6 THEN 'FUZZY' ELSE 'REVIEW' END AS status FROM s WHERE score >= 0.45""")
def fuzzy_match(spark, d):
    last = lambda c: F.expr(f"right({c}, 1)").alias("last")
    c = read(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_acctbal") > 0).alias("c_up"), F.col("c_nationkey").alias("nation"), last("c_name"))
    s = read(spark, d, "supplier").select("s_suppkey", "s_name", (F.col("s_acctbal") > 0).alias("s_up"), F.col("s_nationkey").alias("nation"), last("s_name"))
    same = (F.col("c_up") == F.col("s_up")).cast("int")
    out = fuzzy.match_blocks(c, s, "c_custkey", "c_name", "s_suppkey", "s_name", ["nation", "last"], [(0.4, same)], 0.6, 0.6, 0.45)
    return rounded(out.select("c_custkey", "s_suppkey", "score", "status"), 6)


@query("""WITH s AS (SELECT c_custkey, s_suppkey, list_sum(list_transform(range(1,least(length(c_name),length(s_name))+1), lambda i: CASE WHEN substr(c_name,i,1)=substr(s_name,i,1) THEN 1 ELSE 0 END))/greatest(length(c_name),length(s_name)) AS overlap, (c_acctbal > 0)=(s_acctbal > 0) AS same FROM customer, supplier)
SELECT c_custkey, s_suppkey, round(overlap,6) AS overlap, round(0.6*overlap + 0.4*same::INT,6) AS score, CASE WHEN 0.6*overlap + 0.4*same::INT >= 0.82 THEN 'FUZZY' ELSE 'REVIEW' END AS status FROM s WHERE 0.6*overlap + 0.4*same::INT >= 0.79""")
def name_match(spark, d):
    """Customers and suppliers of like names and the same sign of balance, over all pairs, without forming them."""
    c, s = read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), read(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    same = ((F.col("c_acctbal") > 0) == (F.col("s_acctbal") > 0)).cast("int")
    out = fuzzy.match_names(c, s, "c_custkey", "c_name", "s_suppkey", "s_name", [(0.4, same)], 0.6, 0.82, 0.79)
    return rounded(out.select("c_custkey", "s_suppkey", "overlap", "score", "status"), 6)


@query("""SELECT o_orderkey, match_id, round(gap,4) AS gap FROM (SELECT t.o_orderkey, c.o_orderkey AS match_id, abs(t.o_totalprice-c.o_totalprice) AS gap, row_number() OVER (PARTITION BY t.o_orderkey ORDER BY abs(t.o_totalprice-c.o_totalprice), c.o_orderkey) n FROM orders t JOIN orders c ON t.o_custkey=c.o_custkey WHERE t.o_orderstatus='F' AND c.o_orderstatus='O') WHERE n=1""")
def nearest_match(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return rounded(matching.nearest_match(o.where("o_orderstatus='F'"), o.where("o_orderstatus='O'"), ["o_custkey"], "o_totalprice", "o_orderkey", "o_orderkey"))


@query("""SELECT c_nationkey, c_mktsegment, count(*)::BIGINT AS n_records, arg_min(c_name, (-c_acctbal, c_custkey)) FILTER (c_name IS NOT NULL) AS c_name, arg_min(phone, (-c_acctbal, c_custkey)) FILTER (phone <> '') AS phone FROM (SELECT *, CASE WHEN c_acctbal < 5000 THEN c_custkey::VARCHAR ELSE '' END AS phone FROM customer) GROUP BY 1,2""")
def golden_record(spark, d):
    c = read(spark, d, "customer").withColumn("phone", F.when(F.col("c_acctbal") < 5000, F.col("c_custkey").cast("string")).otherwise(""))
    return matching.golden(c, ["c_nationkey", "c_mktsegment"], [-F.col("c_acctbal"), F.col("c_custkey")], ["c_name", "phone"])


@query("SELECT c_nationkey, c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey)::INT AS seq FROM customer")
def golden_xref(spark, d):
    return matching.xref(read(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("""SELECT p_partkey, round(len(list_intersect(a,b))/len(list_distinct(list_concat(a,b))),6) AS similarity FROM (SELECT p_partkey, string_split(lower(p_name),' ') AS a, string_split(lower(p_type),' ') AS b FROM part)""")
def token_jaccard(spark, d):
    return rounded(read(spark, d, "part").select("p_partkey", matching.jaccard(F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")).alias("similarity")), 6)


@query("""SELECT l_returnflag, l_linestatus, round(actual,2) AS actual, round(expected,2) AS expected, round(actual/expected,6) AS ratio, CASE WHEN actual/expected < 0.9 THEN 'LOW' WHEN actual/expected > 1.1 THEN 'HIGH' ELSE 'OK' END AS alert FROM (SELECT l_returnflag, l_linestatus, sum(l_extendedprice) AS actual, sum(l_quantity*p_retailprice) AS expected FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2)""")
def actual_vs_expected(spark, d):
    j = read(spark, d, "lineitem").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    out = workloads.actual_vs_expected(j.withColumn("e", F.col("l_quantity") * F.col("p_retailprice")), ["l_returnflag", "l_linestatus"], "l_extendedprice", "e")
    return rounded(rounded(out, 2, ("ratio",)), 6, ("actual", "expected"))


YEARLY = "SELECT o_orderpriority, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1,2"


def yearly(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))


@query(f"SELECT o_orderpriority, y::INT AS y, round(v,2) AS v, round((v-lag(v,3) OVER (PARTITION BY o_orderpriority ORDER BY y))/3,2) AS slope FROM ({YEARLY})")
def trend_slope(spark, d):
    return rounded(workloads.trend(yearly(spark, d), ["o_orderpriority"], "y", "v", 3), 2)


DAILY = "SELECT event_type, ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1,2"
RETURNS = f"SELECT event_type, day, v/lag(v) OVER (PARTITION BY event_type ORDER BY day)-1 AS simple FROM ({DAILY})"


def daily_returns(spark, d):
    v = read(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return workloads.returns(v, ["event_type"], "day", "v", 0.2)


@query(f"SELECT event_type, day, round(simple,6) AS simple, round(ln(1+simple),6) AS log_return, coalesce(abs(simple) > 0.2, false) AS extreme FROM ({RETURNS})")
def series_returns(spark, d):
    return rounded(daily_returns(spark, d).drop("v"), 6)


@query(f"""WITH r AS (SELECT event_type, simple FROM ({RETURNS}) WHERE simple IS NOT NULL), q AS (SELECT event_type, quantile_cont(simple,0.1) AS q FROM r GROUP BY 1)
SELECT event_type, round(-q,6) AS var, round(-avg(simple),6) AS cvar, count(*)::BIGINT AS n_tail FROM r JOIN q USING (event_type) WHERE simple <= q GROUP BY event_type, q""")
def historical_var(spark, d):
    return rounded(workloads.historical_var(daily_returns(spark, d).where("simple is not null"), ["event_type"], "simple", 0.9), 6)


@query("""WITH l AS (SELECT p_brand, l_extendedprice AS v, l_discount AS r, l_returnflag AS f FROM lineitem JOIN part ON l_partkey=p_partkey),
p AS (SELECT p_brand, sum(v)/(SELECT sum(v) FROM l WHERE f='R') AS w, avg(r) AS r FROM l WHERE f='R' GROUP BY 1), b AS (SELECT p_brand, sum(v)/(SELECT sum(v) FROM l) AS w, avg(r) AS r FROM l GROUP BY 1),
j AS (SELECT b.p_brand, coalesce(p.w,0) AS wp, coalesce(p.r,0) AS rp, b.w AS wb, b.r AS rb, sum(b.w*b.r) OVER () AS t FROM b LEFT JOIN p USING (p_brand))
SELECT p_brand, round((wp-wb)*(rb-t),9) AS allocation, round(wb*(rp-rb),9) AS selection, round((wp-wb)*(rp-rb),9) AS interaction FROM j""")
def return_attribution(spark, d):
    from pyspark.sql import Window

    j = read(spark, d, "lineitem").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    side = lambda df: df.groupBy("p_brand").agg(F.sum("l_extendedprice").alias("v"), F.avg("l_discount").alias("r")).withColumn("w", F.col("v") / F.sum("v").over(Window.partitionBy()))
    return rounded(workloads.attribution(side(j.where("l_returnflag='R'")), side(j), "p_brand"), 9)


@query("""SELECT c_mktsegment, scenario, q::INT AS quarter, round(v*pow(1+shock,q),2) AS projected FROM (SELECT c_mktsegment, sum(c_acctbal) AS v FROM customer GROUP BY 1) CROSS JOIN (VALUES ('base',0.0),('adverse',-0.05),('severe',-0.12)) s(scenario, shock) CROSS JOIN range(1,9) t(q)""")
def stress_projection(spark, d):
    base = read(spark, d, "customer").groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("v"))
    return rounded(workloads.stress(base, "v", {"base": 0.0, "adverse": -0.05, "severe": -0.12}, 8).drop("v"), 2)


@query("""SELECT l_suppkey, count(*)::BIGINT AS n_lines, round(sum(l_extendedprice),2) AS spend, round(100.0*count(*) FILTER (l_returnflag <> 'R')/count(*),4) AS quality_pct, round(100.0*count(*) FILTER (date_diff('day', o_orderdate::DATE, l_shipdate::DATE) <= 60)/count(*),4) AS on_time_pct FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1 HAVING count(*) >= 20""")
def supplier_scorecard(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    n = F.count(F.lit(1))
    g = read(spark, d, "lineitem").join(o, "l_orderkey").groupBy("l_suppkey").agg(n.alias("n_lines"), F.sum("l_extendedprice").alias("spend"), (100 * F.count_if(F.col("l_returnflag") != "R") / n).alias("quality_pct"), (100 * F.count_if(F.date_diff("l_shipdate", "o_orderdate") <= 60) / n).alias("on_time_pct"))
    return rounded(rounded(g.where("n_lines >= 20"), 2, ("quality_pct", "on_time_pct")), 4, ("spend",))


@query("""SELECT o_orderkey, year(s)::INT AS fiscal_year, quarter(s)::INT AS fiscal_quarter, day(last_day(o_orderdate::DATE))::INT AS days_in_month, round(o_totalprice/day(last_day(o_orderdate::DATE)),4) AS per_day FROM (SELECT *, (o_orderdate::DATE + INTERVAL 6 MONTH) AS s FROM orders)""")
def fiscal_calendar(spark, d):
    return rounded(workloads.fiscal(read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate", "o_totalprice").drop("o_orderdate", "o_totalprice"))


@query("SELECT o_custkey, " + ", ".join(f"count(*) FILTER (age >= 0 AND age < {n})::BIGINT AS n_{n}, round(coalesce(sum(o_totalprice) FILTER (age >= 0 AND age < {n}),0),2) AS sum_{n}" for n in (30, 90, 180, 365)) + f" FROM (SELECT *, date_diff('day', o_orderdate::DATE, DATE '{END}') AS age FROM orders) GROUP BY 1")
def window_features(spark, d):
    return rounded(workloads.window_features(read(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", END, [30, 90, 180, 365]), 2)


@query(f"""SELECT bucket, count(*)::BIGINT AS n, round(sum(o_totalprice),2) AS amount, max(late)::INT AS oldest FROM (SELECT o_totalprice, late, CASE WHEN late <= 0 THEN 'CURRENT' WHEN late <= 30 THEN '1-30' WHEN late <= 60 THEN '31-60' WHEN late <= 90 THEN '61-90' ELSE '90+' END AS bucket FROM (SELECT o_totalprice, date_diff('day', (o_orderdate + INTERVAL 30 DAY)::DATE, DATE '{END}') AS late FROM orders)) GROUP BY 1""")
def receivable_aging(spark, d):
    o = read(spark, d, "orders").withColumn("due", F.date_add("o_orderdate", 30))
    return rounded(workloads.aging(o, "due", END).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("amount"), F.max("days_past_due").alias("oldest")), 2)


@query(f"""SELECT o_orderkey, age::INT AS age_months, round(o_totalprice*(1-least(age,60)/60.0),4) AS straight_line, round(o_totalprice*pow(1-2.0/60,age),4) AS declining FROM (SELECT *, greatest(date_diff('month', o_orderdate::DATE, DATE '{END}'),0) AS age FROM orders)""")
def depreciation_schedule(spark, d):
    return rounded(workloads.depreciation(read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_totalprice", "o_orderdate", END, 60).drop("o_orderdate", "o_totalprice"), 4)


@query("SELECT year(o_orderdate)::INT AS y, o_orderstatus, " + ", ".join(f"round(sum(o_totalprice) FILTER (quarter(o_orderdate)={q}),2) AS q{q}" for q in (1, 2, 3, 4)) + ", round(sum(o_totalprice),2) AS total FROM orders GROUP BY 1,2")
def period_columns(spark, d):
    return rounded(workloads.period_columns(read(spark, d, "orders"), [F.year("o_orderdate").alias("y"), F.col("o_orderstatus")], F.quarter("o_orderdate"), "o_totalprice", {f"q{q}": q for q in (1, 2, 3, 4)}), 2)


@query("""WITH s AS (SELECT o_custkey, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders GROUP BY 1), t AS (SELECT count(*) FILTER (s < DATE '1998-01-01' AND e >= DATE '1998-01-01')::BIGINT AS opening, count(*) FILTER (s <= DATE '1999-12-31' AND e > DATE '1999-12-31')::BIGINT AS closing, count(*) FILTER (s BETWEEN DATE '1998-01-01' AND DATE '1999-12-31')::BIGINT AS joiners, count(*) FILTER (e BETWEEN DATE '1998-01-01' AND DATE '1999-12-31')::BIGINT AS leavers FROM s) SELECT *, round(100.0*leavers/((opening+closing)/2.0),4) AS rate_pct FROM t""")
def customer_turnover(spark, d):
    spells = read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("e"))
    return rounded(workloads.turnover(spells, "1998-01-01", "1999-12-31", "s", "e"))


@query(f"""SELECT o_custkey, entry, event_date, event_date IS NULL AS censored, date_diff('day', entry, coalesce(event_date, DATE '{END}'))::INT AS days FROM (SELECT o_custkey, min(o_orderdate)::DATE AS entry, (min(o_orderdate) FILTER (o_orderstatus='P'))::DATE AS event_date FROM orders GROUP BY 1)""")
def cohort_followup(spark, d):
    return workloads.followup(read(spark, d, "orders"), "o_custkey", "o_orderdate", F.col("o_orderstatus") == "P", END)


@query(f"""WITH f AS (SELECT o_custkey, min(o_orderdate)::DATE AS entry, (min(o_orderdate) FILTER (o_orderstatus='P'))::DATE AS event_date FROM orders GROUP BY 1), x AS (SELECT o_custkey, event_date IS NULL AS censored, date_diff('day', entry, coalesce(event_date, DATE '{END}')) AS days FROM f)
SELECT o_custkey, round(CASE WHEN days > 0 THEN (NOT censored)::INT / (days / 365.25) END, 6) AS hazard_rate, CASE WHEN NOT censored AND days <= 90 THEN 'HIGH' WHEN NOT censored THEN 'MODERATE' ELSE 'CENSORED' END AS risk FROM x""")
def hazard_indicators(spark, d):
    f = workloads.followup(read(spark, d, "orders"), "o_custkey", "o_orderdate", F.col("o_orderstatus") == "P", END)
    return rounded(workloads.hazard(f).select("o_custkey", "hazard_rate", "risk"), 6)


@query("""WITH p AS (SELECT c_nationkey, sum(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT c_nationkey, round(v / (SELECT sum(v) FROM p), 8) AS weight, CASE WHEN v / (SELECT sum(v) FROM p) >= 0.05 THEN 'LARGE' WHEN v / (SELECT sum(v) FROM p) >= 0.02 THEN 'MEDIUM' ELSE 'SMALL' END AS position FROM p""")
def position_weights(spark, d):
    j = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    held = j.groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("v"))
    return rounded(workloads.weights(held, "v").drop("v"), 8)


@query("SELECT CASE WHEN contains(lower(text),'error') THEN 'error' WHEN contains(lower(text),'the') THEN 'article' WHEN contains(lower(text),'ing') THEN 'suffix' ELSE 'other' END AS category, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def failure_categories(spark, d):
    return workloads.failure_categories(read(spark, d, "documents"), "text", {"error": "error", "article": "the", "suffix": "ing"})


@query("SELECT ts::DATE AS day, " + ", ".join(f"round(avg(value) FILTER (event_type='{t}'),6) AS {t}" for t in ("click", "view", "purchase")) + " FROM events GROUP BY 1")
def run_matrix(spark, d):
    return rounded(workloads.run_matrix(read(spark, d, "events"), F.to_date("ts").alias("day"), "event_type", "value", ["click", "view", "purchase"]), 6)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_events(spark, d):
    return workloads.newest(read(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["ts", "event_id"], 50).drop("ts")


@query("SELECT l_returnflag, regr_count(l_extendedprice,l_quantity)::BIGINT AS n, round(regr_slope(l_extendedprice,l_quantity),4) AS slope, round(regr_intercept(l_extendedprice,l_quantity),4) AS intercept, round(regr_r2(l_extendedprice,l_quantity),4) AS r2 FROM lineitem GROUP BY 1")
def regression_line(spark, d):
    return rounded(workloads.regression(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity"))
