"""Class summaries, frequencies, derivations and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog import query, read
from rowmill.functions import dates, text
from rowmill.functions import numbers as num
from rowmill.operators import agg, rows


def rounded(df, digits=4, skip=()):
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double" and c not in skip})


@query("""
SELECT l_returnflag, l_linestatus, 3::BIGINT AS _type_, count(*)::BIGINT AS _freq_,
 count(l_quantity)::BIGINT AS l_quantity_n, round(sum(l_quantity),4) AS l_quantity_sum, round(avg(l_quantity),4) AS l_quantity_mean, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max
FROM lineitem GROUP BY 1,2""")
def means_class(spark, d):
    return rounded(agg.proc_means(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"], ("n", "sum", "mean", "min", "max")))


@query("""
SELECT l_returnflag, l_linestatus, (3 - grouping(l_returnflag, l_linestatus))::BIGINT AS _type_, count(*)::BIGINT AS _freq_, round(avg(l_discount),9) AS l_discount_mean
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def means_cube(spark, d):
    return rounded(agg.proc_means(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_discount"], ("mean",), nway=False), 9)


@query("""
SELECT o_orderpriority, 1::BIGINT AS _type_, count(*)::BIGINT AS _freq_, round(stddev_samp(o_totalprice),6) AS o_totalprice_std, round(stddev_samp(o_totalprice)/sqrt(count(*)),6) AS o_totalprice_stderr,
 round(quantile_cont(o_totalprice,0.5),6) AS o_totalprice_median, round(quantile_cont(o_totalprice,0.05),6) AS o_totalprice_p5, round(quantile_cont(o_totalprice,0.95),6) AS o_totalprice_p95
FROM orders GROUP BY 1""")
def means_quantiles(spark, d):
    return rounded(agg.proc_means(read(spark, d, "orders"), ["o_orderpriority"], ["o_totalprice"], ("std", "stderr", "median", "p5", "p95")), 6)


@query("""
SELECT o_orderstatus, count(*)::BIGINT AS count, round(100.0*count(*)/sum(count(*)) OVER (),2) AS percent FROM orders GROUP BY 1""")
def freq_oneway(spark, d):
    return agg.proc_freq(read(spark, d, "orders"), "o_orderstatus")


@query("""
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS count FROM orders GROUP BY 1,2)
SELECT *, round(100.0*count/sum(count) OVER (),4) AS total_pct, round(100.0*count/sum(count) OVER (PARTITION BY o_orderstatus),4) AS row_pct, round(100.0*count/sum(count) OVER (PARTITION BY o_orderpriority),4) AS col_pct FROM c""")
def freq_crosstab(spark, d):
    return rounded(agg.crosstab(read(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query("""
WITH c AS (SELECT l_returnflag a, l_linestatus b, count(*) o FROM lineitem GROUP BY 1,2),
g AS (SELECT x.a, y.b, coalesce(c.o,0) o FROM (SELECT DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a=x.a AND c.b=y.b),
e AS (SELECT a,b,o, (sum(o) OVER (PARTITION BY a))*(sum(o) OVER (PARTITION BY b))/(sum(o) OVER ())::DOUBLE AS e FROM g)
SELECT round(sum((o-e)*(o-e)/e),4) AS chisq, ((count(DISTINCT a)-1)*(count(DISTINCT b)-1))::BIGINT AS df, sum(o)::BIGINT AS n FROM e""")
def chisq_table(spark, d):
    return rounded(agg.chisq(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@query("""
SELECT count(*) FILTER (l_discount>0.05 AND l_returnflag='R')::BIGINT AS a, count(*) FILTER (l_discount>0.05)::BIGINT AS n1, count(*) FILTER (l_discount<=0.05 AND l_returnflag='R')::BIGINT AS c, count(*) FILTER (l_discount<=0.05)::BIGINT AS n0,
 round(a/n1,6) AS risk1, round(c/n0,6) AS risk0, round((a/n1)/(c/n0),6) AS relative_risk FROM lineitem""")
def relrisk_2x2(spark, d):
    return rounded(agg.relrisk(read(spark, d, "lineitem"), F.col("l_discount") > 0.05, F.col("l_returnflag") == "R"), 6)


@query("""
SELECT 'l_quantity' AS var_a, 'l_extendedprice' AS var_b, round(corr(l_quantity,l_extendedprice),8) AS r FROM lineitem UNION ALL
SELECT 'l_quantity','l_discount', round(corr(l_quantity,l_discount),8) FROM lineitem UNION ALL
SELECT 'l_extendedprice','l_discount', round(corr(l_extendedprice,l_discount),8) FROM lineitem""")
def corr_matrix(spark, d):
    return rounded(agg.proc_corr(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 8)


@query("""
SELECT CASE WHEN grouping(c_mktsegment)=1 THEN 'ALL' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN grouping(c_nationkey)=1 THEN 'ALL' ELSE c_nationkey::VARCHAR END AS c_nationkey, count(*)::BIGINT AS n, round(sum(c_acctbal),3) AS balance
FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)""")
def tabulate_margins(spark, d):
    return rounded(agg.tabulate(read(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], {"n": F.count(F.lit(1)), "balance": F.sum("c_acctbal")}), 3)


@query("""
SELECT user_id, bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 4 WHEN 'signup' THEN 8 ELSE 0 END)::BIGINT AS mask,
 bit_count(bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 4 WHEN 'signup' THEN 8 ELSE 0 END)::BIGINT)::INT AS n_channels FROM events GROUP BY 1""")
def channel_mask(spark, d):
    return agg.channel_mask(read(spark, d, "events"), "user_id", "event_type", {"click": 1 - 1, "purchase": 1, "view": 2, "signup": 3})


@query("""
SELECT 'n_orders' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'revenue', round(sum(o_totalprice),2) FROM orders UNION ALL SELECT 'mean_order', round(avg(o_totalprice),2) FROM orders""")
def melt_metrics(spark, d):
    return rounded(agg.melt_metrics(read(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"), F.avg("o_totalprice").alias("m")), {"n_orders": F.col("n"), "revenue": F.col("s"), "mean_order": F.col("m")}), 2)


@query("""SELECT string_agg(x, ',' ORDER BY x) AS values FROM (SELECT DISTINCT c_mktsegment x FROM customer)""")
def list_values(spark, d):
    return agg.list_values(read(spark, d, "customer"), "c_mktsegment", ",")


@query("""
SELECT p_partkey, p_name AS name, p_size AS size FROM part""")
def set_keep_drop_rename(spark, d):
    return rows.set_step(read(spark, d, "part"), keep=["p_partkey", "p_name", "p_size", "p_brand"], drop=["p_brand", "absent"], rename={"p_name": "name", "p_size": "size"})


@query("""
WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END v FROM customer)
SELECT c_custkey, v IS NULL OR v < 500 AS below, coalesce(v > 500, false) AS above, v IS NULL AS missing, v IS NULL OR v <> 500 AS differs FROM x""")
def where_missing(spark, d):
    v = F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal"))
    return read(spark, d, "customer").select("c_custkey", rows.sas_cmp(v, "<", 500).alias("below"), rows.sas_cmp(v, ">", 500).alias("above"), rows.sas_cmp(v, "=", None).alias("missing"), rows.sas_cmp(v, "<>", 500).alias("differs"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'LARGE' WHEN o_totalprice > 100000 THEN 'MEDIUM' ELSE 'SMALL' END AS size_class,
 CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS price_band FROM orders""")
def case_chain(spark, d):
    p = F.col("o_totalprice")
    return read(spark, d, "orders").select("o_orderkey", rows.case_chain([(p > 300000, "LARGE"), (p > 100000, "MEDIUM")], "SMALL").alias("size_class"), rows.band(p, [50000, 200000], ["low", "mid", "high"]).alias("price_band"))


@query("""
SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' ELSE 'Other' END AS o_orderstatus_fmt FROM orders""")
def format_labels(spark, d):
    return rows.apply_format(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"O": "Open", "F": "Filled"}, "Other")


@query("""
SELECT event_id, CASE WHEN value > 80 THEN 'high' WHEN event_type='purchase' THEN 'sale' ELSE 'rest' END AS route FROM events""")
def route_outputs(spark, d):
    return rows.route(read(spark, d, "events").select("event_id", "event_type", "value"), [("high", F.col("value") > 80), ("sale", F.col("event_type") == "purchase")], "rest").select("event_id", "route")


@query("""
WITH r AS (SELECT l_orderkey,l_linenumber,l_partkey,l_suppkey, 'BIG' AS rule FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT l_orderkey,l_linenumber,l_partkey,l_suppkey,'CHEAP' FROM lineitem WHERE l_discount > 0.08
 UNION ALL SELECT l_orderkey,l_linenumber,l_partkey,l_suppkey,'CLEAN' FROM lineitem WHERE NOT (l_quantity > 40) AND NOT (l_discount > 0.08)) SELECT * FROM r""")
def emit_per_rule(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    return rows.emit_per_rule(df, [("BIG", F.col("l_quantity") > 40), ("CHEAP", F.col("l_discount") > 0.08)]).drop("l_quantity", "l_discount")


@query("""
SELECT c_custkey, concat_ws(';', CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_nationkey > 20 THEN 'nation' END) AS error_fields,
 CASE WHEN c_acctbal < 0 OR c_nationkey > 20 THEN 'INVALID' ELSE 'VALID' END AS status FROM customer""")
def validate_rows(spark, d):
    df = read(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return rows.validate_rows(df, [("balance", F.col("c_acctbal") < 0), ("nation", F.col("c_nationkey") > 20)]).drop("c_acctbal", "c_nationkey")


@query("""
SELECT p_partkey, upper(p_name) AS up, length(rtrim(p_name))::INT AS len, replace(p_name,' ','') AS squeezed, trim(split_part(p_type,' ',1)) AS first_word, instr(p_name,'a')::INT AS pos_a, concat_ws('-', trim(p_brand), trim(p_type)) AS joined, reverse(p_brand) AS backwards, replace(p_type,'STEEL','IRON') AS swapped FROM part""")
def text_functions(spark, d):
    return read(spark, d, "part").select("p_partkey", F.upper("p_name").alias("up"), text.length("p_name").alias("len"), text.compress("p_name").alias("squeezed"), F.coalesce(text.scan("p_type", 1), F.lit("")).alias("first_word"), text.index("p_name", "a").alias("pos_a"), text.catx("-", "p_brand", "p_type").alias("joined"), F.reverse("p_brand").alias("backwards"), text.tranwrd("p_type", "STEEL", "IRON").alias("swapped"))


@query("""
SELECT o_orderkey, round(round(o_totalprice/50)*50,2) AS to_fifty, trunc(o_totalprice)::BIGINT AS whole, (o_orderkey % 7)::BIGINT AS rest, round(ln(o_totalprice),8) AS log_price, sign(o_totalprice-150000)::DOUBLE AS side FROM orders""")
def num_functions(spark, d):
    p = F.col("o_totalprice")
    return read(spark, d, "orders").select("o_orderkey", F.round(num.round_unit(p, 50), 2).alias("to_fifty"), num.integer(p).alias("whole"), num.modulo("o_orderkey", 7).alias("rest"), F.round(num.log(p), 8).alias("log_price"), F.signum(p - 150000).alias("side"))


@query("""
WITH x AS (SELECT o_orderkey, o_orderdate::DATE AS dt FROM orders)
SELECT o_orderkey, (dt - DATE '1960-01-01')::INT AS day_no, date_diff('month', DATE '1995-01-01', dt)::INT AS months, date_diff('quarter', DATE '1995-01-01', dt)::INT AS quarters, date_diff('year', DATE '1995-01-01', dt)::INT AS years,
 (date_trunc('month', dt) + INTERVAL 1 MONTH)::DATE AS next_month, (date_trunc('quarter', dt) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS quarter_end, (year(dt) + CASE WHEN month(dt) >= 7 THEN 1 ELSE 0 END)::INT AS fiscal, ((month(dt)+5)%12//3+1)::INT AS fiscal_q FROM x""")
def intck_intnx(spark, d):
    dt, start = F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")
    return read(spark, d, "orders").select("o_orderkey", dates.to_days(dt).alias("day_no"), dates.intck("month", start, dt).alias("months"), dates.intck("qtr", start, dt).alias("quarters"), dates.intck("year", start, dt).alias("years"), dates.intnx("month", dt, 1).alias("next_month"), dates.intnx("qtr", dt, 0, "E").alias("quarter_end"), dates.fiscal_year(dt).alias("fiscal"), dates.fiscal_quarter(dt).alias("fiscal_q"))


@query("""
SELECT o_orderkey, upper(strftime(o_orderdate,'%d%b%Y')) AS date9, strftime(o_orderdate,'%m/%d/%Y') AS mmddyy10, upper(strftime(o_orderdate,'%b%Y')) AS monyy7, strftime(o_orderdate,'%A') AS downame, lpad(o_orderkey::VARCHAR, 10, '0') AS z10 FROM orders""")
def formats_display(spark, d):
    c = "o_orderdate"
    return read(spark, d, "orders").select("o_orderkey", dates.fmt(c, "DATE9").alias("date9"), dates.fmt(c, "MMDDYY10").alias("mmddyy10"), dates.fmt(c, "MONYY7").alias("monyy7"), dates.fmt(c, "DOWNAME").alias("downame"), dates.fmt("o_orderkey", "Z10").alias("z10"))


@query("""
SELECT o_orderkey, o_orderdate::DATE AS from_date9, o_orderdate::DATE AS from_iso, o_totalprice AS amount FROM orders""")
def informats_parse(spark, d):
    df = read(spark, d, "orders")
    return df.select("o_orderkey", dates.informat(dates.fmt("o_orderdate", "DATE9"), "DATE9").cast("date").alias("from_date9"), dates.informat(dates.fmt("o_orderdate", "YYMMDD10"), "ANYDTDTE").cast("date").alias("from_iso"), text.currency(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("amount"))
