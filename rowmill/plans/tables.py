"""Derivations, joins, summaries and ordered steps of everyday table work."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog import query, read
from rowmill.operators import agg, etl, joins, ordered, rows, setops
from rowmill.plans.summaries import rounded

W = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
BY, ORDER = ["o_custkey"], ["o_orderdate", "o_orderkey"]


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'GOLD' WHEN c_acctbal > 0 THEN 'SILVER' ELSE 'BASE' END AS tier,
 CASE WHEN c_acctbal > 5000 THEN 0.1 WHEN c_acctbal > 0 THEN 0.05 ELSE 0.0 END::DOUBLE AS discount FROM customer""")
def case_struct(spark, d):
    b = F.col("c_acctbal")
    branches = [(b > 5000, {"tier": "GOLD", "discount": 0.1}), (b > 0, {"tier": "SILVER", "discount": 0.05})]
    return rows.case_struct(read(spark, d, "customer"), branches, {"tier": "BASE", "discount": 0.0}).select("c_custkey", "tier", "discount")


@query("SELECT c_custkey, coalesce(n_name, 'UNKNOWN') AS nation_fmt FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON n_nationkey = c_nationkey")
def format_from_table(spark, d):
    labels = read(spark, d, "nation").where("n_nationkey % 4 <> 0")
    return rows.format_from_table(read(spark, d, "customer"), "c_nationkey", labels, "n_nationkey", "n_name", "UNKNOWN", "nation_fmt").select("c_custkey", "nation_fmt")


@query("""SELECT p_partkey, greatest(5, least(40, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size END))::INT AS p_size, upper(p_brand) AS p_brand, upper(p_type) AS p_type FROM part""")
def map_columns(spark, d):
    df = read(spark, d, "part").withColumn("p_size", F.when(F.col("p_partkey") % 13 != 0, F.col("p_size")))
    df = rows.map_columns(df, ["p_size"], lambda c: F.greatest(F.lit(5), F.least(F.lit(40), c)))
    return rows.map_columns(df, ["p_brand", "p_type"], F.upper).select("p_partkey", "p_size", "p_brand", "p_type")


@query("SELECT r_regionkey, r_name, 'RUN-7' AS run_id, DATE '2024-01-31' AS load_date, 'CRM' AS source_system FROM region")
def stamp_audit(spark, d):
    df = etl.stamp(read(spark, d, "region"), run_id="RUN-7", source_system="CRM")
    return df.withColumn("load_date", F.lit("2024-01-31").cast("date"))


@query("SELECT o_custkey AS customer, o_totalprice * 0.2 AS tax, o_totalprice * 1.2 AS gross FROM orders WHERE o_totalprice * 1.2 > 100000 AND o_orderstatus IN ('O', 'F') AND year(o_orderdate) BETWEEN 1996 AND 1999")
def sql_calculated(spark, d):
    """Aliases are used again in the same SELECT list; the predicates reach the scan."""
    df = read(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "F") & F.year("o_orderdate").between(1996, 1999))
    out = df.select(F.col("o_custkey").alias("customer"), (F.col("o_totalprice") * 0.2).alias("tax"), (F.col("o_totalprice") * 1.2).alias("gross"))
    return out.where("gross > 100000")


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey)::BIGINT AS nations, sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END) > 0 AS positive, count(*)::BIGINT AS n FROM customer GROUP BY 1 HAVING count(*) > 10")
def group_having(spark, d):
    s = read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_distinct("c_nationkey").alias("nations"), (F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(0)) > 0).alias("positive"), F.count(F.lit(1)).alias("n"))
    return s.where("n > 10")


@query("SELECT r_name, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def join_chain(spark, d):
    o, c, n, r = (read(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rounded(j.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("SELECT o_orderkey, c_custkey, c_mktsegment FROM (SELECT * FROM orders WHERE o_orderkey % 5 = 0) RIGHT JOIN customer ON o_custkey = c_custkey")
def right_join(spark, d):
    o, c = read(spark, d, "orders").where("o_orderkey % 5 = 0"), read(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "right").select("o_orderkey", "c_custkey", "c_mktsegment")


@query("""WITH a AS (SELECT o_custkey, count(*)::BIGINT AS n_orders FROM orders GROUP BY 1), b AS (SELECT o_custkey, max(o_totalprice) AS biggest FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, n_orders, biggest FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey""")
def merge_many(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    a = o.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    b = o.where("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.max("o_totalprice").alias("biggest"))
    return joins.merge_many(read(spark, d, "customer").select("c_custkey"), [(a, ["n_orders"]), (b, ["biggest"])], ["c_custkey"])


@query("""WITH r AS (SELECT n_name AS currency, 0.5 + n_nationkey / 10.0 AS rate FROM nation WHERE n_nationkey % 6 <> 1)
SELECT s_suppkey, round(s_acctbal * CASE WHEN n_name = (SELECT min(n_name) FROM nation) THEN 1.0 ELSE rate END, 6) AS amount_base FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN r ON r.currency = n_name""")
def convert_currency(spark, d):
    n = read(spark, d, "nation")
    rates = n.where("n_nationkey % 6 <> 1").select(F.col("n_name").alias("currency"), (0.5 + F.col("n_nationkey") / 10).alias("rate"))
    base = n.agg(F.min("n_name")).head()[0]
    df = read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "currency")
    return rounded(joins.convert_currency(df, rates, "s_acctbal", "currency", base).select("s_suppkey", "amount_base"), 6)


@query("""WITH g AS (SELECT event_id, event_type, (epoch(ts) / 3600)::BIGINT AS s FROM events WHERE event_id % 10 = 0), p AS (SELECT event_id AS pid, event_type AS t, (epoch(ts) / 3600)::BIGINT AS ps FROM events WHERE event_id % 10 <> 0)
SELECT event_id, min(pid) AS pid FROM g JOIN p ON t = event_type AND abs(s - ps) <= 2 GROUP BY 1""")
def tolerance_join(spark, d):
    e = read(spark, d, "events").withColumn("s", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).cast("long"))
    p = e.where("event_id % 10 <> 0").select("event_type", "s", F.col("event_id").alias("pid"))
    return joins.tolerance_join(p, e.where("event_id % 10 = 0").select("event_id", "event_type", "s"), ["event_type"], ["s"], 2, "event_id", "pid")


@query("SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 6) AS above, round(c_acctbal / (SELECT max(c_acctbal) FROM customer), 8) AS of_max FROM customer")
def with_scalar(spark, d):
    df = agg.with_scalar(read(spark, d, "customer"), mean=F.avg("c_acctbal"), top=F.max("c_acctbal"))
    return df.select("c_custkey", F.round(F.col("c_acctbal") - F.col("mean"), 6).alias("above"), F.round(F.col("c_acctbal") / F.col("top"), 8).alias("of_max"))


@query("""WITH x AS (SELECT l_returnflag, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END q FROM lineitem)
SELECT l_returnflag, count(q)::BIGINT AS n, round(avg(q), 6) AS mean, round(stddev_samp(q) / sqrt(count(q)), 8) AS stderr, round(avg(q) - 1.959963984540054 * stddev_samp(q) / sqrt(count(q)), 6) AS lclm, round(avg(q) + 1.959963984540054 * stddev_samp(q) / sqrt(count(q)), 6) AS uclm FROM x GROUP BY 1""")
def confidence_limits(spark, d):
    df = read(spark, d, "lineitem").withColumn("q", F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity")))
    out = agg.confidence_limits(df, ["l_returnflag"], "q").withColumn("stderr", F.round("stderr", 8))
    return rounded(out, 6, skip=("stderr",))


@query("SELECT p_brand, count(*)::BIGINT AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM part GROUP BY 1")
def freq_ordered(spark, d):
    return agg.proc_freq(read(spark, d, "part"), "p_brand", order="freq")


@query("""WITH c AS (SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS o FROM lineitem GROUP BY 1, 2)
SELECT *, round(sum(o) OVER (PARTITION BY l_returnflag) * sum(o) OVER (PARTITION BY l_linestatus) / sum(o) OVER (), 6)::DOUBLE AS e FROM c""")
def expected_counts(spark, d):
    cells = read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("o"))
    return rounded(agg.expected(cells, "l_returnflag", "l_linestatus"), 6)


@query("SELECT p_partkey, p_brand FROM (SELECT *, min(p_retailprice) OVER (PARTITION BY p_brand) AS lo FROM part) WHERE p_retailprice = lo")
def remerge_min(spark, d):
    return agg.remerge(read(spark, d, "part"), ["p_brand"], {"lo": F.min("p_retailprice")}).where("p_retailprice = lo").select("p_partkey", "p_brand")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_quantity END a, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount END b, l_tax c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(a,0)+coalesce(b,0)+coalesce(c,0),8) AS s, round((coalesce(a,0)+coalesce(b,0)+coalesce(c,0))/((a IS NOT NULL)::INT+(b IS NOT NULL)::INT+(c IS NOT NULL)::INT),8) AS m,
 ((a IS NOT NULL)::INT+(b IS NOT NULL)::INT+(c IS NOT NULL)::INT)::INT AS n, ((a IS NULL)::INT+(b IS NULL)::INT+(c IS NULL)::INT)::INT AS nmiss, greatest(a,b,c) AS hi, least(a,b,c) AS lo, round(list_stddev_samp(list_filter([a,b,c], lambda v: v IS NOT NULL)),8) AS sd FROM x""")
def row_reducers(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity")).alias("a"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_discount")).alias("b"), F.col("l_tax").alias("c"))
    c = ("a", "b", "c")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(agg.row_sum(*c), 8).alias("s"), F.round(agg.row_mean(*c), 8).alias("m"), agg.row_n(*c).alias("n"), (3 - agg.row_n(*c)).alias("nmiss"), F.greatest(*c).alias("hi"), F.least(*c).alias("lo"), F.round(agg.row_std(*c), 8).alias("sd"))


@query("SELECT DISTINCT event_type, user_id % 10 AS bucket FROM events")
def distinct_rows(spark, d):
    return read(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("bucket")).distinct()


@query("SELECT event_type, round(coalesce(sum(CASE WHEN value > 50 THEN value END) / nullif(sum(CASE WHEN event_id % 7 = 0 THEN value END), 0), 0), 8) AS ratio, round(coalesce(sum(value) / nullif(sum(0 * value), 0), -1), 4) AS guarded FROM events GROUP BY 1")
def ratio_of_sums(spark, d):
    v = F.col("value")
    return read(spark, d, "events").groupBy("event_type").agg(F.round(agg.safe_ratio(F.sum(F.when(v > 50, v)), F.sum(F.when(F.col("event_id") % 7 == 0, v))), 8).alias("ratio"), F.round(agg.safe_ratio(F.sum(v), F.sum(v * 0), -1.0), 4).alias("guarded"))


@query("SELECT l_shipdate::DATE AS day, round(sum(l_extendedprice * l_discount), 4) AS weighted FROM lineitem GROUP BY 1")
def weighted_by_date(spark, d):
    df = read(spark, d, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    return rounded(agg.weighted_agg(df, ["day"], "l_extendedprice", "l_discount", "weighted"))


@query(f"""SELECT o_orderkey, row_number() OVER {W}::INT AS nth, first_value(o_totalprice) OVER {W[:-1]} ROWS UNBOUNDED PRECEDING) AS first_o_totalprice, round(o_totalprice - lag(o_totalprice) OVER {W}, 4) AS dif1 FROM orders""")
def retain_first_dif(spark, d):
    df = read(spark, d, "orders").withColumn("nth", F.row_number().over(ordered.win(BY, ORDER)))
    df = ordered.first_in_group(df, ["o_totalprice"], BY, ORDER)
    return ordered.dif(df, "o_totalprice", 1, BY, ORDER, "dif1").select("o_orderkey", "nth", "first_o_totalprice", F.round("dif1", 4).alias("dif1"))


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER {W} a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) z FROM orders) WHERE a = 1 OR z = 1")
def keep_first_last(spark, d):
    return ordered.keep_first_last(read(spark, d, "orders"), BY, ORDER).select("o_orderkey")


@query("SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) + 1000 AS seq, round(row_number() OVER (ORDER BY value DESC, event_id) / (SELECT count(*) FROM events), 8) AS place FROM events")
def sequence_and_place(spark, d):
    order = [F.desc("value"), "event_id"]
    df = ordered.add_sequence(read(spark, d, "events").select("event_id", "value"), order, "seq", 1001)
    return ordered.pct_position(df, order, "place").select("event_id", "seq", F.round("place", 8).alias("place"))


@query("""WITH q AS (SELECT o_custkey, sum(o_totalprice) FILTER (quarter(o_orderdate) = 1) AS q1, sum(o_totalprice) FILTER (quarter(o_orderdate) = 2) AS q2, sum(o_totalprice) FILTER (quarter(o_orderdate) = 3) AS q3 FROM orders GROUP BY 1),
 r AS (SELECT o_custkey, round(coalesce(q1,0) - 500000, 4) AS cum_q1, round(coalesce(q1,0) + coalesce(q2,0) - 500000, 4) AS cum_q2, round(coalesce(q1,0) + coalesce(q2,0) + coalesce(q3,0) - 500000, 4) AS cum_q3 FROM q)
SELECT *, CASE WHEN cum_q1 >= 0 THEN 1 WHEN cum_q2 >= 0 THEN 2 WHEN cum_q3 >= 0 THEN 3 END::INT AS break_even FROM r""")
def break_even(spark, d):
    o = read(spark, d, "orders")
    q = o.groupBy("o_custkey").agg(*(F.sum(F.when(F.quarter("o_orderdate") == i, F.col("o_totalprice"))).alias(f"q{i}") for i in (1, 2, 3)))
    return rounded(ordered.row_cumulative(q.withColumn("cost", F.lit(500000)), "o_custkey", ["q1", "q2", "q3"], "cost"))


@query("""WITH m AS (SELECT o_orderpriority, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT o_orderpriority, y, m, round(sum(v) OVER w, 3) AS ytd, round(1e6 * m / 12, 3) AS ytd_budget, round(sum(v) OVER w - 1e6 * m / 12, 3) AS variance FROM m WINDOW w AS (PARTITION BY o_orderpriority, y ORDER BY m)""")
def ytd_vs_budget(spark, d):
    m = read(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(ordered.ytd_vs_budget(m.withColumn("budget", F.lit(1e6)), ["o_orderpriority"], "y", "m", "v", "budget").drop("v", "budget"), 3)


@query("SELECT count(*)::BIGINT AS n, round(avg(value), 6) AS mean, count(DISTINCT user_id)::BIGINT AS users FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)")
def last_n_metrics(spark, d):
    last = setops.head(read(spark, d, "events"), 500, ["-ts", "-event_id"])
    return rounded(last.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.count_distinct("user_id").alias("users")), 6)


@query("SELECT c_custkey, c_acctbal FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END c_acctbal FROM customer) ORDER BY c_acctbal ASC NULLS FIRST, c_custkey LIMIT 50")
def sorted_head(spark, d):
    df = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    return setops.proc_sort(df, ["c_acctbal", "c_custkey"]).limit(50)


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def noduprec(spark, d):
    return setops.noduprec(read(spark, d, "orders").select("o_custkey", "o_orderstatus"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n = 1")
def latest_per_key(spark, d):
    return setops.latest_per_key(read(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("SELECT n_nationkey AS k, 0 AS source_index FROM nation UNION ALL SELECT r_regionkey, 1 FROM region")
def interleaved(spark, d):
    n, r = read(spark, d, "nation").select(F.col("n_nationkey").alias("k")), read(spark, d, "region").select(F.col("r_regionkey").alias("k"))
    return setops.interleave({"nation": n, "region": r}, ["k"])


@query("""SELECT 'all' AS form, count(*)::BIGINT AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'distinct', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)""")
def set_operations(spark, d):
    a = read(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    some, b = b.where("s_suppkey % 3 = 0").select("k"), b.select("k")
    forms = {"all": setops.union(a, b), "distinct": setops.union(a, b, all_rows=False), "intersect": setops.intersect(a, some), "except": setops.except_(a, some)}
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("form"), "n") for k, df in forms.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
