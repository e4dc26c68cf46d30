"""Running totals, lags, boundaries, ranks and scoring over ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog import query, read
from rowmill.operators import analytics, ordered, setops
from rowmill.plans.summaries import rounded


def _orders(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


BY, ORDER = ["o_custkey"], ["o_orderdate", "o_orderkey"]
W = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"SELECT o_orderkey, round(sum(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_totalprice END) OVER {W[:-1]} ROWS UNBOUNDED PRECEDING),3) AS running FROM orders")
def running_total_by(spark, d):
    v = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice"))
    return rounded(ordered.running_sum(_orders(spark, d), v, BY, ORDER, "running").select("o_orderkey", "running"), 3)


@query("SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),2) AS running FROM events")
def running_total_global(spark, d):
    df = read(spark, d, "events").select("event_id", "ts", "value")
    return rounded(ordered.global_running_sum(df, F.col("value"), ["ts", "event_id"], "running").select("event_id", "running"), 2)


@query("SELECT event_id, lag(value) OVER (ORDER BY ts, event_id) AS before FROM events")
def lag_global(spark, d):
    df = read(spark, d, "events").select("event_id", "ts", "value")
    return ordered.global_lag(df, "value", ["ts", "event_id"], "before").select("event_id", "before")


@query(f"""SELECT o_orderkey, round(sum(CASE o_orderstatus WHEN 'O' THEN o_totalprice WHEN 'F' THEN -o_totalprice ELSE 0 END) OVER {W[:-1]} ROWS UNBOUNDED PRECEDING),3) AS balance,
 sum(CASE o_orderstatus WHEN 'O' THEN o_totalprice WHEN 'F' THEN -o_totalprice ELSE 0 END) OVER {W[:-1]} ROWS UNBOUNDED PRECEDING) < 0 AS balance_negative FROM orders""")
def running_balance(spark, d):
    return rounded(ordered.running_balance(read(spark, d, "orders"), BY, ORDER, "o_orderstatus", "o_totalprice", {"O": 1, "F": -1}).select("o_orderkey", "balance", "balance_negative"), 3)


@query(f"""WITH x AS (SELECT *, o_totalprice - 180000 AS dlt FROM orders), s AS (SELECT *, sum(dlt) OVER {W[:-1]} ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT o_orderkey, round(run - least(0, min(run) OVER {W[:-1]} ROWS UNBOUNDED PRECEDING)),2) AS held FROM s""")
def clamped_balance(spark, d):
    return rounded(ordered.clamped_balance(_orders(spark, d), BY, ORDER, F.col("o_totalprice") - 180000, "held").select("o_orderkey", "held"), 2)


@query(f"""WITH x AS (SELECT o_orderkey, o_custkey, o_orderdate, max(o_totalprice) OVER {W[:-1]} ROWS UNBOUNDED PRECEDING) AS high_water, o_totalprice p FROM orders) SELECT o_orderkey, high_water, round((high_water-p)/high_water,8) AS drawdown FROM x""")
def drawdown(spark, d):
    return ordered.drawdown(_orders(spark, d), BY, ORDER, "o_totalprice").select("o_orderkey", "high_water", F.round("drawdown", 8).alias("drawdown"))


@query(f"SELECT o_orderkey, round(exp(sum(ln(1 + (o_totalprice-150000)/1000000)) OVER {W[:-1]} ROWS UNBOUNDED PRECEDING)),6) AS wealth FROM orders")
def wealth_index(spark, d):
    df = _orders(spark, d).withColumn("rate", (F.col("o_totalprice") - 150000) / 1000000)
    return rounded(ordered.wealth_index(df, BY, ORDER, "rate", "wealth").select("o_orderkey", "wealth"), 6)


@query(f"""WITH x AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS v FROM orders) SELECT o_orderkey, last_value(v IGNORE NULLS) OVER {W[:-1]} ROWS UNBOUNDED PRECEDING) AS v FROM x""")
def locf(spark, d):
    df = _orders(spark, d).withColumn("v", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")))
    return ordered.locf(df, ["v"], BY, ORDER).select("o_orderkey", "v")


@query(f"SELECT o_orderkey, lag(o_totalprice,2) OVER {W} AS lag2, round(o_totalprice - lag(o_totalprice) OVER {W},3) AS dif, round(100*(o_totalprice - lag(o_totalprice) OVER {W})/lag(o_totalprice) OVER {W},6) AS change FROM orders")
def lag_by(spark, d):
    df = ordered.sas_lag(_orders(spark, d), "o_totalprice", 2, BY, ORDER, "lag2")
    df = ordered.sas_lag(df, "o_totalprice", 1, BY, ORDER, "p").withColumn("dif", F.round(F.col("o_totalprice") - F.col("p"), 3))
    return ordered.pct_change(df, "o_totalprice", BY, ORDER, "change").select("o_orderkey", "lag2", "dif", F.round("change", 6).alias("change"))


@query(f"SELECT o_orderkey, CASE WHEN row_number() OVER {W} >= 3 THEN round(avg(o_totalprice) OVER {W[:-1]} ROWS 2 PRECEDING),7) END AS ma3 FROM orders")
def moving_avg(spark, d):
    return rounded(ordered.moving_avg(_orders(spark, d), "o_totalprice", 3, BY, ORDER, "ma3").select("o_orderkey", "ma3"), 7)


@query(f"SELECT o_orderkey, (o_orderdate::DATE - lag(o_orderdate::DATE) OVER {W})::INT AS gap, coalesce((o_orderdate::DATE - lag(o_orderdate::DATE) OVER {W}) > 90, false) AS gap_flag FROM orders")
def gap_flags(spark, d):
    return ordered.gap_days(_orders(spark, d), BY, "o_orderdate", ORDER, 90).select("o_orderkey", "gap", "gap_flag")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)=1 AS first_o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)=1 AS last_o_custkey FROM orders""")
def first_last(spark, d):
    return ordered.by_flags(_orders(spark, d), BY, ORDER).select("o_orderkey", "first_o_custkey", "last_o_custkey")


@query("SELECT o_custkey, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, count(*)::BIGINT AS n, round(sum(o_totalprice),7) AS total, round(avg(o_totalprice),7) AS mean FROM orders GROUP BY 1")
def group_rollup(spark, d):
    return rounded(ordered.group_rollup(_orders(spark, d), BY, "o_orderdate", "o_totalprice"), 7)


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) n FROM orders) WHERE n = 1")
def nodupkey(spark, d):
    return setops.nodupkey(_orders(spark, d), BY, ["-o_totalprice", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) n FROM orders) WHERE n > 1")
def dupout(spark, d):
    return setops.nodupkey(_orders(spark, d), BY, ["-o_totalprice", "o_orderkey"], dupout=True).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 3")
def top_k_by_group(spark, d):
    return setops.top_k(_orders(spark, d), 3, ["-o_totalprice", "o_orderkey"], BY).select("o_custkey", "o_orderkey", "rank")


@query("""WITH g AS (SELECT *, floor(epoch(ts) / 3600) - lag(floor(epoch(ts) / 3600)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, count(*) FILTER (gap <= 1) OVER v AS n_1h, round(coalesce(sum(value) FILTER (gap <= 1) OVER v, 0), 6) AS sum_1h, max(value) FILTER (gap <= 1) OVER v AS max_1h, count(*) FILTER (gap <= 24) OVER v AS n_24h, round(coalesce(sum(value) FILTER (gap <= 24) OVER v, 0), 6) AS sum_24h, max(value) FILTER (gap <= 24) OVER v AS max_24h FROM g WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def velocity_gap(spark, d):
    out = ordered.gap_velocity(read(spark, d, "events"), "user_id", "ts", "value", [1, 24], "event_id")
    return rounded(out.select("event_id", *(f"{k}_{h}h" for h in (1, 24) for k in ("n", "sum", "max"))), 6, ("max_1h", "max_24h"))


@query("""SELECT event_id, count(*) OVER w AS cnt_24h, round(sum(value) OVER w,4) AS sum_24h, max(value) OVER w AS max_24h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)""")
def velocity_windows(spark, d):
    return rounded(ordered.velocity(read(spark, d, "events"), "user_id", "ts", "value", [24]).select("event_id", "cnt_24h", "sum_24h", "max_24h"), 4)


@query("""WITH x AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM x""")
def sessions_gap(spark, d):
    return ordered.sessions(read(spark, d, "events"), "user_id", "ts", 12 * 3600, ["ts", "event_id"]).select("event_id", "session")


@query("""WITH r AS (SELECT c_custkey, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1)/2.0 AS rk, count(*) OVER () AS n FROM customer)
SELECT c_custkey, floor(rk*5/(n+1))::BIGINT AS quintile FROM r""")
def proc_rank_quintiles(spark, d):
    return ordered.proc_rank(read(spark, d, "customer"), "c_acctbal", 5, "quintile").select("c_custkey", "quintile")


@query("""WITH m AS (SELECT o_custkey, (DATE '2001-12-31' - max(o_orderdate)::DATE)::INT AS recency, count(*)::BIGINT AS frequency, sum(o_totalprice) AS monetary FROM orders GROUP BY 1),
k AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY recency DESC)+(count(*) OVER (PARTITION BY recency)-1)/2.0 AS r, rank() OVER (ORDER BY frequency)+(count(*) OVER (PARTITION BY frequency)-1)/2.0 AS f, rank() OVER (ORDER BY monetary)+(count(*) OVER (PARTITION BY monetary)-1)/2.0 AS mm FROM m)
SELECT o_custkey, recency, frequency, round(monetary,2) AS monetary, floor(r*5/(n+1))::BIGINT AS r_score, floor(f*5/(n+1))::BIGINT AS f_score, floor(mm*5/(n+1))::BIGINT AS m_score,
 concat(floor(r*5/(n+1))::BIGINT+1, floor(f*5/(n+1))::BIGINT+1, floor(mm*5/(n+1))::BIGINT+1) AS cell FROM k""")
def rfm_segments(spark, d):
    return rounded(analytics.rfm(_orders(spark, d), "o_custkey", "o_orderdate", "o_totalprice", "2001-12-31"), 2)


@query("""WITH r AS (SELECT floor((rank() OVER (ORDER BY value DESC)+(count(*) OVER (PARTITION BY value)-1)/2.0)*10/(count(*) OVER ()+1))::BIGINT AS decile, (event_type='purchase')::INT AS y FROM events),
g AS (SELECT decile, count(*)::BIGINT AS n, sum(y)::BIGINT AS events FROM r GROUP BY 1),
c AS (SELECT *, sum(events) OVER (ORDER BY decile)/sum(events) OVER () AS good, sum(n-events) OVER (ORDER BY decile)/sum(n-events) OVER () AS bad, sum(events) OVER ()/sum(n) OVER () AS baseline FROM g),
a AS (SELECT *, (bad - coalesce(lag(bad) OVER (ORDER BY decile), 0)) * (good + coalesce(lag(good) OVER (ORDER BY decile), 0)) / 2 AS area FROM c)
SELECT decile, n, events, round(good,6) AS cum_gain, round(abs(good - bad),6) AS ks, round(baseline,6) AS baseline, round((events/n)/baseline,6) AS lift, round(2 * sum(area) OVER () - 1,6) AS gini FROM a""")
def lift_deciles(spark, d):
    df = read(spark, d, "events").select("value", (F.col("event_type") == "purchase").alias("y"))
    return rounded(analytics.lift_table(df, "value", "y"), 6)


@query("""WITH p AS (SELECT l_suppkey, sum(l_extendedprice) AS spend FROM lineitem GROUP BY 1), c AS (SELECT *, sum(spend) OVER (ORDER BY spend DESC, l_suppkey ROWS UNBOUNDED PRECEDING)/sum(spend) OVER () AS share FROM p)
SELECT l_suppkey, round(share,8) AS share, CASE WHEN share <= 0.8 THEN 'A' WHEN share <= 0.95 THEN 'B' ELSE 'C' END AS abc FROM c""")
def abc_classes(spark, d):
    p = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("spend"))
    c = ordered.cum_share(p, "spend", [F.desc("spend"), "l_suppkey"], "share")
    return c.select("l_suppkey", F.round("share", 8).alias("share"), F.when(F.col("share") <= 0.8, "A").when(F.col("share") <= 0.95, "B").otherwise("C").alias("abc"))


@query("""WITH x AS (SELECT user_id, min((value < 90)::INT) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS h FROM events) SELECT user_id, sum(h)::BIGINT AS streak FROM x GROUP BY 1""")
def streak(spark, d):
    return ordered.streak(read(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("value") < 90)


@query("""WITH s AS (SELECT event_type, count(value)::BIGINT AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1), c AS (SELECT n, mean, sd FROM s WHERE event_type='view')
SELECT s.event_type, s.n, round(s.mean,6) AS mean, round(s.sd,6) AS sd, round(100*(s.mean-c.mean)/c.mean,6) AS lift_pct, round((s.mean-c.mean)/sqrt(s.sd*s.sd/s.n+c.sd*c.sd/c.n),6) AS t FROM s, c""")
def ab_test(spark, d):
    return rounded(analytics.ab_test(read(spark, d, "events"), "event_type", "view", "value"), 6)


@query("""WITH e AS (SELECT event_type, (value > 60)::INT::DOUBLE AS y, value FROM events WHERE value IS NOT NULL), s AS (SELECT event_type, count(*) AS n, avg(y) AS rate, stddev_samp(y) AS sd, avg(value) AS mean FROM e GROUP BY 1), c AS (SELECT * FROM s WHERE event_type = 'view'),
x AS (SELECT s.event_type, s.n, s.rate, s.mean, (s.rate - c.rate) / c.rate AS rate_lift, (s.mean - c.mean) / c.mean AS value_lift, s.rate - c.rate AS gap, sqrt(s.sd^2 / s.n + c.sd^2 / c.n) AS se, 2.8 * sqrt(c.rate * (1 - c.rate) / s.n) AS detectable FROM s, c WHERE s.event_type <> 'view')
SELECT event_type, n, round(rate,6) AS rate, round(mean,6) AS mean, round(rate_lift,6) AS rate_lift, round(value_lift,6) AS value_lift, round(gap - 1.96*se,6) AS ci_lower, round(gap + 1.96*se,6) AS ci_upper, round(gap/se,6) AS t, round(detectable,6) AS detectable,
 CASE WHEN abs(gap/se) > 1.96 THEN CASE WHEN gap > 0 THEN 'TEST_WINS' ELSE 'CONTROL_WINS' END ELSE 'INCONCLUSIVE' END AS winner, CASE WHEN abs(gap/se) > 1.96 THEN CASE WHEN gap > 0 THEN 'LAUNCH' ELSE 'REVERT' END ELSE 'EXTEND_OR_STOP' END AS decision FROM x""")
def ab_decision(spark, d):
    """The SQL decides by the normal limit, which the t distribution reaches at so many rows; tests hold p itself."""
    e = read(spark, d, "events").where("value IS NOT NULL").select("event_type", (F.col("value") > 60).cast("int").alias("y"), "value")
    return rounded(analytics.ab_decision(e, "event_type", "view", "y", "value").drop("df", "p"), 6)


@query("""SELECT event_id, (value>50)::INT AS hit_big, (event_type='purchase')::INT AS hit_sale, least((value>50)::INT*30+(event_type='purchase')::INT*80, 100)::INT AS points, ((value>50)::INT+(event_type='purchase')::INT)::INT AS hits FROM events""")
def rule_engine(spark, d):
    df = read(spark, d, "events").select("event_id", "value", "event_type")
    return analytics.rule_engine(df, {"big": (F.col("value") > 50, 30), "sale": (F.col("event_type") == "purchase", 80)}, 100).drop("value", "event_type")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1/(1+exp(-(-1.5+0.04*l_quantity+3*l_discount))),8) AS p FROM lineitem""")
def score_logit(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(analytics.score_logit({"l_quantity": 0.04, "l_discount": 3.0}, -1.5), 8).alias("p"))


@query("""WITH b AS (SELECT least(floor(l_discount*10*5),9)::BIGINT AS bin, l_discount*5 AS p, (l_returnflag='R')::DOUBLE AS y FROM lineitem), g AS (SELECT bin, count(*)::BIGINT AS n, avg(p) AS confidence, avg(y) AS accuracy FROM b GROUP BY 1)
SELECT bin, n, round(confidence,6) AS confidence, round(accuracy,6) AS accuracy, round(n/sum(n) OVER ()*abs(confidence-accuracy),6) AS gap FROM g""")
def ece_bins(spark, d):
    return rounded(analytics.ece(read(spark, d, "lineitem"), F.col("l_discount") * 5, F.col("l_returnflag") == "R"), 6)
