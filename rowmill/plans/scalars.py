"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog import query, read
from rowmill.functions import dates, text
from rowmill.functions import numbers as num


@query("""SELECT p_partkey, substr(p_name, 2, 3) AS mid, substr(p_name, 3) AS tail, rtrim(x) || '|' AS trimmed, trim(x) AS stripped, ltrim(x) || '|' AS lefted, lower(p_brand) AS low, reverse(p_type) AS back, repeat('ab', 3) AS thrice, chr(65 + p_size % 26) AS ch, ascii(p_name)::INT AS code
FROM (SELECT *, '  ' || p_name || '  ' AS x FROM part)""")
def text_parts(spark, d):
    df = read(spark, d, "part").withColumn("x", F.concat(F.lit("  "), "p_name", F.lit("  ")))
    return df.select("p_partkey", text.substr("p_name", 2, 3).alias("mid"), text.substr("p_name", 3).alias("tail"), F.concat(text.trim("x"), F.lit("|")).alias("trimmed"), text.strip("x").alias("stripped"), F.concat(text.left("x"), F.lit("|")).alias("lefted"), text.lowcase("p_brand").alias("low"), text.reverse("p_type").alias("back"), text.repeat(F.lit("ab"), 3).alias("thrice"), text.char(65 + F.col("p_size") % 26).alias("ch"), text.rank("p_name").alias("code"))


@query("""SELECT p_partkey, trim(regexp_replace(p_name || '   x', '\\s+', ' ', 'g')) AS blanks, trim(p_brand) || trim(coalesce(nm, '')) || trim(p_type) AS cats, p_brand || coalesce(nm, '') || p_type AS cat, rtrim(p_brand || ' ') || rtrim(coalesce(nm, '')) AS catt,
 (CASE WHEN strpos(substr(p_type, 2), 'A') = 0 THEN 0 ELSE strpos(substr(p_type, 2), 'A') + 1 END)::INT AS found, (CASE WHEN strpos(lower(p_type), 'a') = 0 THEN 0 ELSE strpos(lower(p_type), 'a') END)::INT AS found_i, translate(p_type, 'AE', 'xy') AS swapped, upper(p_name) AS up,
 nm IS NULL OR trim(nm) = '' AS gone, coalesce(nm, p_brand) AS kept FROM (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN ' ' ELSE p_name END AS nm FROM part)""")
def text_joins(spark, d):
    k = F.col("p_partkey") % 4
    df = read(spark, d, "part").withColumn("nm", F.when(k == 0, None).when(k == 1, " ").otherwise(F.col("p_name")))
    return df.select("p_partkey", text.compbl(F.concat("p_name", F.lit("   x"))).alias("blanks"), text.cats("p_brand", "nm", "p_type").alias("cats"), text.cat("p_brand", "nm", "p_type").alias("cat"), text.catt(F.concat("p_brand", F.lit(" ")), "nm").alias("catt"), text.find("p_type", "A", 2).alias("found"), text.find("p_type", "A", 1, True).alias("found_i"), text.translate("p_type", "xy", "AE").alias("swapped"), text.upcase("p_name").alias("up"), text.missing("nm", True).alias("gone"), text.coalesce("nm", "p_brand").alias("kept"))


@query("""SELECT p_partkey, length(p_brand) - length(ltrim(p_brand, 'Brand#')) AS skip0, (CASE WHEN ltrim(p_brand, 'Brand#') = '' THEN 0 ELSE length(p_brand) - length(ltrim(p_brand, 'Brand#')) + 1 END)::INT AS verified FROM part""")
def text_verify(spark, d):
    v = text.verify("p_brand", "Brand#")
    return read(spark, d, "part").select("p_partkey", F.when(v > 0, v - 1).otherwise(F.length("p_brand")).cast("long").alias("skip0"), v.alias("verified"))


@query("""SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal)::BIGINT AS f, sign(c_acctbal)::DOUBLE AS s, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 8) END AS r, CASE WHEN c_acctbal > 0 THEN round(log2(c_acctbal), 8) END AS l2, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 8) END AS l10,
 round(exp(c_acctbal / 10000), 8) AS e, greatest(c_acctbal, 0, x) AS hi, least(c_acctbal, x) AS lo FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 100.0::DOUBLE END AS x FROM customer)""")
def num_parts(spark, d):
    b, x = F.col("c_acctbal"), F.when(F.col("c_custkey") % 3 != 0, 100.0)
    return read(spark, d, "customer").select("c_custkey", num.absolute(b).alias("a"), num.ceil(b).alias("c"), num.floor(b).alias("f"), num.sign(b).alias("s"), F.round(num.sqrt(b), 8).alias("r"), F.round(num.log2(b), 8).alias("l2"), F.round(num.log10(b), 8).alias("l10"), F.round(num.exp(b / 10000), 8).alias("e"), num.largest(b, F.lit(0.0), x).alias("hi"), num.smallest(b, x).alias("lo"))


@query("""SELECT event_id, year(ts)::INT AS year, quarter(ts)::INT AS qtr, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second, (dayofweek(ts) + 1)::INT AS wday, make_date(year(ts), month(ts), 15) AS mid, ts::DATE AS dpart,
 (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS tpart, 3723 AS hms, ts::DATE::TIMESTAMP + INTERVAL 3723 SECOND AS dhms, (ts::DATE - DATE '2024-01-01')::INT AS ddif, round((ts::DATE - DATE '2020-02-29') / 365.25, 8) AS ydif, date_diff('hour', TIMESTAMP '2024-01-01 00:30:00', ts)::INT AS hours FROM events""")
def date_parts(spark, d):
    t, one = F.col("ts").cast("timestamp"), F.lit("2024-01-01").cast("date")
    return read(spark, d, "events").select("event_id", *(c.cast("int").alias(k) for k, c in dates.clock(t).items()), dates.weekday(t).alias("wday"), dates.mdy(F.month(t), 15, F.year(t)).alias("mid"), dates.datepart(t).alias("dpart"), dates.timepart(t).alias("tpart"), dates.hms(F.lit(1), 2, 3).alias("hms"), dates.dhms(t, 1, 2, 3).alias("dhms"), dates.datdif(one, t.cast("date")).alias("ddif"), F.round(dates.yrdif(F.lit("2020-02-29").cast("date"), t.cast("date")), 8).alias("ydif"), dates.intck("hour", F.lit("2024-01-01 00:30:00").cast("timestamp"), t).alias("hours"))


@query("SELECT count(*)::BIGINT AS n, true AS in_range, true AS near_half FROM customer")
def uniform_by_key(spark, d):
    u = num.uniform("c_custkey", 7)
    return read(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"), F.min((u >= 0) & (u < 1)).alias("in_range"), (F.abs(F.avg(u) - 0.5) < 3 / F.sqrt(12 * F.count(F.lit(1)))).alias("near_half"))


@query("""WITH x AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1)
SELECT p_size, round(1 - exp(-p_size / 2.0), 9) AS chi2, round(0.5 + atan(p_size / 10.0) / pi(), 9) AS t1, round(0.5 + (p_size / 10.0) / (2 * sqrt(2 + (p_size / 10.0) * (p_size / 10.0))), 9) AS t2, round(1 - 1 / (1 + p_size / 10.0), 9) AS f22, true AS inverse FROM x""")
def distributions(spark, d):
    """Chi-square, t and F laws where they have a closed form, and their inverses."""
    x = F.col("p_size") / 10
    df = read(spark, d, "part").select("p_size").distinct()
    back = [F.abs(num.cinv(num.probchi(x, F.lit(3)), F.lit(3)) - x) < 1e-6, F.abs(num.tinv(num.probt(x, F.lit(5)), F.lit(5)) - x) < 1e-6, F.abs(num.finv(num.probf(x, F.lit(3), F.lit(7)), F.lit(3), F.lit(7)) - x) < 1e-6]
    return df.select("p_size", F.round(num.probchi("p_size", F.lit(2)), 9).alias("chi2"), F.round(num.probt(x, F.lit(1)), 9).alias("t1"), F.round(num.probt(x, F.lit(2)), 9).alias("t2"), F.round(num.probf(x, F.lit(2), F.lit(2)), 9).alias("f22"), (back[0] & back[1] & back[2]).alias("inverse"))
