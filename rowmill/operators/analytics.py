"""Scoring, segments, retrieval and text-corpus analytics built from the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.operators.cut import cut
from rowmill.operators.nearest import nearest
from rowmill.operators.ordered import proc_rank, proc_rank_many


def rfm(txn: DataFrame, key: str, date: str, amount: str, as_of: str, groups: int = 5) -> DataFrame:
    """Recency, frequency, monetary value, their rank groups (high is good) and the cell."""
    m = txn.groupBy(key).agg(F.date_diff(F.lit(as_of).cast("date"), F.max(date)).alias("recency"), F.count(F.lit(1)).alias("frequency"), F.sum(amount).alias("monetary"))
    m = proc_rank_many(cut(m), {"recency": ("r_score", True), "frequency": ("f_score", False), "monetary": ("m_score", False)}, groups)
    return m.withColumn("cell", F.concat(*((F.col(f"{c}_score") + 1).cast("string") for c in "rfm")))


def lift_table(df: DataFrame, score: str, label: str, groups: int = 10) -> DataFrame:
    """Decile table with cumulative gain, KS and lift over the baseline rate, and the Gini of the whole table
    (twice the area under the curve of cumulative events over non-events, by trapezoids, less 1); decile 0 has the highest scores."""
    d = proc_rank(df, score, groups, "decile", descending=True).groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("events"))
    w, upto = Window.partitionBy(), Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda x, over: F.try_divide(F.sum(x).over(over), F.sum(x).over(w))
    good, bad = share(F.col("events"), upto), share(F.col("n") - F.col("events"), upto)
    d = d.withColumn("cum_gain", good).withColumn("_bad", bad).withColumn("ks", F.abs(F.col("cum_gain") - F.col("_bad")))
    d = d.withColumn("baseline", F.try_divide(F.sum("events").over(w), F.sum("n").over(w)))
    d = d.withColumn("lift", F.try_divide(F.col("events") / F.col("n"), F.col("baseline")))
    before = lambda c: F.coalesce(F.lag(c).over(Window.orderBy("decile")), F.lit(0.0))
    d = d.withColumn("_area", (F.col("_bad") - before("_bad")) * (F.col("cum_gain") + before("cum_gain")) / 2)
    return d.withColumn("gini", 2 * F.sum("_area").over(w) - 1).drop("_bad", "_area")


def score_logit(coefs: dict[str, float], intercept: float) -> Column:
    z = F.lit(intercept)
    for c, b in coefs.items():
        z = z + b * F.coalesce(F.col(c), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def rule_engine(df: DataFrame, rules: dict[str, tuple[Column, int]], cap: int) -> DataFrame:
    """Hit flags, points up to ``cap`` and the number of hits."""
    df = df.withColumns({f"hit_{n}": F.coalesce(c, F.lit(False)).cast("int") for n, (c, _) in rules.items()})
    points = sum((F.col(f"hit_{n}") * p for n, (_, p) in rules.items()), F.lit(0))
    return df.withColumn("points", F.least(points, F.lit(cap))).withColumn("hits", sum((F.col(f"hit_{n}") for n in rules), F.lit(0)))


def ab_test(df: DataFrame, group: str, control: str, metric: str) -> DataFrame:
    """Group statistics against the control row: lift and Welch's t."""
    s = df.groupBy(group).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"))
    c = s.where(F.col(group) == control).select(F.col("n").alias("_n"), F.col("mean").alias("_m"), F.col("sd").alias("_s"))
    out = s.join(F.broadcast(c))
    return out.select(group, "n", "mean", "sd", (100 * F.try_divide(F.col("mean") - F.col("_m"), F.col("_m"))).alias("lift_pct"), F.try_divide(F.col("mean") - F.col("_m"), F.sqrt(F.col("sd") ** 2 / F.col("n") + F.col("_s") ** 2 / F.col("_n"))).alias("t"))


def ab_decision(df: DataFrame, group: str, control: str, converted: str, value: str, alpha: float = 0.05) -> DataFrame:
    """One row a group other than ``control``: n, rate of ``converted`` (0 or 1) and its lift, the mean of ``value`` and its
    lift, 95 % limits of the difference of the rates, Welch's t and its two-sided p, winner and decision, and the
    effect that so many rows would detect with 80 % power.

    A difference counts where p is below ``alpha``: TEST_WINS (LAUNCH) or CONTROL_WINS (REVERT), otherwise INCONCLUSIVE
    (EXTEND_OR_STOP).  Null where a group has no spread to compare."""
    from rowmill.functions.numbers import probt

    y = F.col(converted).cast("double")
    s = df.groupBy(group).agg(F.count(converted).alias("n"), F.avg(y).alias("rate"), F.stddev_samp(y).alias("_s"), F.avg(value).alias("mean"))
    c = s.where(F.col(group) == control).select(F.col("n").alias("_n"), F.col("rate").alias("_r"), F.col("_s").alias("_c"), F.col("mean").alias("_m"))
    out = s.where(F.col(group) != control).join(F.broadcast(c))  # one row
    va, vb = F.col("_s") ** 2 / F.col("n"), F.col("_c") ** 2 / F.col("_n")
    gap, se = F.col("rate") - F.col("_r"), F.sqrt(va + vb)
    out = out.withColumns({"rate_lift": F.try_divide(gap, F.col("_r")), "value_lift": F.try_divide(F.col("mean") - F.col("_m"), F.col("_m")), "ci_lower": gap - 1.96 * se, "ci_upper": gap + 1.96 * se})
    out = out.withColumn("t", F.try_divide(gap, se)).withColumn("df", F.try_divide((va + vb) ** 2, va**2 / (F.col("n") - 1) + vb**2 / (F.col("_n") - 1)))
    out = out.withColumn("p", F.when(F.col("t").isNotNull(), 2 * (1 - probt(F.abs("t"), F.col("df")))))
    sure = F.col("p") < alpha
    out = out.withColumn("winner", F.when(sure & (gap > 0), "TEST_WINS").when(sure, "CONTROL_WINS").otherwise("INCONCLUSIVE"))
    out = out.withColumn("decision", F.when(F.col("winner") == "TEST_WINS", "LAUNCH").when(F.col("winner") == "CONTROL_WINS", "REVERT").otherwise("EXTEND_OR_STOP"))
    out = out.withColumn("detectable", 2.8 * F.sqrt(F.col("_r") * (1 - F.col("_r")) / F.col("n")))
    return out.drop("_n", "_r", "_s", "_c", "_m")


def ece(df: DataFrame, prob: Column, hit: Column, bins: int = 10) -> DataFrame:
    """Calibration by bin of probability: count, mean confidence, accuracy and the weighted gap."""
    b = df.select(F.least(F.floor(prob * bins), F.lit(bins - 1)).alias("bin"), prob.alias("p"), hit.cast("double").alias("y")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg("y").alias("accuracy"))
    return b.withColumn("gap", F.col("n") / F.sum("n").over(Window.partitionBy()) * F.abs(F.col("confidence") - F.col("accuracy")))


def exact_dedup(df: DataFrame, key: str, text: str) -> DataFrame:
    """sha-256 classes: the least key of each, and how many rows it stands for."""
    return df.groupBy(F.sha2(text, 256).alias("content_hash")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def balance_check(df: DataFrame, text: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Opener and closer counts for each named pair of literal marks."""
    import re

    n = lambda mark: F.regexp_count(text, F.lit(re.escape(mark)))
    return df.withColumns({f"{k}_open": n(a) for k, (a, _) in pairs.items()} | {f"{k}_close": n(b) for k, (_, b) in pairs.items()})


def tag_patterns(df: DataFrame, text: str, rules: dict[str, str]) -> DataFrame:
    """All tags whose pattern the text has, in the rules' order, and the first of them."""
    tags = F.filter(F.array(*(F.when(F.col(text).rlike(p), n) for n, p in rules.items())), lambda x: x.isNotNull())
    return df.withColumn("tags", F.concat_ws(",", tags)).withColumn("primary_tag", F.try_element_at(tags, F.lit(1)))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, target) for every href of an anchor."""
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("target"))


def khop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(node, hops) within k steps of the seeds (column node) over edges (src, dst); each step is stored."""
    seen = frontier = cut(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    for i in range(1, k + 1):
        step = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(i)))
        seen = seen.unionByName(frontier)
    return seen


def knn(queries: DataFrame, base: DataFrame, k: int, key: str, vec: str) -> DataFrame:
    """(q_id, b_id, score, rank): exact cosine top-k of the queries against all rows, cell by cell: no side is broadcast and
    no pairs are formed."""
    scored = nearest(queries, base, key, vec, k).withColumnsRenamed({"query_id": "q_id", "id": "b_id"})
    n = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "b_id"))
    return scored.withColumn("rank", n).where(F.col("rank") <= k)
