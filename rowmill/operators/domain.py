"""Scorecards, finance, trials, stock, surveys and operational reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.functions import numbers as num
from rowmill.operators.ordered import cum_share, global_lag
from rowmill.operators.rows import case_chain


def points(tables: dict[str, list[tuple[Column, int]]]) -> dict[str, Column]:
    """Points of each table's first case that holds, and their sum as ``total``."""
    parts = {f"pts_{k}": case_chain(cases, 0) for k, cases in tables.items()}
    return {**parts, "total": sum(parts.values(), F.lit(0))}


def override(value: Column, rules: list[tuple[Column, str, str]]) -> tuple[Column, Column]:
    """(decision, reason): the first policy rule that holds replaces the value."""
    return case_chain([(c, F.lit(v)) for c, v, _ in rules], value), case_chain([(c, r) for c, _, r in rules], "SCORE")


def blend(a: Column, b: Column, weight: float, floor: Column, cap: float = 1.0) -> Column:
    """weight * a + (1 - weight) * b, never below ``floor`` nor above ``cap``; a missing score leaves the other."""
    both = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(weight * a + (1 - weight) * b)
    return F.least(F.lit(cap), F.greatest(both, floor))


def route_alerts(df: DataFrame, score: str, levels: list[tuple[float, str, int]], default: tuple[str, int]) -> DataFrame:
    """Queue and hours to answer of the highest level that is reached."""
    s = sorted(levels, reverse=True)
    made = lambda q, h: F.struct(F.lit(q).alias("queue"), F.lit(h).alias("sla_hours"))
    out = df.withColumn("_q", case_chain([(F.col(score) >= low, made(q, h)) for low, q, h in s], made(*default)))
    return out.withColumns({"queue": F.col("_q.queue"), "sla_hours": F.col("_q.sla_hours")}).drop("_q")


def gini(df: DataFrame, value: str, order: list, expected: float, tol: float) -> DataFrame:
    """Gini coefficient by the trapezoid rule over the Lorenz curve in ``order``, and whether it drifts from ``expected``."""
    c = global_lag(cum_share(df, value, order, "_share"), "_share", order, "_before")
    area = F.sum((F.col("_share") + F.coalesce("_before", F.lit(0.0))) / 2) / F.count(F.lit(1))
    out = c.agg(F.count(F.lit(1)).alias("n"), (1 - 2 * area).alias("gini"))
    return out.withColumn("drift", F.abs(F.col("gini") - expected) > tol)


def rwa_standard(exposure: Column, kind: Column, weights: dict[str, float], default: float) -> Column:
    return exposure * case_chain([(kind == k, F.lit(w)) for k, w in weights.items()], F.lit(default))


def rwa_internal(exposure: Column, pd: Column, lgd: Column) -> Column:
    """Exposure at risk by the one-factor formula: correlation falls from 0.24 to 0.12 as the default
    probability rises, the 99.9 % quantile of the factor, capital times 12.5."""
    w = (1 - F.exp(-50 * pd)) / (1 - F.exp(F.lit(-50.0)))
    r = 0.12 * w + 0.24 * (1 - w)
    z = (num.probit(pd) + F.sqrt(r) * num.probit(F.lit(0.999))) / F.sqrt(1 - r)
    return exposure * 12.5 * lgd * (num.probnorm(z) - pd)


def capital_ratios(df: DataFrame, capital: dict[str, str], risk: str, minima: dict[str, float]) -> DataFrame:
    """One row a ratio: capital over risk in percent, its minimum, and whether it is breached."""
    rows = F.array(*(F.struct(F.lit(k).alias("ratio"), (100 * F.try_divide(F.col(c), F.col(risk))).alias("pct"), F.lit(minima[k]).alias("minimum")) for k, c in capital.items()))
    return df.select(F.explode(rows).alias("r")).select("r.*").withColumn("breach", F.col("pct") < F.col("minimum"))


def touch_attribution(touches: DataFrame, credit: str, channel: str, cost: DataFrame) -> DataFrame:
    """``touches`` has one row a purchase and touch: each purchase's ``credit`` is shared evenly, summed by
    channel and set against its cost."""
    n = F.count(F.lit(1)).over(Window.partitionBy("purchase_id"))
    t = touches.withColumn("_s", F.col(credit) / n).groupBy(channel).agg(F.sum("_s").alias("attributed"), F.count(F.lit(1)).alias("touches"))
    return t.join(cost, channel, "left").withColumn("roi", F.try_divide(F.col("attributed") - F.col("cost"), F.col("cost")))


def inventory(df: DataFrame, mean: str, sd: str, stock: str, lead_days: float, z: float = 1.645) -> DataFrame:
    """Safety stock, reorder point, days of supply and stock status from daily demand."""
    df = df.withColumn("safety_stock", z * F.coalesce(sd, F.lit(0.0)) * lead_days**0.5)
    df = df.withColumn("reorder_point", F.col(mean) * lead_days + F.col("safety_stock")).withColumn("days_of_supply", F.try_divide(stock, mean))
    return df.withColumn("stock_status", case_chain([(F.col(stock) <= 0, "OUT"), (F.col(stock) < F.col("safety_stock"), "CRITICAL"), (F.col(stock) < F.col("reorder_point"), "REORDER")], "OK"))


def attainment(df: DataFrame, actual: str, quota: str) -> DataFrame:
    """Percent of quota and the band it falls into."""
    df = df.withColumn("attained", F.try_divide(100 * F.col(actual), quota))
    a = F.col("attained")
    return df.withColumn("band", case_chain([(a >= 120, "STAR"), (a >= 100, "MET"), (a >= 80, "NEAR"), (a.isNotNull(), "BELOW")], "NO_QUOTA"))


def composite(items: list[str], reversed_items: list[str], top: int, least: int) -> Column:
    """Mean of the answers, reversed ones counted as top + 1 - answer; null with fewer than ``least`` answers."""
    vals = [F.lit(top + 1) - F.col(c) if c in reversed_items else F.col(c) for c in items]
    n = sum((v.isNotNull().cast("int") for v in vals), F.lit(0))
    return F.when(n >= least, sum((F.coalesce(v, F.lit(0)) for v in vals), F.lit(0)) / n)


def trajectory(first: Column, last: Column, tol: float) -> Column:
    """How a value went from the first wave to the last."""
    return case_chain([(first.isNull(), "NEW"), (last.isNull(), "ATTRITION"), (last - first > tol, "IMPROVED"), (first - last > tol, "DECLINED")], "STABLE")


def variance(actual: Column, budget: Column, green: float = 5.0, amber: float = 10.0) -> dict[str, Column]:
    """Variance to budget, in percent, and its light."""
    pct = 100 * F.try_divide(actual - budget, F.abs(budget))
    return {"variance": actual - budget, "variance_pct": pct, "light": case_chain([(pct.isNull(), "NONE"), (F.abs(pct) <= green, "GREEN"), (F.abs(pct) <= amber, "AMBER")], "RED")}


def premium(base: Column, factors: list[Column], lo: float, hi: float, market: Column) -> dict[str, Column]:
    """Base times all factors (a missing one is 1), within bounds, and where that lies in the market."""
    raw = base
    for f in factors:
        raw = raw * F.coalesce(f, F.lit(1.0))
    p = F.least(F.lit(hi), F.greatest(F.lit(lo), raw))
    return {"premium": p, "position": case_chain([(p > 1.1 * market, "ABOVE"), (p < 0.9 * market, "BELOW")], "AT_MARKET")}


def study_day(day: Column, reference: Column) -> Column:
    """Days from the reference; there is no day 0."""
    n = F.date_diff(day, reference)
    return F.when(n >= 0, n + 1).otherwise(n)


def subject_flags(df: DataFrame, treated: Column, done: Column, deviated: Column) -> DataFrame:
    """Intention to treat, safety and per-protocol populations."""
    return df.withColumns({"itt": F.lit(True), "safety": F.coalesce(treated, F.lit(False)), "per_protocol": F.coalesce(treated & done & ~deviated, F.lit(False))})


def incidence(events: DataFrame, subjects: DataFrame, arm: str, category: str, subject: str) -> DataFrame:
    """Subjects with an event by category and arm, empty cells included, over the subjects of the arm.

    Arms and categories are those observed; both must be few, as the columns of a report are."""
    size = subjects.groupBy(arm).agg(F.count_distinct(subject).alias("n_arm"))
    n = events.groupBy(arm, category).agg(F.count_distinct(subject).alias("n"))
    cats = events.select(category).distinct()
    if cats.count() > 10_000 or size.count() > 10_000:
        raise ValueError("too many arms or categories for a table of all their pairs")
    grid = size.join(F.broadcast(cats.agg(F.collect_set(category).alias("_c")))).select(arm, "n_arm", F.explode("_c").alias(category))
    return grid.join(n, [arm, category], "left").fillna(0, ["n"]).withColumn("rate", 100 * F.try_divide("n", "n_arm"))


def claim_scores(claims: DataFrame, policy: str, amount: str, catastrophe: Column, perils: dict[str, tuple[Column, float]]) -> DataFrame:
    """Frequency, severity, catastrophe and attritional losses, and the weighted share of the perils."""
    cat = F.coalesce(catastrophe, F.lit(False))
    s = claims.groupBy(policy).agg(F.count(F.lit(1)).alias("frequency"), F.avg(amount).alias("severity"), F.sum(F.when(cat, F.col(amount)).otherwise(0.0)).alias("catastrophe"), F.sum(F.when(~cat, F.col(amount)).otherwise(0.0)).alias("attritional"), *(F.count_if(c).alias(f"_{k}") for k, (c, _) in perils.items()))
    mix = sum((F.col(f"_{k}") * w for k, (_, w) in perils.items()), F.lit(0.0)) / F.col("frequency")
    return s.withColumn("peril_score", mix).withColumn("score", F.ln(1 + F.col("frequency")) * F.ln(1 + F.greatest("severity", F.lit(0.0)))).drop(*(f"_{k}" for k in perils))


def balance_sheet(trial: DataFrame, account: str, amount: str, sections: list[tuple[Column, str, int]]) -> DataFrame:
    """Signed net of each section; an account goes to the first section it fits."""
    made = lambda name, sign: F.struct(F.lit(name).alias("section"), F.lit(sign).alias("sign"))
    t = trial.withColumn("_s", case_chain([(c, made(n, s)) for c, n, s in sections], made("OTHER", 1)))
    return t.groupBy(F.col("_s.section").alias("section")).agg(F.sum(F.col(amount) * F.col("_s.sign")).alias("net"), F.count_distinct(account).alias("accounts"))


def account_summary(movements: DataFrame, account: str, quarter: Column, amount: str, limit: DataFrame) -> DataFrame:
    """Quarterly count, total and peak of each account, utilisation of its limit and a weighted risk score."""
    q = movements.groupBy(account, quarter.alias("quarter")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"), F.max(amount).alias("peak"))
    out = q.join(limit, account, "left").withColumn("utilisation", F.try_divide("total", "credit_limit"))
    return out.withColumn("risk_score", 60 * F.least(F.lit(1.0), F.coalesce("utilisation", F.lit(0.0))) + 40 * F.least(F.lit(1.0), F.col("n") / 10))


def estimate_cost(df: DataFrame, rates: DataFrame, model: str, tokens: str) -> DataFrame:
    """Cost per thousand tokens from a rate table; an unknown model costs 0."""
    one = rates.groupBy(model).agg(F.max("rate").alias("_r"))
    return df.join(one, model, "left").withColumn("cost", F.col(tokens) / 1000 * F.coalesce("_r", F.lit(0.0))).drop("_r")


def cost_summary(df: DataFrame, ts: str, model: str, as_of: str, days: int = 30) -> DataFrame:
    """Cost by model and by day over the last days, and in all, as rows (kind, item, n, cost)."""
    day = F.col(ts).cast("date")
    last = df.where((day > F.date_sub(F.lit(as_of).cast("date"), days)) & (day <= F.lit(as_of).cast("date")))
    cube = last.withColumns({"_m": F.col(model).cast("string"), "_d": day.cast("string")})
    part = lambda kind, key: cube.groupBy(key.alias("item")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost")).select(F.lit(kind).alias("kind"), "item", "n", "cost")
    return part("model", F.col("_m")).unionByName(part("day", F.col("_d"))).unionByName(part("total", F.lit("ALL")))


def error_queue(items: DataFrame, stages: DataFrame, key: str, failed: list[str], n: int = 50) -> DataFrame:
    """The newest ``n`` items with a failed status, and the first stage of each that failed."""
    first = stages.where("not ok").groupBy(key).agg(F.min_by("stage", "stage_no").alias("failed_stage"))
    newest = items.where(F.col("status").isin(*failed)).orderBy(F.desc("updated"), key).limit(n)
    return newest.join(first, key, "left")


def report_by(df: DataFrame, keys: list[str], status: str, values: list[str]) -> DataFrame:
    """One row a key with the count of each status, all, and the percent of the first one."""
    counts = [F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *counts)
    return out.withColumn("pct", 100 * F.try_divide(f"n_{values[0].lower()}", "n"))


def history(log: DataFrame, key: str, of, order: list) -> DataFrame:
    """The entries of one item with their version numbers, oldest first."""
    return log.where(F.col(key) == of).withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def rollback(df: DataFrame, key: str, version: str, to: dict) -> DataFrame:
    """is_current for every version: the one named in ``to`` for these keys, else the newest."""
    newest = F.col(version) == F.max(version).over(Window.partitionBy(key))
    return df.withColumn("is_current", case_chain([(F.col(key) == k, F.col(version) == v) for k, v in to.items()], newest))


def ingest_feedback(df: DataFrame, confidence: str, least: float) -> DataFrame:
    """Corrections with whether they are accepted and why."""
    ok = F.coalesce(F.col(confidence) >= least, F.lit(False))
    return df.withColumn("accepted", ok).withColumn("reason", F.when(ok, "ACCEPTED").when(F.col(confidence).isNull(), "NO_CONFIDENCE").otherwise("LOW_CONFIDENCE"))


def adversarial(df: DataFrame, key: str) -> DataFrame:
    """A test table made from the keys of another: three BY groups, 8 % nulls, zero, negative and huge
    numbers, money as text, mixed case, and the first two rows again as exact duplicates."""
    k = F.col(key)
    h = F.pmod(F.crc32(k.cast("string").cast("binary")), F.lit(10_000))
    value = case_chain([(h < 800, F.lit(None).cast("double")), (k % 97 == 0, F.lit(0.0)), (k % 89 == 0, -h / 10), (k % 83 == 0, F.lit(999_999.99))], h / 10 + 100)
    status = F.element_at(F.array(*map(F.lit, ("ACTIVE", "CLOSED", "PENDING"))), (h % 3 + 1).cast("int"))
    cased = F.when(k % 3 == 0, status).when(k % 3 == 1, F.lower(status)).otherwise(F.initcap(status))
    out = df.select(key, F.element_at(F.array(*map(F.lit, ("NORTH", "SOUTH", "EAST"))), (k % 3 + 1).cast("int")).alias("by1"), (k % 10 + 1).alias("by2"), value.alias("num"), cased.alias("status"))
    out = out.withColumn("amount_text", F.coalesce(F.concat(F.lit("$"), F.format_number("num", 2)), F.lit("")))
    return out.unionByName(out.orderBy(key).limit(2))


def grouped(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """A pandas function a group, for logic that has no SQL form; a group must fit one task."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
