"""Domain workloads: series, risk, attribution, inventory, aging and headcount tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.operators.quantiles import exact_quantiles


def actual_vs_expected(df: DataFrame, by: list[str], actual: str, expected: str, bands: tuple[float, float] = (0.9, 1.1)) -> DataFrame:
    """Sums, their ratio and an alert band by group."""
    g = df.groupBy(*by).agg(F.sum(actual).alias("actual"), F.sum(expected).alias("expected")).withColumn("ratio", F.try_divide("actual", "expected"))
    return g.withColumn("alert", F.when(F.col("ratio") < bands[0], "LOW").when(F.col("ratio") > bands[1], "HIGH").otherwise("OK"))


def trend(df: DataFrame, by: list[str], order: str, value: str, n: int) -> DataFrame:
    """Mean change a step over the last ``n`` steps."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("slope", (F.col(value) - F.lag(value, n).over(w)) / n)


def returns(df: DataFrame, by: list[str], order: str, value: str, limit: float) -> DataFrame:
    """Simple and logarithmic returns and a flag for extreme ones; null after a value that is not positive."""
    prior = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    ratio = F.when((prior > 0) & (F.col(value) > 0), F.col(value) / prior)
    return df.withColumn("simple", ratio - 1).withColumn("log_return", F.ln(ratio)).withColumn("extreme", F.coalesce(F.abs(ratio - 1) > limit, F.lit(False)))


def weights(df: DataFrame, value: str, large: float = 0.05, medium: float = 0.02) -> DataFrame:
    """Each row's share of the whole, and the size class of its position; null shares where the whole is 0."""
    whole = df.agg(F.sum(value).alias("_all"))
    w = df.join(F.broadcast(whole)).withColumn("weight", F.try_divide(value, F.col("_all"))).drop("_all")
    return w.withColumn("position", F.when(F.col("weight") >= large, "LARGE").when(F.col("weight") >= medium, "MEDIUM").otherwise("SMALL"))


def historical_var(df: DataFrame, by: list[str], value: str, level: float) -> DataFrame:
    """The loss that ``level`` of the values do not pass, and the mean of those at or beyond it."""
    cut = exact_quantiles(df, by, value, {"_q": 1 - level})
    tail = df.join(cut, by).where(F.col(value) <= F.col("_q"))
    return tail.groupBy(*by).agg((-F.first("_q")).alias("var"), (-F.avg(value)).alias("cvar"), F.count(F.lit(1)).alias("n_tail"))


def attribution(portfolio: DataFrame, benchmark: DataFrame, sector: str) -> DataFrame:
    """Allocation, selection and interaction by sector; both sides have sector, w (weight) and r (return)."""
    j = portfolio.select(sector, F.col("w").alias("wp"), F.col("r").alias("rp")).join(benchmark.select(sector, F.col("w").alias("wb"), F.col("r").alias("rb")), sector, "full").na.fill(0.0)
    total = F.sum(F.col("wb") * F.col("rb")).over(Window.partitionBy())
    dw, dr = F.col("wp") - F.col("wb"), F.col("rp") - F.col("rb")
    return j.select(sector, (dw * (F.col("rb") - total)).alias("allocation"), (F.col("wb") * dr).alias("selection"), (dw * dr).alias("interaction"))


def stress(base: DataFrame, value: str, scenarios: dict[str, float], quarters: int) -> DataFrame:
    """Each row's value under each scenario's change a quarter, for every quarter."""
    s = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(float(x)).alias("shock")) for n, x in scenarios.items())))
    out = base.withColumn("_s", s).withColumn("quarter", F.explode(F.sequence(F.lit(1), F.lit(quarters))))
    return out.withColumn("scenario", F.col("_s.scenario")).withColumn("projected", F.col(value) * F.pow(1 + F.col("_s.shock"), "quarter")).drop("_s")


def fiscal(df: DataFrame, date: str, value: str, start_month: int = 7) -> DataFrame:
    """Fiscal year (named by its end) and quarter, days in the month, and the value a day."""
    shifted = F.add_months(F.to_date(date), 13 - start_month if start_month > 1 else 0)
    days = F.dayofmonth(F.last_day(date))
    return df.withColumn("fiscal_year", F.year(shifted)).withColumn("fiscal_quarter", F.quarter(shifted)).withColumn("days_in_month", days).withColumn("per_day", F.col(value) / days)


def window_features(df: DataFrame, key: str, date: str, value: str, as_of: str, days: list[int]) -> DataFrame:
    """Count and sum of each key over the last so many days, all in one aggregate."""
    age = F.date_diff(F.lit(as_of).cast("date"), F.to_date(date))
    inside = lambda n: (age >= 0) & (age < n)
    return df.groupBy(key).agg(*(x for n in days for x in (F.count_if(inside(n)).alias(f"n_{n}"), F.coalesce(F.sum(F.when(inside(n), F.col(value))), F.lit(0.0)).alias(f"sum_{n}"))))


def aging(df: DataFrame, due: str, as_of: str, edges: tuple[int, ...] = (0, 30, 60, 90)) -> DataFrame:
    """Days past due and their bucket: CURRENT, then ranges of days, then those beyond the last edge; null without a date."""
    late = F.date_diff(F.lit(as_of).cast("date"), F.to_date(due))
    b = F.when(late <= edges[0], "CURRENT")
    for lo, hi in zip(edges, edges[1:], strict=False):
        b = b.when(late <= hi, f"{lo + 1}-{hi}")
    return df.withColumn("days_past_due", late).withColumn("bucket", b.when(late > edges[-1], f"{edges[-1]}+"))


def depreciation(df: DataFrame, cost: str, start: str, as_of: str, life_months: int, factor: float = 2.0) -> DataFrame:
    """Straight-line and declining-balance book values after whole months (month boundaries passed)."""
    at, s = F.lit(as_of).cast("date"), F.to_date(start)
    age = F.greatest((F.year(at) - F.year(s)) * 12 + F.month(at) - F.month(s), F.lit(0))
    line = F.col(cost) * (1 - F.least(age, F.lit(life_months)) / life_months)
    return df.withColumn("age_months", age).withColumn("straight_line", line).withColumn("declining", F.col(cost) * F.pow(F.lit(1 - factor / life_months), age))


def period_columns(df: DataFrame, by: list[Column], period: Column, value: str, names: dict[str, int]) -> DataFrame:
    """One sum a period as columns, and the total."""
    return df.groupBy(*by).agg(*(F.sum(F.when(period == p, F.col(value))).alias(n) for n, p in names.items()), F.sum(value).alias("total"))


def turnover(spells: DataFrame, start: str, end: str, first: str, last: str) -> DataFrame:
    """Headcount at both ends of a period, joiners, leavers and the turnover rate; from one spell a row."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    s, e = F.to_date(first), F.to_date(last)
    n = lambda c: F.count_if(c)
    t = spells.agg(n((s < a) & (e >= a)).alias("opening"), n((s <= b) & (e > b)).alias("closing"), n(s.between(a, b)).alias("joiners"), n(e.between(a, b)).alias("leavers"))
    return t.withColumn("rate_pct", 100 * F.try_divide(F.col("leavers"), (F.col("opening") + F.col("closing")) / 2))


def followup(df: DataFrame, key: str, date: str, event: Column, study_end: str) -> DataFrame:
    """Days from each key's first row to its first event, or to the study's end where it has none (censored)."""
    g = df.groupBy(key).agg(F.min(F.to_date(date)).alias("entry"), F.min(F.when(event, F.to_date(date))).alias("event_date"))
    return g.withColumn("censored", F.col("event_date").isNull()).withColumn("days", F.date_diff(F.coalesce("event_date", F.lit(study_end).cast("date")), "entry"))


def hazard(followed: DataFrame, early: int = 90) -> DataFrame:
    """Events a person-year, null without time at risk, and a risk category for rows of ``followup``."""
    happened = (~F.col("censored")).cast("int")
    rate = F.when(F.col("days") > 0, happened / (F.col("days") / 365.25))
    risk = F.when(F.col("censored"), "CENSORED").when(F.col("days") <= early, "HIGH").otherwise("MODERATE")
    return followed.withColumn("hazard_rate", rate).withColumn("risk", risk)


def failure_categories(df: DataFrame, text: str, rules: dict[str, str]) -> DataFrame:
    """Rows by the first category whose keyword the text has."""
    c = F.lit("other")
    for name, word in reversed(rules.items()):
        c = F.when(F.lower(F.col(text)).contains(word), name).otherwise(c)
    return df.groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def run_matrix(df: DataFrame, run: Column, category: str, value: str, categories: list[str]) -> DataFrame:
    """Mean value by run, one column a category."""
    return df.groupBy(run).agg(*(F.avg(F.when(F.col(category) == c, F.col(value))).alias(c) for c in categories))


def newest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by falling ``order``."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(n)


def regression(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Least-squares line of y on x by group, from one aggregate."""
    return df.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
