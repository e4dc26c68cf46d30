"""Reconciliation, frame comparison, data-quality measures and invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.operators.quantiles import exact_quantiles, melted


def count_reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    n = a.agg(F.count(F.lit(1)).alias("rows_a")).join(F.broadcast(b.agg(F.count(F.lit(1)).alias("rows_b"))))
    gap = F.col("rows_b") - F.col("rows_a")
    return n.withColumn("difference", gap).withColumn("pct", 100 * F.try_divide(gap, F.col("rows_a"))).withColumn("result", F.when(gap == 0, "PASS").otherwise("FAIL"))


def column_compare(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str], tol: float = 0.0) -> DataFrame:
    """One row for each mismatch: keys, column, value_a, value_b, kind.  Nulls equal only nulls."""
    left = a.select(*keys, F.struct(*cols).alias("_a"))
    right = b.select(*keys, F.struct(*cols).alias("_b"))
    j = left.join(right, keys, "full")

    def differs(c: str) -> Column:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        numeric = dict(a.dtypes)[c] in ("double", "float")
        return ~F.coalesce(F.abs(x - y) <= tol, x.isNull() & y.isNull()) if numeric else ~x.eqNullSafe(y)

    gone = F.when(F.col("_b").isNull(), "ONLY_A").when(F.col("_a").isNull(), "ONLY_B").otherwise("VALUE")
    items = F.array(*(F.when(differs(c), F.struct(F.lit(c).alias("column"), F.col(f"_a.{c}").cast("string").alias("value_a"), F.col(f"_b.{c}").cast("string").alias("value_b"))) for c in cols))
    return j.select(*keys, gone.alias("kind"), F.explode(F.filter(items, lambda x: x.isNotNull())).alias("m")).select(*keys, "kind", "m.*")


def sum_reconcile(a: DataFrame, b: DataFrame, keys: list[str], amounts: list[str], tol: float, mode: str = "ABS") -> DataFrame:
    """Sums by key on both sides with a status; mode ABS or PCT."""
    side = lambda df, t: df.groupBy(*keys).agg(*(F.sum(x).alias(f"{x}_{t}") for x in amounts))
    j = side(a, "a").join(side(b, "b"), keys, "full")
    gaps = [F.abs(F.coalesce(f"{x}_a", F.lit(0)) - F.coalesce(f"{x}_b", F.lit(0))) for x in amounts]
    limits = [F.lit(tol) if mode == "ABS" else tol / 100 * F.abs(F.coalesce(f"{x}_a", F.lit(0))) for x in amounts]
    ok = reduce(lambda p, q: p & q, (g <= m for g, m in zip(gaps, limits, strict=True)))
    return j.withColumn("status", F.when(ok, "MATCH").otherwise("BREAK"))


def missing_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("missing_from", F.lit("B")).unionByName(y.join(x, keys, "left_anti").withColumn("missing_from", F.lit("A")))


def fk_check(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def compare_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, counted with their multiplicity (order does not matter)."""
    only = lambda x, y, t: x.exceptAll(y.select(*x.columns)).groupBy(*x.columns).count().withColumn("side", F.lit(t))
    return only(a, b, "A").unionByName(only(b, a, "B"))


def profile(df: DataFrame, probs: tuple[float, ...] = (0.25, 0.5, 0.75), accuracy: int = 10_000) -> DataFrame:
    """Type, rows, nulls and distinct values of every column, and for numbers the values at ``probs``.

    Values are counted in one shuffle of (column, value); the quantiles come from one pass of
    bounded sketches, exact up to about ``accuracy`` rows and within 1 / accuracy of the rank beyond."""
    kinds, cols = dict(df.dtypes), df.columns
    numbers = [c for c in cols if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(c).cast("string").alias("v")) for c in cols))
    counts = df.select(F.explode(each).alias("p")).groupBy("p.column", "p.type", "p.v").agg(F.count(F.lit(1)).alias("c"))
    summary = counts.groupBy("column", "type").agg(F.sum("c").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct_values"))
    names = [f"q{round(100 * q)}" for q in probs]
    if not numbers:
        return summary.withColumns({n: F.lit(None).cast("double") for n in names})
    row = df.agg(*(F.percentile_approx(F.col(c).cast("double"), list(probs), accuracy).alias(f"_{i}") for i, c in enumerate(numbers)))
    items = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"_{i}")[k].alias(n) for k, n in enumerate(names))) for i, c in enumerate(numbers)))
    return summary.join(row.select(F.explode(items).alias("p")).select("p.*"), "column", "left")


def completeness(df: DataFrame, cols: list[str], threshold: float) -> DataFrame:
    """Share of filled values; blank text counts as missing."""
    filled = lambda c: F.count_if(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull())
    row = df.agg(F.count(F.lit(1)).alias("_n"), *(filled(c).alias(f"_{i}") for i, c in enumerate(cols)))
    out = row.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("filled")) for i, c in enumerate(cols)))).alias("p")).select("p.*", F.col("_n").alias("n_rows"))
    return out.withColumn("pct", 100 * F.try_divide("filled", "n_rows")).withColumn("result", F.when(F.col("pct") >= threshold, "PASS").otherwise("FAIL"))


def validity(df: DataFrame, rules: dict[str, str], threshold: float) -> DataFrame:
    """Violations of SQL conditions by rule, in one pass; an unknown outcome is a violation."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(~F.coalesce(F.expr(e), F.lit(False))).alias(f"_{i}") for i, e in enumerate(rules.values())))
    out = row.select("_n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"_{i}").alias("violations")) for i, r in enumerate(rules)))).alias("p")).select("p.*", F.col("_n").alias("n_rows"))
    return out.withColumn("pct", 100 - 100 * F.try_divide("violations", "n_rows")).withColumn("result", F.when(F.col("pct") >= threshold, "PASS").otherwise("FAIL"))


def outlier_bounds(df: DataFrame, cols: list[str], lo: float, hi: float) -> DataFrame:
    """Lower and upper bound by column: the exact quantiles at ``lo`` and ``hi``."""
    found = exact_quantiles(melted(df, {}, cols), ["_var"], "_x", {"lower": lo, "upper": hi})
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(found, F.col("column") == F.col("_var"), "left").select("column", "lower", "upper")


def frame_diff(a: DataFrame, b: DataFrame, keys: list[str], tol: float = 1e-4) -> DataFrame:
    """One row: counts, columns on one side only, and mismatches of the common columns by key."""
    common = [c for c in a.columns if c in b.columns and c not in keys]
    lists = {"missing_columns": ",".join(sorted(set(a.columns) - set(b.columns))), "extra_columns": ",".join(sorted(set(b.columns) - set(a.columns)))}
    diffs = column_compare(a, b, keys, common, tol).agg(F.count_if(F.col("kind") == "VALUE").alias("values_differ"), F.count_if(F.col("kind") != "VALUE").alias("cells_missing"))
    return count_reconcile(a, b).select("rows_a", "rows_b").join(F.broadcast(diffs)).withColumns({k: F.lit(v) for k, v in lists.items()})


def classify_diff(diff: DataFrame) -> DataFrame:
    """The first category that fits a ``frame_diff`` row."""
    c = F.when((F.col("missing_columns") != "") | (F.col("extra_columns") != ""), "SCHEMA")
    c = c.when(F.col("rows_a") != F.col("rows_b"), "ROW_COUNT").when(F.col("cells_missing") > 0, "KEYS")
    return diff.withColumn("category", c.when(F.col("values_differ") > 0, "VALUES").otherwise("EQUAL"))


def quality_score(checks: DataFrame) -> DataFrame:
    """Pass rate over rows (check, result) and what it means."""
    s = checks.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(F.col("result") == "PASS").alias("passed")).withColumn("score", 100 * F.try_divide("passed", "n_checks"))
    return s.withColumn("recommendation", F.when(F.col("score") >= 95, "APPROVE").when(F.col("score") >= 80, "REVIEW").otherwise("REJECT"))


def net_pairs(df: DataFrame, a: str, b: str, amount: str, tol: float, material: float) -> DataFrame:
    """Amounts between two parties against those the other way: ELIMINATED, MINOR or MATERIAL."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    way = lambda first: F.sum(F.when(F.col(a) == first, F.col(amount)).otherwise(0.0))
    net = df.where(F.col(a) != F.col(b)).groupBy(lo.alias("party_a"), hi.alias("party_b")).agg(way(lo).alias("a_to_b"), way(hi).alias("b_to_a"))
    gap = F.abs(F.col("a_to_b") - F.col("b_to_a"))
    return net.withColumn("difference", gap).withColumn("status", F.when(gap <= tol, "ELIMINATED").when(gap <= material, "MINOR").otherwise("MATERIAL"))


def consolidate(frames: dict[str, DataFrame], high: int, medium: int) -> DataFrame:
    """Discrepancies per table (frames of one row each) with a severity by their number."""
    parts = (df.agg(F.count(F.lit(1)).alias("n")).withColumn("table_name", F.lit(t)) for t, df in frames.items())
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("severity", F.when(F.col("n") >= high, "HIGH").when(F.col("n") >= medium, "MEDIUM").when(F.col("n") > 0, "LOW").otherwise("NONE"))


def recon_summary(parts: dict[str, tuple[DataFrame, str]], threshold: float) -> DataFrame:
    """Category totals, one under the other, with a flag where they are material."""
    rows = (df.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(c), F.lit(0.0)).alias("total")).withColumn("category", F.lit(k)) for k, (df, c) in parts.items())
    out = reduce(DataFrame.unionByName, rows)
    flag = F.abs("total") > threshold
    return out.withColumn("material", flag).withColumn("note", F.when(flag, F.concat(F.lit("Investigate "), "category")).otherwise("Within limits"))


def consistency(a: DataFrame, b: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Every key of two sources with its match status and the list of columns that differ."""
    j = a.select(key, F.struct(*cols).alias("_a")).join(b.select(key, F.struct(*cols).alias("_b")), key, "full")
    names = F.concat_ws(",", *(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in cols))
    one = F.when(F.col("_a").isNull(), "ONLY_B").when(F.col("_b").isNull(), "ONLY_A")
    return j.select(key, one.when(names == "", "MATCH").otherwise("MISMATCH").alias("status"), F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), names).otherwise("").alias("mismatches"))


def timeliness(df: DataFrame, date: str, as_of: str, max_lag: int, by: list[str] = ()) -> DataFrame:
    """Latest date, its lag, STALE or CURRENT, and a score that falls by 5 for each day beyond ``max_lag``."""
    lag = F.date_diff(F.lit(as_of).cast("date"), "latest")
    out = df.groupBy(*by).agg(F.max(F.col(date).cast("date")).alias("latest")).withColumn("lag_days", lag)
    out = out.withColumn("status", F.when(F.col("lag_days") > max_lag, "STALE").otherwise("CURRENT"))
    return out.withColumn("score", F.greatest(F.lit(0), 100 - 5 * F.greatest(F.lit(0), F.col("lag_days") - max_lag)))


def graded(df: DataFrame, weights: dict[str, float], out: str = "composite") -> DataFrame:
    """Weighted mean of the score columns that are not missing, and its grade."""
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    used = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    df = df.withColumn(out, F.try_divide(top, used))
    return df.withColumn("grade", F.when(F.col(out) >= 90, "A").when(F.col(out) >= 80, "B").when(F.col(out) >= 70, "C").when(F.col(out) >= 60, "D").otherwise("F"))


def impute(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Missing values by rule (a constant, a formula or a joined value), with a flag for each column."""
    flagged = df.withColumns({f"{c}_imputed": F.col(c).isNull() for c in rules})
    return flagged.withColumns({c: F.coalesce(F.col(c), e) for c, e in rules.items()})


def survey_flags(df: DataFrame, items: list[str], lowest: float, highest: float, least: float = 0.8) -> DataFrame:
    """Straight-lining, low completion and extreme answers, with a note that names them."""
    given = F.filter(F.array(*(F.col(c).cast("double") for c in items)), lambda x: x.isNotNull())
    n = F.size(given)
    flags = {"straight_line": (n > 1) & (F.array_min(given) == F.array_max(given)), "low_completion": n < least * len(items), "extreme": (n > 0) & F.forall(given, lambda x: (x <= lowest) | (x >= highest))}
    df = df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    return df.withColumn("note", F.concat_ws(";", *(F.when(F.col(k), k) for k in flags)))


def schema_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row a column of ``before``: whether ``after`` has it, and whether a number stayed one."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    kinds = dict(after.dtypes)
    rows = [(c, t, kinds.get(c), "MISSING" if c not in kinds else "PASS" if t not in numeric or kinds[c] in numeric else "NOT_NUMERIC") for c, t in before.dtypes]
    return before.sparkSession.createDataFrame(rows, "column string, type_before string, type_after string, result string")


def check_all(checks: list[tuple[str, object]], before: DataFrame, after: DataFrame) -> DataFrame:
    """name, passed and observed for each pluggable check: a function of both frames that gives
    one row (passed boolean, observed string)."""
    return reduce(DataFrame.unionByName, (f(before, after).select(F.lit(n).alias("name"), "passed", "observed") for n, f in checks))


def _counts(before: DataFrame, after: DataFrame) -> DataFrame:
    return count_reconcile(before, after).select(F.col("rows_a").alias("a"), F.col("rows_b").alias("b"))


def _rows(cond):
    return lambda x, y: _counts(x, y).select(cond(F.col("a"), F.col("b")).alias("passed"), F.concat_ws(" -> ", "a", "b").alias("observed"))


def sum_preserved(col: str, tol: float = 1e-6):
    s = lambda df, n: df.agg(F.coalesce(F.sum(col), F.lit(0)).cast("double").alias(n))
    return lambda x, y: s(x, "a").join(F.broadcast(s(y, "b"))).select((F.abs(F.col("a") - F.col("b")) <= tol * F.greatest(F.abs("a"), F.lit(1.0))).alias("passed"), F.format_number(F.col("b") - F.col("a"), 2).alias("observed"))


#: Output checks by name.
CHECKS = {
    "ROW_PRESERVATION": _rows(lambda a, b: a == b),
    "ROW_REDUCTION": _rows(lambda a, b: b <= a),
    "OUTPUT_NONEMPTY": _rows(lambda a, b: b > 0),
    "COLUMN_SUPERSET": lambda x, y: _counts(x, y).select(F.lit(set(x.columns) <= set(y.columns)).alias("passed"), F.lit(str(len(y.columns))).alias("observed")),
}


def quality_monitor(df: DataFrame, order: list, n: int, status: str, confidence: str, mode: str) -> DataFrame:
    """Rates, mean confidence and alerts over the last ``n`` rows in ``order``."""
    last = df.orderBy(*order).limit(n)
    top = last.where(F.col(mode).isNotNull()).groupBy(mode).count().agg(F.max("count").alias("top"))
    s = last.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(status) == "SUCCESS").cast("double")).alias("success_rate"), F.avg((F.col(status) == "PARTIAL").cast("double")).alias("partial_rate"), F.avg((F.col(status) == "REVIEW").cast("double")).alias("review_rate"), F.avg(confidence).alias("mean_confidence"))
    out = s.join(F.broadcast(top)).withColumn("top_mode_share", F.try_divide("top", "n")).drop("top")
    alerts = (F.when(F.col("success_rate") < 0.7, "LOW_SUCCESS"), F.when(F.col("mean_confidence") < 0.75, "LOW_CONFIDENCE"), F.when(F.col("top_mode_share") > 0.4, "ONE_MODE"))
    return out.withColumn("alerts", F.concat_ws(",", *alerts))


def retrain_decision(rows_now: DataFrame, grown_since: Column, batches: DataFrame, order: list, ece: Column, top_share: Column) -> DataFrame:
    """Whether to train again: 500 new rows, a calibration error above 0.12, the last two batches
    low, or one failure mode above 40 %.  ``batches`` has success_rate."""
    growth = rows_now.agg(grown_since.alias("growth"), ece.alias("ece"), top_share.alias("top_share"))
    two = batches.orderBy(*order).limit(2).agg(F.count_if(F.col("success_rate") < 0.7).alias("low_batches"))
    out = growth.join(F.broadcast(two))
    why = (F.when(F.col("growth") >= 500, "GROWTH"), F.when(F.col("ece") > 0.12, "CALIBRATION"), F.when(F.col("low_batches") == 2, "QUALITY"), F.when(F.col("top_share") > 0.4, "ONE_MODE"))
    return out.withColumn("reasons", F.concat_ws(",", *why)).withColumn("retrain", F.col("reasons") != "")


def divergence(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """How many rows differ between a contract's column and that of its naive variant."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(~x.eqNullSafe(y)).alias(f"_{i}") for i, (x, y) in enumerate(pairs.values())))
    items = F.array(*(F.struct(F.lit(k).alias("contract"), F.col(f"_{i}").alias("differ")) for i, k in enumerate(pairs)))
    return row.select(F.explode(items).alias("p"), F.col("_n").alias("n_rows")).select("p.*", "n_rows")
