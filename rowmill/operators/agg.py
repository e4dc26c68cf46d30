"""Class summaries, frequency tables, crosstabs and correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.operators.quantiles import exact_quantiles, melted

#: Levels that a sparse table may have in its second column.
MAX_LEVELS = 10_000
#: Statistic -> aggregate of a column.
STATS = {
    "n": F.count,
    "nmiss": lambda c: F.count_if(F.isnull(c)),
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "stderr": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
}
#: Quantile statistic -> its place.
QUANTILES = {"median": 0.5, **{f"p{p}": p / 100 for p in (1, 5, 10, 25, 75, 90, 95, 99)}}


def _measures(variables, stats) -> list[Column]:
    return [STATS[s](v).alias(f"{v}_{s}") for v in variables for s in stats if s not in QUANTILES]


def _with_quantiles(df: DataFrame, made: DataFrame, by: list[str], variables: list[str], stats: tuple[str, ...], types: list[int]) -> DataFrame:
    """``made`` (rows of class summaries) with the quantiles asked for.  Variables and class subsets are rows of one
    search: values are counted by class once, and their counts stand for them in every subset."""
    probs = {s: QUANTILES[s] for s in stats if s in QUANTILES}
    if not probs:
        return made
    keys = [f"_q{i}" for i in range(len(by))]
    counts = melted(df, {k: F.col(c) for k, c in zip(keys, by, strict=True)}, variables).where("_x IS NOT NULL").groupBy(*keys, "_var", "_x").agg(F.count(F.lit(1)).alias("_times"))
    kept = lambda t: [F.when(F.lit(bool(t >> (len(by) - 1 - i) & 1)), F.col(k)).alias(k) for i, k in enumerate(keys)]
    levels = F.explode(F.array(*(F.struct(F.lit(t).cast("long").alias("_qt"), *kept(t)) for t in types))).alias("_level")
    rows = counts.select(levels, "_var", "_x", "_times").select("_level.*", "_var", "_x", "_times")
    found = exact_quantiles(rows, ["_qt", *keys, "_var"], "_x", probs, "_times")
    wide = found.groupBy("_qt", *keys).agg(*(F.max(F.when(F.col("_var") == v, F.col(s))).alias(f"{v}_{s}") for v in variables for s in probs))
    same = F.col("_type_") == F.col("_qt")
    for k, c in zip(keys, by, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return made.join(wide, same, "left").select(*by, "_type_", "_freq_", *(f"{v}_{s}" for v in variables for s in stats))


def proc_means(df: DataFrame, by: list[str], variables: list[str], stats: tuple[str, ...] = ("n", "mean", "std", "min", "max"), nway: bool = True) -> DataFrame:
    """One row for each class combination (null is a class), with _type_ and _freq_;
    with ``nway=False`` for every subset of the classes, down to the grand total."""
    freq, full = F.count(F.lit(1)).alias("_freq_"), (1 << len(by)) - 1
    if not by:
        made = df.agg(F.lit(0).cast("long").alias("_type_"), freq, *_measures(variables, stats))
    elif nway:
        made = df.groupBy(*by).agg(F.lit(full).cast("long").alias("_type_"), freq, *_measures(variables, stats))
    else:
        made = df.cube(*by).agg((F.lit(full) - F.grouping_id()).cast("long").alias("_type_"), freq, *_measures(variables, stats))
    return _with_quantiles(df, made, by, variables, stats, [full] if nway else list(range(full + 1)))


def proc_freq(df: DataFrame, col: str, missing: bool = False, digits: int = 2, order: str | None = None) -> DataFrame:
    """Count and percent by value; nulls count only with ``missing``; ``order`` "freq" sorts by falling count."""
    counted = (df if missing else df.where(F.col(col).isNotNull())).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = counted.agg(F.sum("count").alias("_n"))
    out = counted.join(F.broadcast(total)).withColumn("percent", F.round(100 * F.col("count") / F.col("_n"), digits)).drop("_n")
    return out.orderBy(F.desc("count"), col) if order == "freq" else out


def crosstab(df: DataFrame, a: str, b: str, sparse: bool = False) -> DataFrame:
    """Long two-way table: count and total, row and column percent.  ``sparse`` keeps empty cells."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("count"))
    if sparse:
        # every pair of observed levels: the levels of b are gathered into one array, which a pivot would hold as columns
        if cells.select(b).distinct().count() > MAX_LEVELS:
            raise ValueError(f"{b} has more than {MAX_LEVELS} levels: no sparse table")
        levels = cells.agg(F.collect_set(b).alias("_b"))
        grid = cells.select(a).distinct().join(F.broadcast(levels)).select(a, F.explode("_b").alias(b))
        cells = grid.join(cells, [a, b], "left").fillna(0, ["count"])
    n = F.col("count")
    for name, keys in (("row_pct", [a]), ("col_pct", [b])):
        cells = cells.withColumn(name, 100 * n / F.sum("count").over(Window.partitionBy(*keys)))
    total = cells.agg(F.sum("count").alias("_n"))
    return cells.join(F.broadcast(total)).withColumn("total_pct", 100 * n / F.col("_n")).drop("_n")


def expected(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Cells (a, b, o) with the count e that independence of a and b would give."""
    w = lambda k: F.sum("o").over(Window.partitionBy(k))
    return cells.join(F.broadcast(cells.agg(F.sum("o").alias("_n")))).withColumn("e", w(a) * w(b) / F.col("_n")).drop("_n")


def chisq(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square and degrees of freedom of a two-way table, empty cells included."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    t = expected(t, a, b)
    # cells without a row add their expected counts: n less the expected counts of the others
    s = t.agg(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("x"), F.sum("o").alias("n"), F.sum("e").alias("e"), F.countDistinct(a).alias("ra"), F.countDistinct(b).alias("rb"))
    return s.select((F.col("x") + F.col("n") - F.col("e")).alias("chisq"), ((F.col("ra") - 1) * (F.col("rb") - 1)).alias("df"), "n")


def relrisk(df: DataFrame, exposed: Column, event: Column) -> DataFrame:
    """Risks in both groups, and their ratio."""
    c = lambda *x: F.count_if(F.lit(True) if not x else x[0] if len(x) == 1 else x[0] & x[1])
    s = df.agg(c(exposed, event).alias("a"), c(exposed).alias("n1"), c(~exposed, event).alias("c"), c(~exposed).alias("n0"))
    return s.withColumn("risk1", F.try_divide("a", "n1")).withColumn("risk0", F.try_divide("c", "n0")).withColumn("relative_risk", F.try_divide("risk1", "risk0"))


def proc_corr(df: DataFrame, variables: list[str]) -> DataFrame:
    """Pearson correlations as long rows var_a, var_b, r (each pair once), in one pass."""
    pairs = list(combinations(variables, 2))
    row = df.agg(*(F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def tabulate(df: DataFrame, rows: list[str], measures: dict[str, Column]) -> DataFrame:
    """Margins of the row dimensions (rollup) with the given aggregates; a margin's key is 'ALL'."""
    out = df.rollup(*rows).agg(*(e.alias(n) for n, e in measures.items()), *(F.grouping(r).alias(f"_g_{r}") for r in rows))
    return out.select(*(F.when(F.col(f"_g_{r}") == 1, "ALL").otherwise(F.col(r).cast("string")).alias(r) for r in rows), *measures)


def row_sum(*cols: str) -> Column:
    """Row-wise sum that skips nulls; null if all are."""
    present = F.filter(F.array(*(F.col(c).cast("double") for c in cols)), lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x))


def row_n(*cols: str) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))


def row_mean(*cols: str) -> Column:
    return F.try_divide(row_sum(*cols), row_n(*cols))


def with_scalar(df: DataFrame, **aggs: Column) -> DataFrame:
    """Aggregates of the whole frame beside each row (one broadcast row)."""
    return df.join(F.broadcast(df.agg(*(e.alias(k) for k, e in aggs.items()))))


def melt_metrics(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Name/value rows from one summary row."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), e.cast("double").alias("value")) for k, e in metrics.items()))).alias("m")).select("m.*")


def list_values(df: DataFrame, col: str, sep: str = " ") -> DataFrame:
    """The distinct values of a column of few values, sorted and joined."""
    return df.agg(F.array_join(F.array_sort(F.collect_set(F.col(col).cast("string"))), sep).alias("values"))


def channel_mask(df: DataFrame, key: str, col: str, bits: dict[str, int]) -> DataFrame:
    """Bit mask of the values a key has, and how many."""
    bit = F.lit(0)
    for value, b in bits.items():
        bit = F.when(F.col(col) == value, 1 << b).otherwise(bit)
    out = df.groupBy(key).agg(F.bit_or(bit.cast("long")).alias("mask"))
    return out.withColumn("n_channels", F.bit_count("mask"))


def confidence_limits(df: DataFrame, by: list[str], var: str, z: float = 1.959963984540054) -> DataFrame:
    """n, mean and the limits of the mean by the normal law."""
    s = df.groupBy(*by).agg(F.count(var).alias("n"), F.avg(var).alias("mean"), (F.stddev_samp(var) / F.sqrt(F.count(var))).alias("stderr"))
    return s.withColumn("lclm", F.col("mean") - z * F.col("stderr")).withColumn("uclm", F.col("mean") + z * F.col("stderr"))


def remerge(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Aggregates of a row's group beside the row."""
    return df.withColumns({k: e.over(Window.partitionBy(*keys)) for k, e in aggs.items()})


def safe_ratio(n: Column, d: Column, default: float | None = 0.0) -> Column:
    """n / d, and ``default`` where d is 0 or missing."""
    return F.coalesce(F.try_divide(n, d), F.lit(default))


def weighted_agg(df: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """Sum of value times weight by ``keys``; rows where either is missing add nothing."""
    return df.groupBy(*keys).agg(F.sum(F.col(value) * F.col(weight)).alias(out))


def row_std(*cols: str) -> Column:
    """Row-wise sample deviation that skips nulls; null below two values."""
    dev = sum((F.coalesce((F.col(c) - row_mean(*cols)) ** 2, F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.sqrt(F.try_divide(dev, F.nullif(F.greatest(row_n(*cols) - 1, F.lit(0)), F.lit(0))))
