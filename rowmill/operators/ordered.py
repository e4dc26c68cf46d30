"""Operators on ordered rows: running totals, lags, group boundaries, ranks.

Every operator takes its order from the caller; ``order`` must settle ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rowmill.operators.cut import cut


def win(by: list[str], order: list) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def _to_here(by, order) -> WindowSpec:
    return win(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_sum(df: DataFrame, value: Column, by: list[str], order: list, out: str) -> DataFrame:
    """Running total that starts anew in each group; a null addend counts 0."""
    return df.withColumn(out, F.sum(F.coalesce(value, F.lit(0))).over(_to_here(by, order)))


def bucketed(df: DataFrame, order: list) -> DataFrame:
    """``df``, stored, with a bucket number _b that rises in ``order``: for global order without one task.

    Buckets are the parts of a range partitioning by all order columns, so rows with
    equal first columns are dealt too; they are stored because bounds are sampled
    anew whenever a plan runs again."""
    return cut(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()))


def _totals(df: DataFrame, total: Column) -> DataFrame:
    """_b and _o, what ``total`` (an aggregate) adds up to in the buckets before: one row a bucket."""
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy("_b").agg(total.alias("_t")).select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))


def global_running_sum(df: DataFrame, value: Column, order: list, out: str) -> DataFrame:
    """Running total over the whole frame: within a bucket, plus the totals of the buckets before."""
    df = bucketed(df.withColumn("_v", F.coalesce(value, F.lit(0))), order)
    inner = df.withColumn("_s", F.sum("_v").over(_to_here(["_b"], order)))
    return inner.join(_totals(df, F.sum("_v")), "_b").withColumn(out, F.col("_s") + F.col("_o")).drop("_b", "_v", "_s", "_o")


def add_sequence(df: DataFrame, order: list, out: str, start: int = 1) -> DataFrame:
    """Numbers without gaps in ``order``, from ``start``."""
    df = bucketed(df, order)
    inner = df.withColumn("_n", F.row_number().over(win(["_b"], order)))
    return inner.join(_totals(df, F.count(F.lit(1))), "_b").withColumn(out, F.col("_n") + F.col("_o") + (start - 1)).drop("_b", "_n", "_o")


def pct_position(df: DataFrame, order: list, out: str) -> DataFrame:
    """The place of each row in ``order`` as a share of all rows."""
    n = df.agg(F.count(F.lit(1)).alias("_all"))
    return add_sequence(df, order, "_seq").join(F.broadcast(n)).withColumn(out, F.col("_seq") / F.col("_all")).drop("_seq", "_all")


def global_lag(df: DataFrame, col: str, order: list, out: str) -> DataFrame:
    """The value of the row before, over the whole frame: windows a bucket, and the last row of the bucket before."""
    df = bucketed(df, order)
    w = win(["_b"], order)
    tail = df.withColumn("_z", F.lead(F.lit(1)).over(w)).where("_z is null")
    tail = tail.select("_b", F.lag(F.struct(col)).over(Window.orderBy("_b")).alias("_p"))
    lagged = df.withColumn("_l", F.lag(col).over(w)).withColumn("_n", F.row_number().over(w))
    return lagged.join(tail, "_b").withColumn(out, F.when(F.col("_n") == 1, F.col(f"_p.{col}")).otherwise(F.col("_l"))).drop("_b", "_l", "_n", "_p")


def dif(df: DataFrame, col: str, n: int, by: list[str], order: list, out: str) -> DataFrame:
    """The value less that n rows before in the group; null where either is missing."""
    return df.withColumn(out, F.col(col) - F.lag(col, n).over(win(by, order)))


def first_in_group(df: DataFrame, cols: list[str], by: list[str], order: list) -> DataFrame:
    """first_c for each column: the value of the group's first row, null or not."""
    return df.withColumns({f"first_{c}": F.first(c).over(_to_here(by, order)) for c in cols})


def keep_first_last(df: DataFrame, by: list[str], order: list, which: str = "both") -> DataFrame:
    """The first rows of groups, the last, or both (a row that is both comes once)."""
    desc = [F.desc(o) if isinstance(o, str) else o.desc() for o in order]
    flags = df.withColumn("_f", F.row_number().over(win(by, order)) == 1).withColumn("_l", F.row_number().over(win(by, desc)) == 1)
    cond = {"first": F.col("_f"), "last": F.col("_l"), "both": F.col("_f") | F.col("_l")}[which]
    return flags.where(cond).drop("_f", "_l")


def row_cumulative(df: DataFrame, key: str, cols: list[str], cost: str) -> DataFrame:
    """key, the running totals of the columns less ``cost``, and the number of the first that is 0 or more."""
    runs = [sum((F.coalesce(c, F.lit(0)) for c in cols[: i + 1]), F.lit(0)) - F.col(cost) for i in range(len(cols))]
    first = F.coalesce(*(F.when(r >= 0, i + 1) for i, r in enumerate(runs)))
    return df.select(key, *(r.alias(f"cum_{c}") for r, c in zip(runs, cols, strict=True)), first.alias("break_even"))


def ytd_vs_budget(df: DataFrame, by: list[str], year: str, month: str, actual: str, budget: str) -> DataFrame:
    """Running total in the year, the share of the year's budget that is due, and the variance."""
    run = F.sum(F.coalesce(actual, F.lit(0))).over(_to_here([*by, year], [month]))
    due = F.col(budget) * F.col(month) / 12
    return df.withColumn("ytd", run).withColumn("ytd_budget", due).withColumn("variance", F.col("ytd") - F.col("ytd_budget"))


def running_balance(df: DataFrame, by: list[str], order: list, kind: str, quantity: str, signs: dict[str, int], out: str = "balance") -> DataFrame:
    """Balance of signed movements, with a flag where it is negative; unknown kinds count 0."""
    sign = F.lit(0)
    for k, s in signs.items():
        sign = F.when(F.col(kind) == k, s).otherwise(sign)
    return running_sum(df, sign * F.col(quantity), by, order, out).withColumn(f"{out}_negative", F.col(out) < 0)


def clamped_balance(df: DataFrame, by: list[str], order: list, delta: Column, out: str) -> DataFrame:
    """run = max(0, run + delta) from 0: the running sum less its lowest point so far, if below zero."""
    df = df.withColumn("_s", F.sum(F.coalesce(delta, F.lit(0))).over(_to_here(by, order)))
    return df.withColumn(out, F.col("_s") - F.least(F.lit(0), F.min("_s").over(_to_here(by, order)))).drop("_s")


def wealth_index(df: DataFrame, by: list[str], order: list, rate: str, out: str) -> DataFrame:
    """Compounded product of 1 + rate; null once a rate is -1 or less."""
    w = _to_here(by, order)
    bad = F.max((F.col(rate) <= -1).cast("int")).over(w)
    grown = F.exp(F.sum(F.ln(F.when(F.col(rate) > -1, 1 + F.coalesce(F.col(rate), F.lit(0.0))))).over(w))
    return df.withColumn(out, F.when(bad == 1, None).otherwise(grown))


def drawdown(df: DataFrame, by: list[str], order: list, level: str) -> DataFrame:
    """High-water mark and relative fall from it."""
    return df.withColumn("high_water", F.max(level).over(_to_here(by, order))).withColumn("drawdown", F.try_divide(F.col("high_water") - F.col(level), F.col("high_water")))


def locf(df: DataFrame, cols: list[str], by: list[str], order: list) -> DataFrame:
    """Nulls take the last non-null value before."""
    return df.withColumns({c: F.last(c, ignorenulls=True).over(_to_here(by, order)) for c in cols})


def sas_lag(df: DataFrame, col: str, n: int, by: list[str], order: list, out: str) -> DataFrame:
    return df.withColumn(out, F.lag(col, n).over(win(by, order)))


def by_flags(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """first_k and last_k for each prefix of the BY keys."""
    desc = [F.desc(o) if isinstance(o, str) else o.desc() for o in order]
    for i in range(1, len(by) + 1):
        inner, down = by[i:], [F.desc(c) for c in by[i:]]
        df = df.withColumn(f"first_{by[i - 1]}", F.row_number().over(win(by[:i], [*inner, *order])) == 1)
        df = df.withColumn(f"last_{by[i - 1]}", F.row_number().over(win(by[:i], [*down, *desc])) == 1)
    return df


def group_rollup(df: DataFrame, by: list[str], when: str, value: str) -> DataFrame:
    """First and last date, count, total and mean of each group."""
    return df.groupBy(*by).agg(F.min(when).alias("first_at"), F.max(when).alias("last_at"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def moving_avg(df: DataFrame, value: str, k: int, by: list[str], order: list, out: str) -> DataFrame:
    """Mean of the last k rows, null before there are k."""
    w = win(by, order)
    return df.withColumn(out, F.when(F.row_number().over(w) >= k, F.avg(value).over(w.rowsBetween(1 - k, 0))))


def pct_change(df: DataFrame, value: str, by: list[str], order: list, out: str) -> DataFrame:
    before = F.lag(value).over(win(by, order))
    return df.withColumn(out, 100 * F.try_divide(F.col(value) - before, before))


def gap_velocity(df: DataFrame, key: str, ts: str, value: str, hours: list[int], tie: str) -> DataFrame:
    """The accumulating form of velocity: for each limit, count, sum and maximum over the key's rows so far
    that came within so many hours (hour marks crossed) of the row before them.  Nothing leaves again, and a
    key's first row has no row before it."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    hour = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 3600)
    since = df.withColumn("_gap", hour - F.lag(hour).over(w))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    near = lambda h, x: F.when(F.col("_gap") <= h, x)
    made = {}
    for h in hours:
        made |= {f"n_{h}h": F.count(near(h, F.lit(1))).over(upto), f"sum_{h}h": F.coalesce(F.sum(near(h, F.col(value))).over(upto), F.lit(0.0)), f"max_{h}h": F.max(near(h, F.col(value))).over(upto)}
    return since.withColumns(made).drop("_gap")


def velocity(df: DataFrame, key: str, ts: str, value: str, hours: list[int]) -> DataFrame:
    """Count, sum and maximum of a key's rows in the last h hours, itself included."""
    df = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    for h in hours:
        w = Window.partitionBy(key).orderBy("_t").rangeBetween(-h * 3_600_000_000, 0)
        df = df.withColumns({f"cnt_{h}h": F.count(F.lit(1)).over(w), f"sum_{h}h": F.sum(value).over(w), f"max_{h}h": F.max(value).over(w)})
    return df.drop("_t")


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int, order: list) -> DataFrame:
    """Session numbers per key: a new one after a gap above ``gap_seconds``."""
    w = win([key], order)
    new = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) > gap_seconds * 1_000_000
    return df.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("session", F.sum("_new").over(_to_here([key], order))).drop("_new")


def gap_days(df: DataFrame, by: list[str], ts: str, order: list, expected: int, out: str = "gap") -> DataFrame:
    """Days since the row before, and whether they exceed what is expected."""
    return df.withColumn(out, F.date_diff(ts, F.lag(ts).over(win(by, order)))).withColumn(f"{out}_flag", F.coalesce(F.col(out) > expected, F.lit(False)))


def steady_sum(value: str) -> Column:
    """The sum of a group's doubles in ascending order, so that groups of equal values tie whatever order their rows come
    in (``sum`` adds as tasks finish).  A group's values are held in one task; null without any."""
    held = F.array_sort(F.collect_list(value))
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x.cast("double")))


def proc_rank(df: DataFrame, col: str, groups: int, out: str, by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """0-based rank groups floor(rank * groups / (n + 1)), ties at their mean rank; nulls stay null.

    The distinct values are counted first, so ranks are taken over values, not rows."""
    by = by or []
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
    order = [F.desc(col) if descending else F.asc(col)]
    if by:
        upto = counts.withColumn("_u", F.sum("_c").over(_to_here(by, order))).withColumn("_all", F.sum("_c").over(Window.partitionBy(*by)))
    else:
        upto = global_running_sum(counts, F.col("_c"), order, "_u").join(F.broadcast(counts.agg(F.sum("_c").alias("_all"))))
    rank = F.col("_u") - F.col("_c") + (F.col("_c") + 1) / 2
    ranks = upto.select(*by, col, F.floor(rank * groups / (F.col("_all") + 1)).alias(out))
    return df.join(ranks, [*by, col], "left")


def proc_rank_many(df: DataFrame, cols: dict[str, tuple[str, bool]], groups: int) -> DataFrame:
    """``proc_rank`` of several columns, taken as doubles, over the whole frame: {column: (out, descending)}.

    Different values of all columns are counted and ordered together; only the ranges of values of the
    groups, so many a column, go back to the rows, so no value is joined."""
    values = F.array(*(F.struct(F.lit(c).alias("v"), F.col(c).cast("double").alias("x")) for c in cols))
    counts = df.select(F.explode(values).alias("p")).where("p.x IS NOT NULL").groupBy(F.col("p.v").alias("v"), F.col("p.x").alias("x")).agg(F.count(F.lit(1)).alias("_c"))
    upto = global_running_sum(counts, F.col("_c"), ["v", "x"], "_u")
    sizes = counts.groupBy("v").agg(F.sum("_c").alias("_all"))
    first = sizes.select(F.col("v"), "_all", (F.sum("_all").over(Window.orderBy("v")) - F.col("_all")).alias("_before"))  # a row a column
    at = upto.join(F.broadcast(first), "v").withColumn("_u", F.col("_u") - F.col("_before"))
    down = F.col("v").isin([c for c, (_, descending) in cols.items() if descending])
    rank = F.when(down, F.col("_all") - F.col("_u")).otherwise(F.col("_u") - F.col("_c")) + (F.col("_c") + 1) / 2
    ranges = at.groupBy("v", F.floor(rank * groups / (F.col("_all") + 1)).alias("g")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    one = ranges.agg(F.collect_list(F.struct("v", "g", "lo", "hi")).alias("_ranges"))
    out = df.join(F.broadcast(one))
    for c, (name, _) in cols.items():
        x = F.col(c).cast("double")
        out = out.withColumn(name, F.get(F.filter("_ranges", _holds(c, x)), F.lit(0))["g"])
    return out.drop("_ranges")


def _holds(column: str, x: Column):
    return lambda r: (r["v"] == column) & (r["lo"] <= x) & (x <= r["hi"])


def cum_share(df: DataFrame, value: str, order: list, out: str, by: list[str] | None = None) -> DataFrame:
    """Running total as a share of the total; ``order`` must settle ties."""
    if by:
        return df.withColumn(out, F.try_divide(F.sum(value).over(_to_here(by, order)), F.sum(value).over(Window.partitionBy(*by))))
    total = df.agg(F.sum(value).alias("_all"))
    return global_running_sum(df, F.col(value), order, "_run").join(F.broadcast(total)).withColumn(out, F.try_divide("_run", "_all")).drop("_run", "_all")


def streak(df: DataFrame, by: list[str], newest_first: list, cond: Column) -> DataFrame:
    """How many of the newest rows of each group fulfil ``cond`` without a break."""
    held = F.min(F.coalesce(cond, F.lit(False)).cast("int")).over(_to_here(by, newest_first))
    return df.select(*by, held.alias("_h")).groupBy(*by).agg(F.sum("_h").alias("streak"))
