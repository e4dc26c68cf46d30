"""Match-merges, lookups, range and window joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_by(a: DataFrame, b: DataFrame, by: list[str], keep: str = "any", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Match-merge with in_a and in_b; keep: any, a, b or both.  Clashing columns get suffixes."""
    clash = [c for c in a.columns if c in b.columns and c not in by]
    left = a.withColumnsRenamed({c: c + suffixes[0] for c in clash}).withColumn("in_a", F.lit(True))
    right = b.withColumnsRenamed({c: c + suffixes[1] for c in clash}).withColumn("in_b", F.lit(True))
    out = left.join(right, by, {"any": "full", "a": "left", "b": "right", "both": "inner"}[keep])
    return out.withColumns({f: F.coalesce(f, F.lit(False)) for f in ("in_a", "in_b")})


def zip_merge(a: DataFrame, b: DataFrame, by: list[str], order_a: list, order_b: list) -> DataFrame:
    """Sequential match-merge: rows pair by position in their group, the shorter side's
    last row is carried on, and the right side overlays columns of the same name."""
    sides = []
    for df, order, tag in ((a, order_a, "l"), (b, order_b, "r")):
        n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        sides.append(df.select(*by, n.alias("_n"), F.struct(*(c for c in df.columns if c not in by)).alias(tag)))
    w = Window.partitionBy(*by).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    both = sides[0].join(sides[1], [*by, "_n"], "full").withColumns({t: F.last(t, ignorenulls=True).over(w) for t in ("l", "r")})
    own, other = ([c for c in df.columns if c not in by] for df in (a, b))
    picked = [F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")).alias(c) if c in other else F.col(f"l.{c}") for c in own]
    return both.select(*by, F.col("_n").alias("_seq"), *picked, *(F.col(f"r.{c}") for c in other if c not in own))


def panel_join(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Full join of waves on their key, with a flag in_<wave> for each."""
    tagged = [df.withColumn(f"in_{n}", F.lit(True)) for n, df in frames.items()]
    out = reduce(lambda x, y: x.join(y, key, "full"), tagged)
    return out.withColumns({f"in_{n}": F.coalesce(f"in_{n}", F.lit(False)) for n in frames})


def lookup(df: DataFrame, dim: DataFrame, keys: list[str], cols: dict[str, object]) -> DataFrame:
    """Columns of ``dim`` (one row a key is used, the least) with defaults on a miss.
    Spark broadcasts ``dim`` where its size allows."""
    one = dim.groupBy(*keys).agg(F.min(F.struct(*cols)).alias("_d"))
    out = df.join(one, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_d.{c}"), F.lit(v)) for c, v in cols.items()}).drop("_d")


def range_join(a: DataFrame, b: DataFrame, value: str, lo: str, hi: str, width: float, equal: list[str] | None = None, how: str = "inner") -> DataFrame:
    """a.value between b.lo and b.hi: both sides meet in bins of ``width``, so no pair
    of unrelated rows is ever formed."""
    bins = F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    right = b.withColumn("_bin", bins)
    left = a.withColumn("_bin", F.floor(F.col(value) / width))
    on = [left[k].eqNullSafe(right[k]) for k in equal or []] + [left["_bin"] == right["_bin"], F.col(value).between(F.col(lo), F.col(hi))]
    return left.join(right, on, how).drop("_bin")


def window_join(a: DataFrame, b: DataFrame, key: str, ta: str, tb: str, max_days: int) -> DataFrame:
    """Rows of b for the same key that follow a row of a within ``max_days`` days.

    Both sides meet in bins of ``max_days``: a row of a in its own bin and the next, so a
    key of very many rows is dealt over its bins and only rows near in time are paired."""
    bin_of = lambda ts: F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (max(max_days, 1) * 86_400_000_000))
    left = a.withColumn("_w", F.explode(F.array(bin_of(ta), bin_of(ta) + 1)))
    right = b.withColumnRenamed(key, "_k").withColumn("_wr", bin_of(tb))
    near = (F.col(tb) >= F.col(ta)) & (F.col(tb) <= F.col(ta) + F.make_dt_interval(days=F.lit(max_days)))
    return left.join(right, (left[key] == right["_k"]) & (left["_w"] == right["_wr"]) & near).drop("_k", "_w", "_wr")


def vs_group_mean(df: DataFrame, keys: list[str], value: str, k: float = 1.0) -> DataFrame:
    """Rows above k times the mean of their group."""
    return df.withColumn("group_mean", F.avg(value).over(Window.partitionBy(*keys))).where(F.col(value) > k * F.col("group_mean"))


def attach_latest(df: DataFrame, other: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The newest row of ``other`` for each key, as struct column latest."""
    newest = other.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in other.columns if c not in keys)), F.col(ts)).alias("latest"))
    return df.join(newest, keys, "left")


def semi(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other, keys, "left_semi")


def anti(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other, keys, "left_anti")


def yoy_join(df: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    """The value of the same period a year before."""
    past = df.select(F.col(entity).alias("_e"), F.add_months(period, 12).alias("_p"), F.col(value).alias(f"{value}_prior"))
    return df.join(past, (df[entity] == past["_e"]) & (df[period] == past["_p"]), "left").drop("_e", "_p")


def any_of(*conds: Column) -> Column:
    return reduce(lambda x, y: x | y, conds)


def merge_many(driver: DataFrame, others: list[tuple[DataFrame, list[str]]], by: list[str]) -> DataFrame:
    """The rows of ``driver`` with the named columns of the others, which have one row a key."""
    return reduce(lambda x, y: x.join(y[0].select(*by, *y[1]), by, "left"), others, driver)


def convert_currency(df: DataFrame, rates: DataFrame, amount: str, currency: str, base: str, on_missing: float | None = None, out: str = "amount_base") -> DataFrame:
    """Amounts in the base currency; ``rates`` has one row (currency, rate) each, the base's rate is 1."""
    one = rates.groupBy(F.col(currency)).agg(F.max("rate").alias("_r"))
    rate = F.when(F.col(currency) == base, 1.0).otherwise(F.coalesce("_r", F.lit(on_missing)))
    return df.join(one, currency, "left").withColumn(out, F.col(amount) * rate).drop("_r")


def tolerance_join(pred: DataFrame, gold: DataFrame, keys: list[str], cols: list[str], tol: int, gold_id: str, pred_id: str) -> DataFrame:
    """For each gold row the first predicted row (smallest id) of the same keys all of whose ``cols`` are within ``tol``.

    The first column is dealt into bins a little wider than ``tol``, so rows far apart never meet."""
    width = 2 * tol + 1
    p = pred.select(*keys, *(F.col(c).alias(f"_p_{c}") for c in cols), F.col(pred_id), F.floor(F.col(cols[0]) / width).alias("_bin"))
    own = F.floor(F.col(cols[0]) / width)
    g = gold.withColumn("_bin", F.explode(F.array(own - 1, own, own + 1)))
    near = reduce(lambda x, y: x & y, (F.abs(F.col(c) - F.col(f"_p_{c}")) <= tol for c in cols))
    return g.join(p, [*keys, "_bin"]).where(near).groupBy(gold_id).agg(F.min(pred_id).alias(pred_id))
