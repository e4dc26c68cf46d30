"""Exact quantiles without a group's values in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.operators.ordered import bucketed


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], times: str | None = None) -> DataFrame:
    """``by`` and one column a quantile, interpolated between neighbours, over the group's non-null values;
    with ``times``, a column of whole numbers, each row stands for so many.

    Different values are counted, dealt to stored range buckets and counted up bucket by bucket, so that
    only the buckets that hold a wanted place are read again; no task holds more than a bucket, whatever
    the size of its group.  Null is a group; a group without values has no row (without ``by``: a row of nulls)."""
    keys = [f"_k{i}" for i in range(len(by))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("_x")).agg((F.sum(times) if times else F.count(F.lit(1))).alias("_c"))
    rows = bucketed(counts, [*keys, "_x"])

    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*keys, "_b").agg(F.sum("_c").alias("_t"))
    parts = parts.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0))).withColumn("_n", F.sum("_t").over(Window.partitionBy(*keys)))
    at = {name: F.lit(p) * (F.col("_n") - 1) for name, p in probs.items()}
    places = [f(x) for x in at.values() for f in (F.floor, F.ceil)]
    wanted = F.lit(False)
    for place in places:
        wanted = wanted | ((place >= F.col("_o")) & (place < F.col("_o") + F.col("_t")))
    parts = parts.where(wanted).select(*(F.col(k).alias(f"{k}p") for k in keys), F.col("_b").alias("_bp"), "_o", "_n")

    same = F.col("_b") == F.col("_bp")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}p"))
    upto = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.join(parts, same).withColumn("_end", F.col("_o") + F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))

    def there(place: Column) -> Column:
        return F.max(F.when((place >= F.col("_start")) & (place < F.col("_end")), F.col("_x")))

    found = near.groupBy(*keys).agg(F.max("_n").alias("_n"), *(there(f(x)).alias(f"{s}{i}") for i, x in enumerate(at.values()) for s, f in (("_l", F.floor), ("_h", F.ceil))))
    out = []
    for i, (name, x) in enumerate(at.items()):
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        out.append(F.when(F.floor(x) == F.ceil(x), low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high).alias(name))
    return found.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), *out)


def melted(df: DataFrame, keep: dict[str, Column], columns: list[str]) -> DataFrame:
    """``keep``, and for each column a row with its name (_var) and value as double (_x): several columns as one."""
    each = F.array(*(F.struct(F.lit(c).alias("_var"), F.col(c).cast("double").alias("_x")) for c in columns))
    return df.select(*(c.alias(n) for n, c in keep.items()), F.explode(each).alias("_v")).select(*keep, "_v._var", "_v._x")
