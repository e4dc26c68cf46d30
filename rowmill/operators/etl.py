"""Incremental loads, slowly changing dimensions, change capture, rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions import dates
from rowmill.operators.ordered import add_sequence

OPEN_END = "9999-12-31"


def row_hash(cols: list[str]) -> Column:
    """md5 over the columns, each with its length before it, so that no two rows of other
    values are written alike; nulls are told from empty text."""
    field = lambda v: F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("n"))
    return F.md5(F.concat(*(field(F.col(c).cast("string")) for c in cols)))


def scd2(dim: DataFrame, stage: DataFrame, key: str, tracked: list[str], as_of: str) -> DataFrame:
    """Type-2 merge.  ``dim`` has dim_key, key, tracked, effective_from, effective_to, current_flag.

    Changed rows are closed the day before ``as_of`` and a new version is opened;
    new keys open one.  Surrogate keys go on after the highest."""
    day = F.lit(as_of).cast("date")
    incoming = stage.select(key, *(F.col(c).alias(f"_n_{c}") for c in tracked), F.lit(True).alias("_in"))
    differs = F.lit(False)
    for c in tracked:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    joined = dim.join(incoming, key, "left").withColumn("_changed", F.col("current_flag") & F.coalesce("_in", F.lit(False)) & differs)
    kept = joined.withColumn("effective_to", F.when(F.col("_changed"), F.date_sub(day, 1)).otherwise(F.col("effective_to"))).withColumn("current_flag", F.col("current_flag") & ~F.col("_changed"))
    same = joined.where(F.col("current_flag") & ~F.col("_changed")).select(key)
    top = dim.agg(F.coalesce(F.max("dim_key"), F.lit(0)).alias("_top"))
    fresh = stage.select(key, *tracked).join(same, key, "left_anti").join(F.broadcast(top))
    fresh = add_sequence(fresh, [key], "_seq").withColumn("dim_key", F.col("_top") + F.col("_seq")).select(F.col("dim_key").cast(dim.schema["dim_key"].dataType), key, *tracked, day.alias("effective_from"), F.lit(OPEN_END).cast("date").alias("effective_to"), F.lit(True).alias("current_flag"))
    return kept.select(*fresh.columns).unionByName(fresh)


def upsert(target: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Rows of ``delta`` replace those of the same key (type-1 change, delete-then-insert)."""
    return target.join(delta, key, "left_anti").unionByName(delta.select(*target.columns))


def extract_since(df: DataFrame, ts: str, mark=None) -> DataFrame:
    """All rows without a mark, else those after it."""
    return df if mark is None else df.where(F.col(ts) > F.lit(mark))


def cdc(curr: DataFrame, prev: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """key and operation INSERT, UPDATE or DELETE, by row hashes."""
    a, b = curr.select(key, row_hash(cols).alias("_h")), prev.select(key, row_hash(cols).alias("_p"))
    op = F.when(F.col("_p").isNull(), "INSERT").when(F.col("_h").isNull(), "DELETE").when(F.col("_h") != F.col("_p"), "UPDATE")
    return a.join(b, key, "full").select(key, op.alias("operation")).where(F.col("operation").isNotNull())


def resolve_keys(fact: DataFrame, dims: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Natural to surrogate keys: column -> (current dimension rows, natural key, surrogate key)."""
    for col, (dim, natural, surrogate) in dims.items():
        fact = fact.join(dim.select(F.col(natural).alias(col), F.col(surrogate).alias(f"{col}_sk")), col, "left")
    return fact


def orphans(fact: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with an unresolved key, and the list of these keys."""
    return fact.withColumn("missing_keys", F.concat_ws(",", *(F.when(F.col(k).isNull(), k) for k in keys))).where(F.col("missing_keys") != "")


def split_by_age(df: DataFrame, date: str, as_of: str, days: int) -> tuple[DataFrame, DataFrame]:
    """(to keep, to archive)."""
    old = F.date_diff(F.lit(as_of).cast("date"), date) > days
    return df.where(~old), df.where(old)


def apply_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Active rules by category and priority: RENAME, DERIVE, FORMAT, RECODE and FILTER.

    A rule has category, priority, active, target and expression."""
    rank = {c: i for i, c in enumerate(("RENAME", "DERIVE", "FORMAT", "RECODE", "FILTER"))}
    for r in sorted((r for r in rules if r.get("active", True)), key=lambda r: (rank[r["category"]], r["priority"])):
        if r["category"] == "RENAME":
            df = df.withColumnRenamed(r["expression"], r["target"])
        elif r["category"] == "FILTER":
            df = df.where(F.expr(r["expression"]))
        else:
            df = df.withColumn(r["target"], F.expr(r["expression"]))
    return df


def reconciled_load(target: DataFrame, source: DataFrame, key: str, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """(loaded rows, one row of counts): a full load takes the source alone, an incremental one upserts it."""
    loaded = source.select(*target.columns) if full else upsert(target, source, key)
    n = lambda df, name: F.broadcast(df.agg(F.count(F.lit(1)).alias(name)))
    same = target.join(source.select(key).distinct(), key, "left_semi")
    counts = n(target, "rows_before").join(n(source, "rows_source")).join(n(same, "rows_replaced")).join(n(loaded, "rows_after"))
    due = F.col("rows_source") if full else F.col("rows_before") - F.col("rows_replaced") + F.col("rows_source")
    return loaded, counts.withColumn("result", F.when(due == F.col("rows_after"), "PASS").otherwise("FAIL"))


def load_log(frames: dict[str, DataFrame], ts: dict[str, str], run_id: str) -> DataFrame:
    """One row a table: run, rows and high-water mark (the latest value of its ``ts`` column)."""
    one = lambda t: frames[t].agg(F.lit(run_id).alias("run_id"), F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.max(ts[t]).cast("timestamp").alias("high_water"))
    return reduce(DataFrame.unionByName, map(one, frames))


def period_range(as_of: Column, period: str, first: int = 1) -> tuple[Column, Column]:
    """(first day, last day) of the month, quarter or year that holds the date; YTD ends at the date.
    A year may begin at month ``first``."""
    unit = {"MTH": "month", "QTR": "qtr", "YTD": "year", "YR": "year"}[period]
    return dates.intnx(unit, as_of, 0, "B", first), as_of if period == "YTD" else dates.intnx(unit, as_of, 0, "E", first)


def for_each_group(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """What a loop over the values of ``keys`` would make, in one pass."""
    return df.groupBy(*keys).agg(*(e.alias(n) for n, e in measures.items()))


def stamp(df: DataFrame, **literals) -> DataFrame:
    """Constant columns such as a load time and a run number, which the caller gives."""
    return df.withColumns({k: F.lit(v) for k, v in literals.items()})
