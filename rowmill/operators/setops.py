"""Sorting, de-duplication by key, top-k, stacking and transposition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordering(by: list[str]) -> list:
    """Sort keys; "-c" is descending.  Missing values are lowest in either direction."""
    return [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_first(c) for c in by]


def proc_sort(df: DataFrame, by: list[str]) -> DataFrame:
    return df.orderBy(*ordering(by))


def nodupkey(df: DataFrame, by: list[str], order: list[str], dupout: bool = False) -> DataFrame:
    """The first row of each key in ``order``; with ``dupout`` the others."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*ordering(order)))
    return df.withColumn("_n", n).where(F.col("_n") > 1 if dupout else F.col("_n") == 1).drop("_n")


def latest_per_key(df: DataFrame, by: list[str], ts: str, tie: str) -> DataFrame:
    return nodupkey(df, by, [f"-{ts}", f"-{tie}"])


def top_k(df: DataFrame, k: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The first k rows in ``order``, over all or per group."""
    if not by:
        return df.orderBy(*ordering(order)).limit(k)
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*ordering(order)))
    return df.withColumn("rank", n).where(F.col("rank") <= k)


def stack_tables(frames: dict[str, DataFrame], flag: str = "source_table") -> DataFrame:
    """Concatenation by column name, filled with nulls, with the table's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(flag, F.lit(n)) for n, df in frames.items()))


def interleave(frames: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Concatenation in key order; equal keys keep the order of the tables."""
    place = {n: i for i, n in enumerate(frames)}
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("source_index", F.lit(place[n])) for n, df in frames.items()))
    return stacked.orderBy(*ordering(by), "source_index")


def transpose(df: DataFrame, by: list[str], ident: str, var: str, values: list, prefix: str = "") -> DataFrame:
    """Long to wide over the given values of ``ident``."""
    wide = df.groupBy(*by).pivot(ident, values).agg(F.first(var, ignorenulls=True))
    return wide.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values})


def untranspose(df: DataFrame, ids: list[str], cols: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, cols, name, value)


def noduprec(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in ``order``, which must settle ties."""
    return df.orderBy(*ordering(order)).limit(n)


def union(a: DataFrame, b: DataFrame, all_rows: bool = True) -> DataFrame:
    both = a.unionByName(b)
    return both if all_rows else both.distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
