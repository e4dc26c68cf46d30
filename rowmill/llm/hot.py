"""Facts of groups joined to their rows, where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of more rows than this, and than one row in LEAST_SHARE of all, count as hot.
LEAST_ROWS, LEAST_SHARE = 64, 100_000


def attach(rows: DataFrame, groups: DataFrame, on: list[str], size: str, n_rows: int) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row a key, null a key like others) on ``on``.

    ``size`` is the number of rows of a group.  Groups of more than
    max(LEAST_ROWS, n_rows / LEAST_SHARE) rows are at most LEAST_SHARE, so these are
    sent to every task; the rows of all other groups meet them by a shuffle in which
    no key has more rows than that."""
    limit = max(LEAST_ROWS, n_rows // LEAST_SHARE)
    facts = [c for c in groups.columns if c not in on]
    named = groups.select(*(F.col(c).alias(f"_k_{c}") for c in on), F.struct(*facts).alias("_facts"))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    keys = [f"_k_{c}" for c in on]
    hot = named.where(F.col(f"_facts.{size}") > limit)
    tried = rows.join(F.broadcast(hot), same, "left").drop(*keys)
    cold = tried.where(F.col("_facts").isNull()).drop("_facts").join(named.where(F.col(f"_facts.{size}") <= limit), same, "left").drop(*keys)
    out = tried.where(F.col("_facts").isNotNull()).unionByName(cold)
    return out.select(*(F.col(c) for c in rows.columns), "_facts.*")
