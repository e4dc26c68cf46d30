"""Folds and bounded labelled samples shared by the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, k: int) -> Column:
    """crc32 of the key's text, modulo k; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % k


def held_out(key: Column, k: int, at: int) -> Column:
    return F.coalesce(fold(key, k) == at, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int) -> DataFrame:
    """Columns doc_id, text, y of the labelled documents for which ``keep`` (over
    doc_id) holds, about ``max_rows`` of them at most.

    The sample is drawn by a hash of doc_id at the rate max_rows / labelled rows,
    so it is the same in every run and its size is bounded; it is small enough to
    be sent to every executor, so the texts themselves are never shuffled.
    Null labels and null ids take no part; an id labelled twice counts once."""
    lab = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & keep)
    lab = lab.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = lab.count()
    rate = min(1.0, max_rows / max(n, 1))
    if rate < 1:
        lab = lab.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(rate * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id")
