"""Streaming twins of batch operators; each takes and returns a streaming frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_daily(df: DataFrame, ts: str, ok, value: str, late: str = "1 day") -> DataFrame:
    """Rows, successes and mean value by day of event time."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"), F.avg(value).alias("mean_value")).select(F.col("w.start").cast("date").alias("day"), "n", "ok", "mean_value")


def stream_velocity(df: DataFrame, key: str, ts: str, value: str, size: str = "24 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of each key in sliding windows; rows past the watermark are dropped."""
    return df.withWatermark(ts, late).groupBy(key, F.window(ts, size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def stream_dedup(df: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def stream_sessions(df: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return df.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_route(df: DataFrame, score: str, edges: list[tuple[float, str]], default: str) -> DataFrame:
    """The first queue whose least score is reached."""
    out = F.lit(default)
    for low, queue in sorted(edges):
        out = F.when(F.col(score) >= low, queue).otherwise(out)
    return df.withColumn("queue", out)


def run_batches(df: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Apply ``step`` to every micro-batch that is there, then stop; it resumes at the checkpoint."""
    df.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
