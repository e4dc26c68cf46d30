"""Streams that go on after a failure: batches written under their number, restarts from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_resumable(df: DataFrame, sink: str, checkpoint: str, step: Callable[[DataFrame, int], DataFrame] | None = None, restarts: int = 3) -> int:
    """Write what ``step`` makes of every micro-batch to ``sink``, until all that is there is read; the number of restarts.

    A batch has a folder of its own, named by its number, which a repeated batch replaces; the
    checkpoint names the last batch that was written whole.  So a batch that fails midway leaves nothing behind
    that counts, whoever restarts it: this call, up to ``restarts`` times in a row on the same batch, or a later one."""

    def write(batch: DataFrame, number: int) -> None:
        out = step(batch, number) if step else batch
        out.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    tries, stuck_at, total = 0, None, 0
    while True:
        query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            return total
        except StreamingQueryException:
            done = last_batch(df.sparkSession, checkpoint)
            tries = tries + 1 if done == stuck_at else 1
            stuck_at, total = done, total + 1
            if tries > restarts:
                raise


def _listed(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


def last_batch(spark: SparkSession, checkpoint: str) -> int:
    """The number of the last batch that the checkpoint holds as written whole; -1 for none."""
    return max((int(n) for n in _listed(spark, f"{checkpoint}/commits") if n.isdigit()), default=-1)


def written(spark: SparkSession, sink: str, checkpoint: str, schema: str) -> DataFrame:
    """The rows of all batches that were written whole, with column batch."""
    rows = spark.read.schema(f"{schema}, batch int").option("basePath", sink)
    last = last_batch(spark, checkpoint)
    return rows.parquet(sink).where(F.col("batch") <= last) if last >= 0 else spark.createDataFrame([], f"{schema}, batch int")


def clear(spark: SparkSession, checkpoint: str) -> None:
    """Forget what was read, so that the next run begins anew."""
    where = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
