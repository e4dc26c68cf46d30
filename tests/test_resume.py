"""A stream whose batch fails midway, restarted, against one that runs clean."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rowmill import sources
from rowmill.operators.cut import fresh_path
from rowmill.streaming import resume

KIND = "id long, v long"


@pytest.fixture
def stream(spark):
    path = fresh_path(spark)
    for i in range(5):
        spark.range(i * 100, i * 100 + 100, numPartitions=1).select("id", (F.col("id") * 2).alias("v")).coalesce(1).write.mode("append").parquet(path)
    return sources.stream_files(spark, path, spark.createDataFrame([], KIND).schema, max_files=1)


class Failing:
    """Fails at some batches, once each, or always: in a task, after other rows of the batch were written."""

    def __init__(self, at, always=False):
        self.left, self.always, self.seen = set(at), always, []

    def __call__(self, batch, number):
        self.seen.append(number)
        if number in self.left:
            if not self.always:
                self.left.discard(number)
            return batch.repartition(4).withColumn("v", F.when(F.col("id") % 50 == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
        return batch


def rows(spark, sink, at):
    return sorted((r.id, r.v) for r in resume.written(spark, sink, at, KIND).collect())


def test_failing_and_clean_run_give_one_table(spark, stream):
    clean, at = fresh_path(spark), fresh_path(spark)
    assert resume.run_resumable(stream, clean, at) == 0
    sink, mark, step = fresh_path(spark), fresh_path(spark), Failing({1, 3})
    assert resume.run_resumable(stream, sink, mark, step) == 2
    assert step.seen == [0, 1, 1, 2, 3, 3, 4] and resume.last_batch(spark, mark) == 4
    assert rows(spark, sink, mark) == rows(spark, clean, at) == [(i, 2 * i) for i in range(500)]


def test_a_later_run_goes_on_where_one_gave_up(spark, stream):
    sink, at = fresh_path(spark), fresh_path(spark)
    with pytest.raises(StreamingQueryException):
        resume.run_resumable(stream, sink, at, Failing({2}, always=True), restarts=1)
    assert resume.last_batch(spark, at) == 1 and len(rows(spark, sink, at)) == 200  # nothing of the failed batch counts
    step = Failing(set())
    resume.run_resumable(stream, sink, at, step)
    assert step.seen == [2, 3, 4] and len(rows(spark, sink, at)) == 500
    resume.run_resumable(stream, sink, at, step)
    assert step.seen == [2, 3, 4]
    resume.clear(spark, at)
    assert resume.last_batch(spark, at) == -1 and rows(spark, sink, at) == []
