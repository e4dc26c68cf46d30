"""Cutting plans: tables kept in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; on one machine, one of its own where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet in the shared folder and read from there: a plan of one scan, and work that a lost
    executor does not undo.  It is computed once, and nothing of the old plan stays: a checkpointed frame keeps
    the constraints of its plan, which in a loop can double every round."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Delete the files of cut frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_cut_at", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"
