"""Detected spans held against expected ones: matches within a tolerance, and what missed ones were taken for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a segment in the search for the nearest start, so that a file of any length is dealt.
SEGMENT = 1024


def nearest_start(points: DataFrame, asks: DataFrame, file: str, at: str, segment: int = SEGMENT) -> DataFrame:
    """``asks`` (file, at) with the struct ``near``: gap, pid and kind of the point of the same file whose ``at`` is
    nearest, ties to the smaller pid; null where the file has none.  ``points`` has columns file, at, pid, kind.

    Points and asks are sorted together in segments of positions; beyond its segment a row needs
    only the last point of those before and the first of those after, which are windows over segments."""
    first = points.where(F.col(at).isNotNull()).groupBy(file, at).agg(F.min(F.struct("pid", "kind")).alias("p"))
    point = first.select(file, at, F.struct(F.col(at).alias("x"), F.col("p.pid").alias("pid"), F.col("p.kind").alias("kind")).alias("point"))
    both = asks.where(F.col(at).isNotNull()).select(file, at).distinct().withColumn("ask", F.lit(True)).unionByName(point, allowMissingColumns=True)
    both = both.withColumn("seg", F.floor(F.col(at) / segment))
    here = Window.partitionBy(file, "seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("below", F.last("point", True).over(here.orderBy(at, F.col("ask").asc_nulls_first())))
    both = both.withColumn("above", F.last("point", True).over(here.orderBy(F.desc(at), F.col("ask").asc_nulls_first())))
    ends = both.groupBy(F.col(file).alias("_f"), F.col("seg").alias("_s")).agg(F.min("point").alias("lo"), F.max("point").alias("hi"))
    by = Window.partitionBy("_f").orderBy("_s")
    ends = ends.withColumn("before", F.last("hi", True).over(by.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first("lo", True).over(by.rowsBetween(1, Window.unboundedFollowing))).drop("lo", "hi")
    found = both.where("ask").join(ends, F.col(file).eqNullSafe(F.col("_f")) & (F.col("seg") == F.col("_s")), "left")
    gap = lambda p: F.when(p.isNotNull(), F.struct(F.abs(p["x"] - F.col(at)).alias("gap"), p["pid"].alias("pid"), p["kind"].alias("kind")))
    near = F.least(gap(F.coalesce("below", "before")), gap(F.coalesce("above", "after")))
    found = found.select(F.col(file).alias("_f"), F.col(at).alias("_x"), near.alias("near"))
    return asks.join(found, F.col(file).eqNullSafe(F.col("_f")) & (F.col(at) == F.col("_x")), "left").drop("_f", "_x")


def match_spans(pred: DataFrame, gold: DataFrame, tol: int) -> DataFrame:
    """``gold`` (file, kind, start, end, gid) with pid, the smallest id of a span of ``pred`` (file, kind, start, end, pid) of
    the same file and kind whose start and end are both within ``tol``, or null; and for these ``near``, the span of any
    kind with the nearest start.  One detected span may answer several expected ones.

    Equal spans count once before they meet, in cells of both positions, so a line with
    very many spans forms no pairs beyond its different ones."""
    width = tol + 1
    cell = lambda c: F.floor(F.col(c) / width)
    span = ["file", "kind", "start", "end"]
    p = pred.groupBy(*span).agg(F.min("pid").alias("pid")).select("file", "kind", F.col("start").alias("ps"), F.col("end").alias("pe"), "pid", cell("start").alias("cs"), cell("end").alias("ce"))
    g = gold.select(*span).distinct()
    around = g.withColumn("cs", F.explode(F.array(*(cell("start") + i for i in (-1, 0, 1))))).withColumn("ce", F.explode(F.array(*(cell("end") + i for i in (-1, 0, 1)))))
    near = (F.abs(F.col("start") - F.col("ps")) <= tol) & (F.abs(F.col("end") - F.col("pe")) <= tol)
    hit = around.join(p, ["file", "kind", "cs", "ce"]).where(near).groupBy(*span).agg(F.min("pid").alias("pid"))
    matched = gold.join(hit, span, "left")
    starts = pred.select("file", F.col("start").alias("at"), "pid", "kind")
    missed = matched.where("pid IS NULL").withColumn("at", F.col("start"))
    missed = nearest_start(starts, missed, "file", "at").drop("at")
    return matched.where("pid IS NOT NULL").unionByName(missed, allowMissingColumns=True)


def span_files(pred: DataFrame, matched: DataFrame) -> DataFrame:
    """file, detected, gold and correct, and accuracy to four places (null where nothing was expected)."""
    found = pred.groupBy("file").agg(F.count(F.lit(1)).alias("detected"))
    want = matched.groupBy("file").agg(F.count(F.lit(1)).alias("gold"), F.count("pid").alias("correct"))
    out = found.join(want, "file", "full").fillna(0, ["detected", "gold", "correct"])
    return out.withColumn("accuracy", F.round(F.try_divide("correct", "gold"), 4))


def span_summary(files: DataFrame, target: float = 0.8) -> DataFrame:
    """One row: correct, total, accuracy and whether it reaches ``target``; 0 where nothing was expected."""
    out = files.agg(F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"), F.coalesce(F.sum("gold"), F.lit(0)).alias("total"))
    share = F.coalesce(F.try_divide("correct", "total"), F.lit(0.0))
    return out.withColumn("accuracy", F.round(share, 4)).withColumn("passed", share >= target)


def span_confusion(matched: DataFrame) -> DataFrame:
    """taken_for and kind with the number of missed spans; those of files without any detected span are left out."""
    return matched.where("near IS NOT NULL").groupBy(F.col("near.kind").alias("taken_for"), "kind").agg(F.count(F.lit(1)).alias("missed"))
