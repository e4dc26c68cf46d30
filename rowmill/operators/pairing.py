"""One-to-one matching of two sets of amounts within a tolerance, no row used twice."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.operators.cut import cut
from rowmill.operators.ordered import global_lag, global_running_sum


def match_one_to_one(a: DataFrame, b: DataFrame, ref: str, amount: str, id_a: str, id_b: str, tol: float) -> DataFrame:
    """Rows of ``a`` and ``b`` of the same reference, paired one to one: ref, both ids, amount_a, amount_b, status, reason.

    Equal amounts pair first, in order of id (EXACT).  What is left is merged in order of amount: the
    smallest open amounts of the two sides pair if they are within ``tol`` (TOLERANCE), otherwise the smaller
    one stays alone (ONLY_A, ONLY_B).  reason is null for pairs; for a row alone it is USED where the other
    side has an amount within ``tol`` that went to another row, DIFFERENCE where it has the reference only
    with amounts further off, and NONE where it lacks the reference.  A null reference or amount is alone with
    reason NONE.

    The merge needs no group in one task: where amounts of a reference lie more than ``tol`` apart, nothing
    passes from one side of the gap to the other, so the runs between such gaps are dealt to tasks, which
    read them in order and hold only the rows that are still open."""
    side = lambda df, i: df.select(F.col(ref).alias("ref"), F.col(amount).alias("amount"), F.col(i).alias("id"))
    known = F.col("ref").isNotNull() & F.col("amount").isNotNull()
    left, right = cut(side(a, id_a)), cut(side(b, id_b))
    numbered = lambda df: df.where(known).withColumn("n", F.row_number().over(Window.partitionBy("ref", "amount").orderBy("id")))
    both = numbered(left).withColumnRenamed("id", "ia").join(numbered(right).withColumnRenamed("id", "ib"), ["ref", "amount", "n"], "full")
    both = cut(both.select("ref", "amount", "ia", "ib"))
    exact = both.where("ia IS NOT NULL AND ib IS NOT NULL").select("ref", "ia", "ib", F.col("amount").alias("amount_a"), F.col("amount").alias("amount_b"), F.lit("EXACT").alias("status"))

    rest = both.where("ia IS NULL OR ib IS NULL").select("ref", "amount", F.col("ib").isNotNull().alias("of_b"), F.coalesce("ia", "ib").alias("id"))
    merged = _merge(rest, tol)
    alone = merged.where("ia IS NULL OR ib IS NULL")
    of_a = _with_reason(alone.where("ib IS NULL").select("ref", F.col("amount_a").alias("amount"), F.col("ia").alias("id")), right, tol, "ONLY_A")
    of_b = _with_reason(alone.where("ia IS NULL").select("ref", F.col("amount_b").alias("amount"), F.col("ib").alias("id")), left, tol, "ONLY_B")
    lost = left.where(~known).select("*", F.lit("ONLY_A").alias("status")).unionByName(right.where(~known).select("*", F.lit("ONLY_B").alias("status"))).withColumn("reason", F.lit("NONE"))
    singles = of_a.unionByName(of_b).unionByName(lost)
    on_a = F.col("status") == "ONLY_A"
    singles = singles.select("ref", F.when(on_a, F.col("id")).alias("ia"), F.when(~on_a, F.col("id")).alias("ib"), F.when(on_a, F.col("amount")).alias("amount_a"), F.when(~on_a, F.col("amount")).alias("amount_b"), "status", "reason")
    near = merged.where("ia IS NOT NULL AND ib IS NOT NULL").select("ref", "ia", "ib", "amount_a", "amount_b", F.lit("TOLERANCE").alias("status"))
    pairs = exact.unionByName(near).withColumn("reason", F.lit(None).cast("string"))
    return pairs.unionByName(singles).select(F.col("ref").alias(ref), F.col("ia").alias(id_a), F.col("ib").alias(id_b), "amount_a", "amount_b", "status", "reason")


def _merge(rest: DataFrame, tol: float) -> DataFrame:
    """(ref, ia, ib, amount_a, amount_b) of the merge; one side is null for a row that stays alone."""
    order = ["ref", "amount", "of_b", "id"]
    lagged = global_lag(rest.withColumn("here", F.struct("ref", "amount")), "here", order, "before")
    begins = F.coalesce((F.col("before.ref") != F.col("ref")) | (F.col("amount") - F.col("before.amount") > tol), F.lit(True))
    runs = global_running_sum(lagged.withColumn("begins", begins.cast("long")).drop("here", "before"), F.col("begins"), order, "run")
    dealt = runs.repartition("run").sortWithinPartitions("run", "amount", "of_b", "id")
    kind = {f.name: f.dataType for f in rest.schema.fields}
    out = f"ref {kind['ref'].simpleString()}, ia {kind['id'].simpleString()}, ib {kind['id'].simpleString()}, amount_a {kind['amount'].simpleString()}, amount_b {kind['amount'].simpleString()}"

    def pair(batches):
        run, open_rows = None, deque()  # rows of one side only, by amount
        for batch in batches:
            done = []
            for now, row in zip(batch.column("run").to_pylist(), zip(*(batch.column(c).to_pylist() for c in order), strict=True), strict=True):
                if now != run:
                    done += [_alone(x) for x in open_rows]
                    run, open_rows = now, deque()
                while open_rows and row[1] - open_rows[0][1] > tol:
                    done.append(_alone(open_rows.popleft()))
                if open_rows and open_rows[0][2] != row[2]:
                    x, y = (row, open_rows.popleft()) if open_rows[0][2] else (open_rows.popleft(), row)
                    done.append((x[0], x[3], y[3], x[1], y[1]))
                else:
                    open_rows.append(row)
            yield _batch(done, batch.schema)
            schema = batch.schema
        if open_rows:
            yield _batch([_alone(x) for x in open_rows], schema)

    return dealt.select("run", *order).mapInArrow(pair, out)


def _alone(row: tuple) -> tuple:
    ref, amount, of_b, key = row
    return (ref, None, key, None, amount) if of_b else (ref, key, None, amount, None)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    kinds = [schema.field(c).type for c in ("ref", "id", "id", "amount", "amount")]
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["ref", "ia", "ib", "amount_a", "amount_b"])


def _with_reason(alone: DataFrame, other: DataFrame, tol: float, status: str) -> DataFrame:
    """``alone`` with status and reason, from the least and largest amounts of the other side in bins of ``tol``."""
    bin_of = F.floor(F.col("amount") / tol) if tol > 0 else F.col("amount")
    bins = other.where("ref IS NOT NULL AND amount IS NOT NULL").groupBy("ref", bin_of.alias("bin")).agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    reach: list[Column] = [bin_of + i for i in range(-2, 3)] if tol > 0 else [bin_of]
    seen = alone.select("*", F.explode(F.array(*reach)).alias("bin")).join(bins, ["ref", "bin"], "left")
    within = (F.abs(F.col("amount") - F.col("lo")) <= tol) | (F.abs(F.col("amount") - F.col("hi")) <= tol)
    seen = seen.groupBy("ref", "amount", "id").agg(F.coalesce(F.max(within), F.lit(False)).alias("used"))
    has = other.groupBy(F.col("ref").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    reason = F.when(F.col("used"), "USED").when(F.col("_n").isNotNull(), "DIFFERENCE").otherwise("NONE")
    return seen.join(has, F.col("ref") == F.col("_r"), "left").select("ref", "amount", "id", F.lit(status).alias("status"), reason.alias("reason"))
