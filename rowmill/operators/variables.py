"""References to variables in statements, replaced until none is left that can be.

A reference is the mark & with a name (and a dot, which ends the name); an assignment is a statement that a
pattern with two groups, name and value, matches.  A reference takes the last assignment of its name in
its document before the statement that refers; references in that value are taken at the same place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.operators.cut import cut

ASSIGN = r"(?i)^%let (\w+) ?= ?(.*)$"
_NAME = r"(?s)(&\w+\.?|[^&]+|&)"


def names_in(text: Column) -> Column:
    """The different names that a text refers to, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"&(\w+)"), F.lit(1)), F.lower))


def substituted(text: Column, values: Column) -> Column:
    """The text with each reference replaced by its value in the map ``values``; others stay as they are."""
    pieces = F.regexp_extract_all(text, F.lit(_NAME), F.lit(1))
    value = lambda p: F.element_at(values, F.lower(F.regexp_extract(p, r"^&(\w+)", 1)))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^&\w"), F.coalesce(value(p), p)).otherwise(p)), "")


def _as_of(asked: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """``asked`` (key, statement, name) with the value assigned last before the statement, null where none was."""
    both = asked.select(key, "statement", "name", F.lit(True).alias("asks")).unionByName(assigned.select(key, "statement", "name", F.struct("value").alias("v")), allowMissingColumns=True)
    # at one statement the question comes first: an assignment's own value refers to what was before
    w = Window.partitionBy(key, "name").orderBy("statement", F.col("asks").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("v", F.last("v", True).over(w)).where("asks").select(key, "statement", "name", F.col("v.value").alias("value"))


def references(statements: DataFrame, key: str, assign: str = ASSIGN, depth: int = 20) -> DataFrame:
    """One row for each name that a statement (key, statement, body) refers to, directly or through values:
    ``direct``, ``value`` (the assigned text), ``text`` (with all replaced) and ``status``.

    RESOLVED; UNDEFINED, where it or a name that it needs was not assigned before (such references stay in the
    text); CYCLE, where it needs itself or a name that does; TOO_DEEP, where values refer on through more than
    ``depth`` names.  text is null for the last two.  An assignment's value is a text like others: it is
    replaced where it is used, and its own references count as references of its statement."""
    hit = F.col("body").rlike(assign)
    assigned = cut(statements.where(hit).select(key, "statement", F.lower(F.regexp_extract("body", assign, 1)).alias("name"), F.regexp_extract("body", assign, 2).alias("value")))
    new = statements.select(key, "statement", F.explode(names_in(F.col("body"))).alias("name")).withColumn("direct", F.lit(True))
    known = None
    for _ in range(depth + 1):
        found = _as_of(new, assigned, key).join(new, [key, "statement", "name"])
        found = cut(found.withColumn("needs", F.coalesce(names_in(F.col("value")), F.array().cast("array<string>"))))
        known = found if known is None else cut(known.unionByName(found))
        further = found.select(key, "statement", F.explode("needs").alias("name")).distinct()
        new = cut(further.join(known, [key, "statement", "name"], "left_anti").withColumn("direct", F.lit(False)))
        if new.isEmpty():
            break
    beyond = new.withColumns({"value": F.lit(None).cast("string"), "needs": F.array().cast("array<string>"), "text": F.lit(None).cast("string"), "status": F.lit("TOO_DEEP")})

    unset, open_, text = F.col("value").isNull(), F.size("needs") > 0, F.coalesce("value", F.concat(F.lit("&"), "name"))
    done = known.where(~open_).withColumn("text", text).withColumn("status", F.when(unset, "UNDEFINED").otherwise("RESOLVED"))
    done, left = cut(done.unionByName(beyond)), cut(known.where(open_))
    while not left.isEmpty():
        facts = done.select(key, "statement", F.col("name").alias("need"), F.struct("name", "text").alias("entry"), F.col("status").alias("of"))
        asked = left.withColumn("need", F.explode("needs")).join(facts, [key, "statement", "need"])
        ready = asked.groupBy(key, "statement", "name").agg(F.map_from_entries(F.collect_list("entry")).alias("values"), F.collect_set("of").alias("all"))
        ready = left.join(ready, [key, "statement", "name"]).where(F.size("values") == F.size("needs"))
        status = F.when(F.array_contains("all", "TOO_DEEP"), "TOO_DEEP").when(F.array_contains("all", "UNDEFINED"), "UNDEFINED").otherwise("RESOLVED")
        text = F.when(status != "TOO_DEEP", substituted(F.col("value"), F.col("values")))
        ready = cut(ready.withColumn("status", status).withColumn("text", text).drop("values", "all"))
        if ready.isEmpty():
            break
        done, left = cut(done.unionByName(ready)), cut(left.join(ready, [key, "statement", "name"], "left_anti"))
    rest = left.withColumn("text", F.lit(None).cast("string")).withColumn("status", F.lit("CYCLE"))
    return done.unionByName(rest).select(key, "statement", "name", "direct", "value", "text", "status")


def expanded(statements: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Statements with ``expanded``: the body with its references replaced by ``refs``, those without a text left as they are."""
    values = refs.where("direct AND text IS NOT NULL").groupBy(key, "statement").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("_values"))
    out = statements.join(values, [key, "statement"], "left")
    return out.withColumn("expanded", F.when(F.col("_values").isNull(), F.col("body")).otherwise(substituted(F.col("body"), F.col("_values")))).drop("_values")
