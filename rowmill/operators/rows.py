"""Projection, predicates and derivations row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_step(df: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """KEEP, then DROP (absent columns are ignored), then RENAME."""
    df = df.select(*keep) if keep else df
    return df.drop(*(drop or [])).withColumnsRenamed(rename or {})


def sas_cmp(col: Column, op: str, value) -> Column:
    """Comparison in which a missing number is below every number and equal to itself."""
    v = F.lit(value)
    if value is None:
        return {"=": col.isNull(), "<>": col.isNotNull(), "<": F.lit(False), "<=": col.isNull(), ">": col.isNotNull(), ">=": F.lit(True)}[op]
    low = {"<": col < v, "<=": col <= v, "<>": col != v}
    return col.isNull() | low[op] if op in low else F.coalesce({"=": col == v, ">": col > v, ">=": col >= v}[op], F.lit(False))


def case_chain(cases: list[tuple[Column, object]], default=None) -> Column:
    """The value of the first case that holds."""
    out = F.lit(default) if not isinstance(default, Column) else default
    for cond, value in reversed(cases):
        out = F.when(cond, value).otherwise(out)
    return out


def band(col: Column, edges: list[float], labels: list[str]) -> Column:
    """labels[i] for edges[i-1] <= value < edges[i], open at both ends; null stays null."""
    out = F.lit(labels[-1])
    for e, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(col < e, label).otherwise(out)
    return F.when(col.isNotNull(), out)


def apply_format(df: DataFrame, col: str, mapping: dict, other: str | None = None, out: str | None = None) -> DataFrame:
    """Value labels in a new column; the source stays as it is."""
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return df.withColumn(out or f"{col}_fmt", F.coalesce(pairs[F.col(col)], F.lit(other) if other is not None else F.col(col).cast("string")))


def route(df: DataFrame, routes: list[tuple[str, Column]], default: str, out: str = "route") -> DataFrame:
    """The first route whose condition holds."""
    return df.withColumn(out, case_chain([(c, F.lit(n)) for n, c in routes], default))


def emit_per_rule(df: DataFrame, rules: list[tuple[str, Column]], clean: str = "CLEAN", out: str = "rule") -> DataFrame:
    """A row for each rule a row meets, one ``clean`` row if it meets none."""
    hits = F.filter(F.array(*(F.when(c, n) for n, c in rules)), lambda x: x.isNotNull())
    return df.withColumn(out, F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(clean)))))


def validate_rows(df: DataFrame, rules: list[tuple[str, Column]], sep: str = ";") -> DataFrame:
    """Messages of all failed rules, joined, and the status."""
    df = df.withColumn("error_fields", F.concat_ws(sep, *(F.when(c, n) for n, c in rules)))
    return df.withColumn("status", F.when(F.col("error_fields") == "", "VALID").otherwise("INVALID"))


def case_struct(df: DataFrame, branches: list[tuple[Column, dict]], default: dict) -> DataFrame:
    """Several columns at once from the first branch that holds."""
    made = lambda values: F.struct(*(F.lit(values.get(k)).alias(k) for k in default))
    picked = df.withColumn("_case", case_chain([(c, made(v)) for c, v in branches], made(default)))
    return picked.withColumns({k: F.col(f"_case.{k}") for k in default}).drop("_case")


def format_from_table(df: DataFrame, col: str, labels: DataFrame, start: str, label: str, other: str | None, out: str) -> DataFrame:
    """Labels from a table of (start, label), one a value; Spark broadcasts it where its size allows."""
    one = labels.groupBy(F.col(start).alias(col)).agg(F.min(label).alias("_l"))
    return df.join(one, col, "left").withColumn(out, F.coalesce("_l", F.lit(other))).drop("_l")


def map_columns(df: DataFrame, cols: list[str], fn) -> DataFrame:
    """The same expression over several columns."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})
