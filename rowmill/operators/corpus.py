"""Registry, lineage, graph and feature operators over a table of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.operators.cut import cut
from rowmill.operators.matching import jaccard
from rowmill.operators.rows import case_chain


def statements(docs: DataFrame, key: str, text: str, end: str = ";") -> DataFrame:
    """One row a statement: number, line of its last character, its text, and whether its end is missing.

    A statement runs up to the next ``end`` mark; blank ones at the end are dropped."""
    lines = lambda x: (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))).cast("bigint")
    cut_up = docs.select(key, F.split(text, f"[{end}]").alias("_parts")).where(F.col("_parts").isNotNull())
    # running counts of line breaks, array by array: the texts themselves are never shuffled
    cut_up = cut_up.select(key, F.size("_parts").alias("_n"), "_parts", running_sums()(F.transform("_parts", lines)).alias("_ends"))
    each = cut_up.select(key, "_n", F.posexplode(F.arrays_zip("_parts", "_ends")).alias("_i", "_p"))
    last = F.col("_i") == F.col("_n") - 1
    each = each.where(~last | F.col("_p._parts").rlike(r"[^\s]"))
    body = F.trim(F.regexp_replace("_p._parts", r"\s+", " "))
    return each.select(key, (F.col("_i") + 1).alias("statement"), (F.col("_p._ends") + 1).alias("line_end"), body.alias("body"), last.alias("incomplete"))


def running_sums():
    """An Arrow UDF array<bigint> -> the running sums of each array."""

    @F.arrow_udf("array<bigint>")
    def sums(col: pa.Array) -> pa.Array:
        offsets = col.offsets.to_numpy()
        total = np.concatenate(([0], np.cumsum(np.asarray(col.flatten(), np.int64))))
        offsets = offsets - offsets[0]
        within = total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(within))

    return sums


def block_spans(rows: DataFrame, by: list[str], order: list, opens: Column, closes: Column, line: Column) -> DataFrame:
    """Blocks of rows: one begins at each opener, and ends at its closer or, unclosed, before the next opener.
    Rows outside of blocks are left out."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    block = rows.withColumn("_o", opens.cast("int")).withColumn("_c", closes.cast("int")).withColumn("block", F.sum("_o").over(w))
    inner = Window.partitionBy(*by, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = block.withColumn("_done", F.coalesce(F.max("_c").over(inner), F.lit(0))).where("block > 0 and _done = 0")
    return inside.groupBy(*by, "block").agg(F.min(line).alias("line_start"), F.max(line).alias("line_end"), F.count(F.lit(1)).alias("n_rows"), (F.max("_c") == 1).alias("closed"))


def register(files: DataFrame, registry: DataFrame, key: str, text: str) -> DataFrame:
    """``registry`` (key, content_hash) with the files whose content it does not hold; of equal
    contents the smallest key is taken."""
    fresh = files.groupBy(F.sha2(text, 256).alias("content_hash")).agg(F.min(key).alias(key))
    return registry.unionByName(fresh.join(registry, "content_hash", "left_anti").select(*registry.columns))


def resolve_refs(refs: DataFrame, files: DataFrame, folder: str, ref: str, path: str) -> DataFrame:
    """Each reference with the file that it names: relative to its own folder first, then to the root."""
    f = files.select(F.col(path).alias("_p")).distinct()
    near, far = f.withColumnRenamed("_p", "_near"), f.withColumnRenamed("_p", "_far")
    out = refs.join(near, F.concat(folder, F.lit("/"), ref) == F.col("_near"), "left").join(far, F.col(ref) == F.col("_far"), "left")
    return out.withColumn("target", F.coalesce("_near", "_far")).withColumn("resolved", F.col("target").isNotNull()).drop("_near", "_far")


def dependency_edges(writes: DataFrame, reads: DataFrame, name: str, key: str) -> DataFrame:
    """(src, dst): src writes what dst reads; both sides hold one row for each key and name."""
    return writes.select(F.col(key).alias("src"), name).distinct().join(reads.select(F.col(key).alias("dst"), name).distinct(), name).where("src <> dst").select("src", "dst").distinct()


def condense(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """Edges between strongly connected components."""
    side = lambda c: scc.select(F.col("node").alias(c), F.col("scc").alias(f"_{c}"))
    return edges.join(side("src"), "src").join(side("dst"), "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()


def hop_cap(edges: DataFrame, cap: int = 10) -> int:
    """The longest path of an acyclic graph, ``cap`` at most: rounds in which any node is still reached."""
    level = cut(edges.select(F.col("src").alias("node")).distinct())
    for i in range(cap):
        level = cut(level.join(edges.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node")).distinct())
        if level.isEmpty():
            return i
    return cap


def members(scc: DataFrame, of: int) -> DataFrame:
    """The nodes of a component."""
    return scc.where(F.col("scc") == of).select("node")


def component_sizes(scc: DataFrame) -> DataFrame:
    """scc with its number of nodes and its smallest one, of the components of several nodes."""
    return scc.groupBy("scc").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("node").alias("first")).where("n_nodes > 1")


def graph_counts(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("src").alias("n")).unionByName(edges.select(F.col("dst").alias("n"))).distinct()
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(F.broadcast(edges.distinct().agg(F.count(F.lit(1)).alias("n_edges"))))


def block_features(docs: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """Length in lines, words, mean word length, deepest nesting of parentheses, share of digits,
    and the count of each pattern."""
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    marks = F.regexp_extract_all(text, F.lit(r"([()])"), F.lit(1))
    step = lambda acc, m: F.struct((acc["now"] + F.when(m == "(", 1).otherwise(-1)).alias("now"), F.greatest(acc["top"], acc["now"] + F.when(m == "(", 1).otherwise(-1)).alias("top"))
    depth = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda acc: acc["top"])
    words, size = n(r"\S+"), F.length(text)
    base = {"n_lines": n("\n") + 1, "n_words": words, "mean_word": F.coalesce(F.try_divide(n(r"\S"), words), F.lit(0.0)), "nesting": depth.cast("long"), "digit_share": F.coalesce(F.try_divide(n("[0-9]"), size), F.lit(0.0))}
    return docs.select(key, *(e.alias(k) for k, e in base.items()), *(n(p).alias(f"n_{k}") for k, p in patterns.items()))


def nesting(text: Column, opens: str, closes: str) -> Column:
    """The deepest nesting over a text's lines: a line's openers count before its closers, and depth stays at 0 or above."""
    n = lambda line, p: F.regexp_count(line, F.lit(p))

    def step(acc: Column, line: Column) -> Column:
        now = acc["now"] + n(line, opens)
        return F.struct(F.greatest(now - n(line, closes), F.lit(0)).alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.aggregate(F.split(text, "\n"), F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda acc: acc["top"])


# Scales and caps of a block's features, and the patterns of program text that they look for.
LINES, NESTING, NAMES = 200, 5, 5
PROGRAM_NESTING = (r"(?i)\b(?:DO\b|%DO\b|SELECT\b|IF\b.*\bTHEN\s+DO\b)", r"(?i)\bEND\b\s*;")
PROGRAM_REFS = r"(?i)\b(?:DATA|SET|MERGE|FROM|INTO|UPDATE)\s+(\w+(?:\.\w+)?)"
PROGRAM_NO_REFS = ["_null_", "work", "_last_", "_data_"]
PROGRAM_BRANCH = r"(?i)\bIF\b.*\bTHEN\b"
PROGRAM_FLAGS = {
    "call_execute": r"(?i)\bCALL\s+EXECUTE\b",
    "retain_first_last": r"(?i)\bRETAIN\b|\b(?:FIRST|LAST)\.\w+",
    "merge_hash": r"(?i)\bMERGE\b\s+\w+|\bDECLARE\s+HASH\b|\b_new_\s*=\s*hash\b|\.define(?:key|data|done)\b",
    "sql_subquery": r"(?i)\(\s*SELECT\b",
    "array_loop": r"(?i)\bARRAY\s+\w+|%DO\b|\bDO\s+\w+\s*=",
    "call_symput": r"(?i)\bCALL\s+SYMPUTX?\b",
    "complex_proc": r"(?i)\bPROC\s+(?:TRANSPOSE|REPORT)\b",
}


def program_vector(docs: DataFrame, key: str, text: str, kind: Column, ambiguous: Column, kind_weights: dict[str, float]) -> DataFrame:
    """``block_vector`` with the patterns of program text: 14 features."""
    return block_vector(docs, key, text, kind, ambiguous, PROGRAM_NESTING, PROGRAM_REFS, PROGRAM_BRANCH, PROGRAM_FLAGS, kind_weights, no_refs=PROGRAM_NO_REFS)


def block_vector(docs: DataFrame, key: str, text: str, kind: Column, ambiguous: Column, marks: tuple[str, str], refs: str, branch: str, flags: dict[str, str], kind_weights: dict[str, float], macro: str = "%", macro_cap: float = 1.5, no_refs: list[str] | None = None) -> DataFrame:
    """The feature vector of a block: lines / 200, deepest nesting / 5, macro marks a line (``macro_cap`` at
    most), the weight of its kind (1 if unlisted), whether it is ambiguous, different names it refers to / 5
    (1.5 at most), branches a line (1 at most), and a 0/1 flag for each pattern.  Null texts have null features."""
    lines = F.size(F.split(F.col(text), "\n"))
    n = lambda p: F.regexp_count(text, F.lit(p))
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(refs), F.lit(1)), F.lower))
    names = F.size(F.filter(found, lambda x: ~x.isin(no_refs)) if no_refs else found)
    weight = case_chain([(kind == k, w) for k, w in kind_weights.items()], 1.0)
    made = {
        "line_count_norm": lines / LINES,
        "nesting_norm": nesting(F.col(text), *marks) / NESTING,
        "macro_pct": F.least(n(macro) / lines, F.lit(macro_cap)),
        "type_weight": weight.cast("double"),
        "is_ambiguous": F.coalesce(ambiguous, F.lit(False)).cast("double"),
        "dataset_count_norm": F.least(names / NAMES, F.lit(1.5)),
        "conditional_density": F.least(n(branch) / lines, F.lit(1.0)),
        **{f"has_{k}": F.col(text).rlike(p).cast("double") for k, p in flags.items()},
    }
    return docs.select(key, *((c if k in ("type_weight", "is_ambiguous") else F.when(F.col(text).isNotNull(), c)).alias(k) for k, c in made.items()))


def risk_rules(features: DataFrame, rules: list[tuple[Column, str, float]], default: tuple[str, float]) -> DataFrame:
    """Risk tier and confidence of the first trigger that holds."""
    made = lambda tier, conf: F.struct(F.lit(tier).alias("risk"), F.lit(conf).alias("confidence"))
    out = features.withColumn("_r", case_chain([(c, made(t, p)) for c, t, p in rules], made(*default)))
    return out.withColumn("risk", F.col("_r.risk")).withColumn("confidence", F.col("_r.confidence")).drop("_r")


def strategy(risk: Column, kind: Column, simple: list[str]) -> Column:
    """How to treat a block of this risk and kind."""
    return case_chain([(risk == "HIGH", "MANUAL_REVIEW"), (kind.isin(*simple) & (risk == "LOW"), "RULES"), (risk == "LOW", "DIRECT")], "ASSISTED")


def function_usage(docs: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """(name, documents, uses) of each word of ``names``, whole words without regard to case."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"\b({'|'.join(names)})\b"), F.lit(1))
    each = docs.select(key, F.explode(found).alias("name")).groupBy("name", key).agg(F.count(F.lit(1)).alias("_c"))
    return each.groupBy("name").agg(F.count(F.lit(1)).alias("documents"), F.sum("_c").alias("uses"))


def op_set(text: Column, rules: dict[str, str]) -> Column:
    """The names of all patterns that the text has."""
    return F.filter(F.array(*(F.when(text.rlike(p), n) for n, p in rules.items())), lambda x: x.isNotNull())


def op_similarity(a: Column, b: Column, bonus: Column) -> Column:
    """Set similarity of two operation sets, 0.05 more where ``bonus`` holds, 1 at most; empty sets are alike."""
    return F.least(F.lit(1.0), F.coalesce(jaccard(a, b), F.lit(1.0)) + F.when(bonus, 0.05).otherwise(0.0))


def infer_types(df: DataFrame, cols: list[str]) -> DataFrame:
    """The narrowest of long, double, date and string that every value of a text column fits; blanks fit all."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    fits = lambda c, t: F.coalesce(F.min((filled(c).isNull() | filled(c).try_cast(t).isNotNull()).cast("int")), F.lit(1))
    row = df.agg(*(F.struct(*(fits(c, t).alias(t) for t in ("bigint", "double", "date")), F.count(filled(c)).alias("n")).alias(f"_{i}") for i, c in enumerate(cols)))

    def kind(i: int) -> Column:
        f = F.col(f"_{i}")
        return F.when(f["n"] == 0, "string").when(f["bigint"] == 1, "long").when(f["double"] == 1, "double").when(f["date"] == 1, "date").otherwise("string")

    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), kind(i).alias("inferred"), F.col(f"_{i}.n").alias("n_filled")) for i, c in enumerate(cols)))).alias("p")).select("p.*")


def reload_violations(reads: DataFrame, writes: DataFrame, by: list[str], name: str, at: str) -> DataFrame:
    """Reads of a name that was written earlier in the same document."""
    first = writes.groupBy(*by, name).agg(F.min(at).alias("written_at"))
    return reads.join(first, [*by, name]).where(F.col(at) > F.col("written_at"))
