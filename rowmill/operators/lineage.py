"""Lineage of a corpus of programs: what each statement reads, writes, defines and calls, and which earlier statement made it.

Statements come from ``corpus.statements`` (key, statement, line_end, body) over text that
``blank_comments`` has cleaned, so that neither a comment nor a quoted string
gives names or ends a statement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.operators.cut import cut
from rowmill.operators.ordered import bucketed, win


@dataclass(frozen=True)
class Rule:
    """``pattern`` has the name, or with ``many`` a list of names, as its first group.  It is
    looked for in lower-cased statements with single blanks.  role: READ, WRITE, DEFINE or CALL."""

    role: str
    pattern: str
    many: bool = False


# The statement forms that read and write tables, and those that define and call macros.
PROGRAM_RULES = [
    Rule("READ", r"^(?:set|merge) (.+)$", many=True),
    Rule("READ", r"\b(?:from|join) ([\w.]+)"),
    Rule("READ", r"^proc \w+\b.*?\bdata ?= ?([\w.]+)"),
    Rule("WRITE", r"^data (.+)$", many=True),
    Rule("WRITE", r"\bcreate table ([\w.]+)"),
    Rule("WRITE", r"\binsert into ([\w.]+)"),
    Rule("WRITE", r"\boutput out ?= ?([\w.]+)"),
    Rule("DEFINE", r"^%macro (\w+)"),
    Rule("CALL", r"%(\w+)"),
]
# Words after % that are part of the language and call nothing.
NOT_CALLED = ["macro", "mend", "let", "if", "then", "else", "do", "end", "to", "while", "until", "put", "global", "local", "include", "eval", "sysevalf", "sysfunc", "str", "nrstr", "quote", "upcase", "lowcase", "scan", "substr", "length", "index", "goto", "return", "abort"]


def blank_comments(text: Column) -> Column:
    """The text with comments blanked out and quoted strings emptied; line breaks stay where they are."""
    piece = r"(?s)(/\*.*?\*/|'[^']*'|\"[^\"]*\"|[^/'\"]+|.)"
    keep_lines = lambda p: F.regexp_replace(p, r"[^\n]", " ")
    quoted = lambda p: F.concat(F.substring(p, 1, 1), keep_lines(F.substring(p, F.lit(2), F.length(p) - 2)), F.substring(p, 1, 1))
    is_quoted = lambda p: (F.length(p) > 1) & (p.startswith("'") | p.startswith('"'))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(piece), F.lit(1)), lambda x: F.when(x.startswith("/*") & (F.length(x) > 3), keep_lines(x)).when(is_quoted(x), quoted(x)).otherwise(x)), "")


def _use(role: str):
    return lambda name: F.struct(F.lit(role).alias("role"), name.alias("name"))


def symbol_uses(statements: DataFrame, key: str, rules: list[Rule] | None = None, not_called: list[str] | None = None) -> DataFrame:
    """key, statement, line_end, role and name (lower case), one row for each different use in a statement.

    Names that begin with an underscore are automatic and left out, as are options in parentheses after listed names."""
    rules, not_called = PROGRAM_RULES if rules is None else rules, NOT_CALLED if not_called is None else not_called
    body = F.lower("body")
    listed = lambda c: F.regexp_extract_all(F.regexp_replace(c, r"\([^()]*(?:\([^()]*\)[^()]*)*\)", " "), F.lit(r"([\w.]+)"), F.lit(1))
    found = []
    for r in rules:
        names = F.regexp_extract_all(body, F.lit(r.pattern), F.lit(1))
        names = F.flatten(F.transform(names, listed)) if r.many else names
        found.append(F.transform(names, _use(r.role)))
    uses = statements.select(key, "statement", "line_end", F.explode(F.array_distinct(F.flatten(F.array(*found)))).alias("u")).select(key, "statement", "line_end", "u.*")
    return uses.where(~F.col("name").startswith("_") & (F.col("name") != "") & ((F.col("role") != "CALL") | ~F.col("name").isin(not_called)))


def producer_edges(uses: DataFrame, key: str) -> DataFrame:
    """(key, statement) uses ``name`` that (made_key, made_statement) made, and the kind of the edge: dataset (a read of a
    table that the same document wrote last before it), cross_file (that an earlier document wrote last) or macro_call
    (a call of the last definition before it).  A use of a name that nothing made before it has no edge.

    All uses are put in one order, by name and place, in stored range buckets; each looks at the last maker before it in
    its bucket or, through one row a bucket, in those before, so a name of any frequency is dealt."""
    made = F.col("role").isin("WRITE", "DEFINE")
    rows = uses.select(F.col(key).alias("k"), "statement", "name", F.col("role").isin("DEFINE", "CALL").alias("macro"), made.alias("makes"))
    rows = rows.withColumn("at", F.when(F.col("makes"), F.struct("macro", "name", "k", "statement")))
    order = ["macro", "name", "k", "statement", "makes"]  # a statement reads before it writes
    rows = bucketed(cut(rows), order)  # stored first: the bounds of the buckets are sampled by reading the rows once more
    last = F.last("at", True).over(win(["_b"], order).rowsBetween(Window.unboundedPreceding, -1))
    tails = rows.groupBy("_b").agg(F.max("at").alias("tail"))
    tails = tails.select("_b", F.last("tail", True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    found = rows.withColumn("last", last).join(tails, "_b").withColumn("m", F.coalesce("last", "earlier")).where("NOT makes AND m.macro = macro AND m.name = name")
    kind = F.when(F.col("macro"), "macro_call").when(F.col("m.k") == F.col("k"), "dataset").otherwise("cross_file")
    return found.select(F.col("k").alias(key), "statement", "name", F.col("m.k").alias(f"made_{key}"), F.col("m.statement").alias("made_statement"), kind.alias("kind"))


def include_edges(includes: DataFrame, key: str) -> DataFrame:
    """Edges of resolved includes (key, statement, name, target): to the first statement of the file that is included."""
    return includes.where(F.col("target").isNotNull()).select(key, "statement", "name", F.col("target").alias(f"made_{key}"), F.lit(1).alias("made_statement"), F.lit("cross_file").alias("kind"))
