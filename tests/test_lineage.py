"""Lineage from program text: roles by keyword, comments and quoted names, producers by the last write before."""

import random

from pyspark.sql import functions as F

from rowmill.operators import corpus, lineage

ONE = """/* from hidden; set also_hidden; */
data work.out (keep=a b) other; set lib.in1(where=(x > 1)) in2;
title 'data from nowhere; set x'; run;
%macro load(p);
  proc sort data=other out=sorted; by a; run;
%mend;
proc sql; create table joined as select * from work.out a left join other b on a.x = b.x;
insert into joined select * from "quoted";
data _null_; set joined;
proc means data = joined; output out=stats;
%load(1); %put done; %upcase(x);"""
TWO = "data final; set stats missing work.out;\n%load(2); data stats; set stats;"


def uses(spark, texts, rules=None):
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc int, text string")
    s = corpus.statements(docs.withColumn("text", lineage.blank_comments(F.col("text"))), "doc", "text")
    return lineage.symbol_uses(s, "doc", rules)


def test_roles_lines_and_names(spark):
    got = {(r.role, r.name, r.line_end) for r in uses(spark, [ONE]).collect()}
    assert got == {
        ("WRITE", "work.out", 2), ("WRITE", "other", 2), ("READ", "lib.in1", 2), ("READ", "in2", 2),
        ("DEFINE", "load", 4), ("READ", "other", 5), ("WRITE", "joined", 7), ("READ", "work.out", 7), ("READ", "other", 7),
        ("WRITE", "joined", 8), ("READ", "joined", 9), ("READ", "joined", 10), ("WRITE", "stats", 10), ("CALL", "load", 11),
    }


def test_typed_edges(spark):
    u = uses(spark, [ONE, TWO])
    at = {(r.doc, r.statement): r.line_end for r in u.collect()}
    e = {(r.doc, r.name, r.made_doc, at[r.made_doc, r.made_statement], r.kind) for r in lineage.producer_edges(u, "doc").collect()}
    assert e == {
        (1, "other", 1, 2, "dataset"), (1, "work.out", 1, 2, "dataset"), (1, "joined", 1, 8, "dataset"), (1, "load", 1, 4, "macro_call"),
        (2, "stats", 1, 10, "cross_file"), (2, "work.out", 1, 2, "cross_file"), (2, "load", 1, 4, "macro_call"), (2, "stats", 2, 2, "dataset"),
    }
    files = spark.createDataFrame([(1, 3, "b.sas", 2), (1, 4, "none.sas", None)], "doc int, statement int, name string, target int")
    assert [tuple(r) for r in lineage.include_edges(files, "doc").collect()] == [(1, 3, "b.sas", 2, 1, "cross_file")]


def test_edges_equal_a_plain_search(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(30), rng.randrange(1, 40), 1, rng.choice(["READ", "WRITE", "DEFINE", "CALL"]), rng.choice(["hot", "hot", "a", "b", "c"])) for _ in range(900)]
    rows = sorted(set(rows))
    want = set()
    for d, s, _, role, name in rows:
        maker = {"READ": "WRITE", "CALL": "DEFINE"}.get(role)
        before = max(((e, t) for e, t, _, r, n in rows if r == maker and n == name and (e, t) < (d, s)), default=None)
        if maker and before:
            want.add((d, s, name, *before, "macro_call" if role == "CALL" else "dataset" if before[0] == d else "cross_file"))
    got = lineage.producer_edges(spark.createDataFrame(rows, "doc long, statement long, line_end long, role string, name string"), "doc")
    assert {tuple(r) for r in got.collect()} == want


def test_odd_texts(spark):
    assert uses(spark, [None, "", "'open quote ; set a", "/* open ; set b;", "a / b; set c;"]).select("name").distinct().count() == 3
