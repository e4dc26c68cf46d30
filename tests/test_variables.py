"""Variable references: chains, cycles, undefined names, and the last assignment before the use."""

from rowmill.operators import corpus, variables

TEXT = """%let a = 1; %let b = &a.0; %let c = x &b y; use &c; %let a = 2; use &C and &a;
%let p = &q; %let q = &p; use &p; use &nothing; %let r = &nothing + &a; use &r & co;
%let self = &self 1; use &self"""


def resolved(spark, text, **kw):
    s = corpus.statements(spark.createDataFrame([(1, text)], "doc int, text string"), "doc", "text")
    refs = variables.references(s, "doc", **kw)
    got = {(r.statement, r.name): (r.text, r.status) for r in refs.where("direct").collect()}
    return got, {r.statement: r.expanded for r in variables.expanded(s, refs, "doc").collect()}


def test_chain_cycle_undefined(spark):
    got, out = resolved(spark, TEXT)
    assert got[4, "c"] == ("x 10 y", "RESOLVED")
    assert got[6, "c"] == ("x 20 y", "RESOLVED")  # values are replaced where they are used
    assert got[9, "p"] == (None, "CYCLE")
    assert got[10, "nothing"] == ("&nothing", "UNDEFINED")
    assert got[12, "r"] == ("&nothing + 2", "UNDEFINED")
    assert got[13, "self"] == ("&self", "UNDEFINED")  # nothing was assigned before its own assignment
    assert got[14, "self"] == (None, "CYCLE")
    assert (out[4], out[6], out[9], out[12]) == ("use x 10 y", "use x 20 y and 2", "use &p", "use &nothing + 2 & co")


def test_depth_is_bounded_and_reported(spark):
    chain = "%let v0 = end; " + "; ".join(f"%let v{i} = &v{i - 1}" for i in range(1, 9)) + "; use &v8"
    assert resolved(spark, chain)[0][10, "v8"] == ("end", "RESOLVED")
    assert resolved(spark, chain, depth=3)[0][10, "v8"] == (None, "TOO_DEEP")


def test_nothing_to_resolve(spark):
    assert resolved(spark, "a; b & c") == ({}, {1: "a", 2: "b & c"})
    assert resolved(spark, "") == ({}, {})


def test_prose_of_other_letters_and_line_marks_as_in_sql(spark, tmp_path):
    """SQL's word edges and lines are those of ASCII: é ends no word there, and only \\n ends a line."""
    import duckdb

    from rowmill import catalog

    rows = [(1, "éthe cat sat. In cat the dog ran. See the cat. ßthe dog, 9the dog, _the dog, ªthe dog"), (2, "In dog one\u0085two. the dog"), (3, "The the the cat."), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["variable_references"]).fetchall()
    cols = [c[0] for c in con.description]
    got = catalog.queries()["variable_references"](spark, str(tmp_path)).select(*cols).collect()
    assert len(want) > 6
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
