"""Span evaluation against all pairs."""

import random

from rowmill.operators import spans

S = "file string, kind string, start long, end long, {} long"


def plain(pred, gold, tol):
    out, wrong = {}, {}
    for f, k, s, e, i in gold:
        hit = [p for p in pred if p[0] == f and p[1] == k and abs(p[2] - s) <= tol and abs(p[3] - e) <= tol]
        out[i] = min((p[4] for p in hit), default=None)
        near = min((p for p in pred if p[0] == f), key=lambda p: (abs(p[2] - s), p[4]), default=None)
        if not hit and near:
            wrong[near[1], k] = wrong.get((near[1], k), 0) + 1
    return out, wrong


def test_spans_equal_all_pairs(spark):
    rng = random.Random(1)
    make = lambda n, files, far: [(rng.choice(files), rng.choice("xyz"), s := rng.randrange(far), s + rng.randrange(5), i) for i in range(n)]
    gold = make(300, "abc", 5000) + [("d", "x", 7, 7, 1000 + i) for i in range(50)] + [("e", "x", 1, 2, 2000)]
    pred = make(500, "ab", 5000) + [("d", "y", 7, 9, 3000 + i) for i in range(60)] + [("d", "x", 7 + i, 8, 4000 + i) for i in range(3)] + [("z", "x", 1, 1, 5000)]
    p, g = spark.createDataFrame(pred, S.format("pid")), spark.createDataFrame(gold, S.format("gid"))
    m = spans.match_spans(p, g, 2)
    want, wrong = plain(pred, gold, 2)
    assert {r.gid: r.pid for r in m.collect()} == want
    assert {(r.taken_for, r.kind): r.missed for r in spans.span_confusion(m).collect()} == wrong
    files = spans.span_files(p, m)
    assert {r.file: (r.detected, r.gold, r.correct) for r in files.collect()}["d"] == (63, 50, 50)
    row = spans.span_summary(files).head()
    assert (row.total, row.correct) == (len(gold), sum(v is not None for v in want.values()))
    none = spark.createDataFrame([], S.format("gid"))
    assert spans.match_spans(p, none, 2).count() == 0
    assert spans.span_summary(spans.span_files(p, spans.match_spans(p, none, 2))).head().accuracy == 0
