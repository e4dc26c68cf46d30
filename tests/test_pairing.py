"""One-to-one matching against a plain greedy merge."""

import random

import pytest

from rowmill.operators.pairing import match_one_to_one

A, B = "ref long, ia long, amount double", "ref long, ib long, amount double"


def plain(a, b, tol):
    out = []
    refs = {r[0] for r in a} | {r[0] for r in b}
    for ref in refs:
        la, lb = (sorted((r[2], r[1]) for r in rows if r[0] == ref and ref is not None and r[2] is not None) for rows in (a, b))
        has_a, has_b = [x for x, _ in la], [x for x, _ in lb]
        for x in sorted(set(has_a) & set(has_b)):
            ea, eb = ([p for p in side if p[0] == x] for side in (la, lb))
            for p, q in zip(ea, eb, strict=False):
                out.append((ref, p[1], q[1], x, x, "EXACT", None))
                la.remove(p)
                lb.remove(q)
        while la or lb:
            if la and lb and abs(la[0][0] - lb[0][0]) <= tol:
                p, q = la.pop(0), lb.pop(0)
                out.append((ref, p[1], q[1], p[0], q[0], "TOLERANCE", None))
                continue
            take_a = not lb or (la and la[0][0] < lb[0][0])
            p, other = (la.pop(0), has_b) if take_a else (lb.pop(0), has_a)
            why = "USED" if any(abs(p[0] - y) <= tol for y in other) else "DIFFERENCE" if other else "NONE"
            out.append((ref, p[1], None, p[0], None, "ONLY_A", why) if take_a else (ref, None, p[1], None, p[0], "ONLY_B", why))
    for rows, status in ((a, "ONLY_A"), (b, "ONLY_B")):
        for ref, i, x in rows:
            if ref is None or x is None:
                out.append((ref, i, None, x, None, status, "NONE") if status == "ONLY_A" else (ref, None, i, None, x, status, "NONE"))
    return sorted(out, key=str)


def run(spark, a, b, tol):
    got = match_one_to_one(spark.createDataFrame(a, A), spark.createDataFrame(b, B), "ref", "amount", "ia", "ib", tol)
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_an_exact_partner_is_found_on_uneven_lists(spark):
    got = run(spark, [(1, 1, 10.0), (1, 2, 20.0)], [(1, 7, 20.0)], 0.5)
    assert got == sorted([(1, 2, 7, 20.0, 20.0, "EXACT", None), (1, 1, None, 10.0, None, "ONLY_A", "DIFFERENCE")], key=str)


@pytest.mark.parametrize("tol", [0.0, 0.25, 2.0])
def test_equals_a_greedy_merge(spark, tol):
    """Among others a reference with a third of all rows and dense amounts, nulls, and copies of one amount."""
    rng = random.Random(7)
    make = lambda n: [(rng.choice([1, 1, 2, 3, 4, None]), i, rng.choice([None, *[rng.randrange(400) / 8 for _ in range(30)]])) for i in range(n)]
    a, b = make(400), [(r[0] if r[0] != 4 else 5, *r[1:]) for r in make(300)]
    a += [(9, 1000 + i, 5.0) for i in range(20)]
    b += [(9, 2000 + i, 5.0 + i % 3 / 8) for i in range(25)]
    assert run(spark, a, b, tol) == plain(a, b, tol)


def test_empty_sides(spark):
    assert run(spark, [], [], 1.0) == []
    assert run(spark, [(1, 1, 2.0)], [], 1.0) == [(1, 1, None, 2.0, None, "ONLY_A", "NONE")]
