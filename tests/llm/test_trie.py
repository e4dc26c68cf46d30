"""The conversation trie against a plain one, with long, copied, empty and absent conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

from rowmill.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, conv long, part int, n string"


def plain(rows):
    """What the contract says, in one process."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        if c is not None:
            own[c].append((turn is not None, turn or 0, sha, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    new = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = own.get(c - c % 5, [])[:h] + mine[h:]
    nodes = defaultdict(set)
    for c, t in new.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].add(c)
    kids = defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    out = []
    for k, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(new[c]) == len(k))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, 1, "x") for r in rows], SCHEMA)


def check(spark, rows):
    got = trie.rebuilt_trie(frame(spark, rows).repartition(3))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_trie_of_many_shapes(spark):
    rng = random.Random(4)
    say = ["hello", "hé", "", None, "a longer text", "x" * 5000]
    rows = [(c, t, "user" if t % 2 else "assistant", rng.choice(say[: 1 + c % 6])) for c in range(0, 260, 1 + rng.randrange(1)) if c % 7 for t in range(rng.randrange(1, 14))]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(300) for t in range(6)]  # copies of one conversation
    rows += [(2000 + c, t, "user", "same 0" if t == 0 else f"{c} {t}") for c in range(150) for t in range(1 + c % 10)]
    rows += [(-7, None, None, None), (-7, 3, "user", "b"), (-7, 3, "user", "a"), (None, 1, "user", "lost"), (10**15, 0, "r", "t"), (10**15 + 1, 0, "r", "t"), (31, 5, "user", "again"), (31, 5, "user", "again")]
    check(spark, rows)


def test_one_conversation_longer_than_segments(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 8)
    rows = [(1, t, "user", f"t{t % 3}") for t in range(300)]
    rows += [(0, t, "user", f"t{t % 3}") for t in range(150)] + [(4, t, "user", f"t{t % 3}") for t in range(301)]
    rows += [(c, t, "a", f"{t}") for c in range(10, 40) for t in range(c % 6 + 1)]
    check(spark, rows)


def test_empty_and_turnless(spark):
    assert trie.rebuilt_trie(frame(spark, [])).count() == 0
    check(spark, [(4, 0, "user", "alone"), (3, 0, "user", "alone"), (9, 1, None, None)])
