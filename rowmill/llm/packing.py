"""Packing token sequences: hierarchical, multi-length.

A document (its ids and a closing mark) is routed to the tier of the smallest
context size that holds it: 1/8, 1/4, 1/2 or all of a window.  Documents longer
than a window belong to the last tier; they are cut at full windows, which are
sequences of their own, and leave a remainder.

Each tier is packed into sequences of its own context size, from the longest
tier down: the longest remainder opens a sequence, and what fits best of the same
tier goes on.  A gap that nothing of the tier fits is filled from shorter tiers,
best fit first, and at last by the head of a shorter document, whose rest stays
in its tier.  Only the last sequence of a tier can be short: it is cut at powers of
two, which need no padding, so padding does not occur at all.

Packing happens in the task that reads the texts, over groups of ``GROUP``
remainders, so nothing is shuffled and memory is bounded; the order is that of
the rows read, so a task that runs again makes the same sequences.  Sequence
numbers are partition * 2**36 + a count from 0.  The sequences of a tier are dealt
to step groups of equal tokens so that every group of the tier gets a like share
of attention cost (the sum of squared piece lengths).

Null and empty texts are the closing mark alone; long texts give many windows;
repeated rows and null keys are packed each for themselves; equal lengths go by
arrival; an empty table gives an empty result.  Only key and text are read, so
extra columns of any name are no matter; the results' names are fixed.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm import text as T

WINDOW, END, GROUP, STEP = 1024, 0, 16_384, 64
#: Fixed value: the split pattern that a ByteLevel pre-tokenizer with use_regex stands for.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict = {}


def encoder(path: str):
    """A function text -> uint32 ids of the tokenizer in a tokenizers JSON file.

    A byte-level BPE file is read into tiktoken, whose ids are the same and which is
    four times as fast on one core.  Texts that its pattern matcher gives up on (about
    a million white-space characters in a row), and files of another kind, go through
    tokenizers."""
    if path not in _encoders:
        plain = []  # read when a text needs it, so that most tasks hold one tokenizer

        def slow(t: str) -> np.ndarray:
            if not plain:
                from tokenizers import Tokenizer

                plain.append(Tokenizer.from_file(path))
            return np.array(plain[0].encode(t, add_special_tokens=False).ids, np.uint32)

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens", [])
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        known = byte_level and model["type"] == "BPE" and not any((spec.get("normalizer"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("ignore_merges")))
        if not known or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            _encoders[path] = slow
            return slow
        import tiktoken

        # byte-level BPE writes each byte as a printable character: printable Latin-1 as itself, the others from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("packing", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)

        def encode(t: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(t, allowed_special="all", disallowed_special=())
            except ValueError:
                return slow(t)

        _encoders[path] = encode
    return _encoders[path]


class Tier:
    """Remainders ordered by length, and by arrival among equals."""

    def __init__(self):
        self.items: list[tuple[int, int]] = []

    def add(self, length: int, n: int) -> None:
        insort(self.items, (length, n))

    def fit(self, gap: int) -> tuple[int, int] | None:
        """Take the longest remainder of at most ``gap``."""
        k = bisect_left(self.items, (gap + 1, -1))
        return self.items.pop(k - 1) if k else None

    def longest(self) -> tuple[int, int] | None:
        return self.items.pop() if self.items else None


def tier_of(tokens: int, window: int = WINDOW) -> int:
    """0 .. 3: the tier of the smallest context size that holds a document."""
    return min(3, bisect_left([window // 8, window // 4, window // 2], tokens))


def pack(items: list[tuple[int, int]], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(context size, pieces (remainder, start, length)) for remainders (length, tier) shorter than ``window``.

    A sequence fills its context size; the last ones of a tier are powers of two."""
    sizes = [window // 8, window // 4, window // 2, window]
    tiers = [Tier() for _ in sizes]
    done = [0] * len(items)  # tokens of a remainder already placed
    for n, (length, k) in enumerate(items):
        tiers[k].add(length, n)
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    for k in reversed(range(len(sizes))):
        size, lower = sizes[k], tiers[: k + 1]
        while (first := tiers[k].longest()) is not None:
            seq, gap = [], size

            def place(n: int, length: int) -> None:
                nonlocal gap
                seq.append((n, done[n], length))  # noqa: B023
                done[n] += length
                gap -= length

            place(first[1], first[0])
            while gap:
                got = next((x for t in reversed(lower) if (x := t.fit(gap))), None)
                if got:
                    place(got[1], got[0])
                    continue
                got = next((x for t in lower if (x := t.longest())), None)  # nothing fits: a head of the shortest tier's
                if got is None:
                    break
                place(got[1], gap)
                left = items[got[1]][0] - done[got[1]]
                tiers[items[got[1]][1]].add(left, got[1])
            if not gap:
                out.append((size, seq))
                continue
            # nothing is left in this and shorter tiers: cut the pieces where the sizes of powers of two end
            used = size - gap
            bits = [1 << b for b in reversed(range(used.bit_length())) if used >> b & 1]
            part, room = [], bits[0]
            for n, start, length in seq:
                while length:
                    take = min(room, length)
                    part.append((n, start, take))
                    start, length, room = start + take, length - take, room - take
                    if not room:
                        out.append((bits.pop(0), part))
                        part, room = [], bits[0] if bits else 0
    return out


SCHEMA = "{key} {type}, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def packed(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """One row for each piece: key, start, length, token_ids (little-endian uint32),
    doc_tokens, sequence_id, offset, tier (the context size of its sequence) and step_group."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        base = TaskContext.get().partitionId() << 36
        count, keys, pending, cost = 0, [], [], []
        cols: dict = {}

        def emit(k, start, ids, total, seq, offset, tier):
            for name, v in zip(("key", "start", "length", "ids", "total", "seq", "offset", "tier"), (k, start, len(ids), ids.tobytes(), total, seq, offset, tier), strict=True):
                cols.setdefault(name, []).append(v)

        def flush(groups: list[int]):
            """The batch of what was emitted; groups: the step group of each sequence since the last flush."""
            first = flush.first
            step = [base + groups[s - base - first] for s in cols["seq"]]
            flush.first = count
            got = pa.RecordBatch.from_arrays(
                [pa.array(cols["key"], key_type), pa.array(cols["start"], pa.int64()), pa.array(cols["length"], pa.int64()), pa.array(cols["ids"], pa.binary()), pa.array(cols["total"], pa.int64()), pa.array(cols["seq"], pa.int64()), pa.array(cols["offset"], pa.int64()), pa.array(cols["tier"], pa.int32()), pa.array(step, pa.int64())],
                [key, "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"],
            )
            cols.clear()
            return got

        def balanced() -> list[int]:
            """Step groups: the sequences of a context size by falling cost, dealt to and fro over its groups."""
            nonlocal cost
            groups = [0] * len(cost)
            for size in sorted({x for x, _ in cost}):
                own = sorted((i for i, x in enumerate(cost) if x[0] == size), key=lambda i: (-cost[i][1], i))
                n = -(-len(own) * size // (STEP * window))
                for i, s in enumerate(own):
                    turn, at = divmod(i, n)
                    groups[s] = flush.group + (at if turn % 2 == 0 else n - 1 - at)
                flush.group += n
            cost = []
            return groups

        def settle():
            nonlocal count, keys, pending
            for size, seq in pack([(len(ids), tier_of(total, window)) for ids, _, total in pending], window):
                offset = 0
                for n, start, length in seq:
                    ids, before, total = pending[n]
                    emit(keys[n], before + start, ids[start : start + length], total, base + count, offset, size)
                    offset += length
                cost.append((size, sum(x * x for *_, x in seq)))
                count += 1
            keys, pending = [], []

        flush.first = flush.group = 0
        key_type = None
        for b in batches:
            key_type = b.column(0).type
            ks = b.column(0)
            for i, t in enumerate(T.strings(b.column(1))):
                ids = enc(t) if t else np.zeros(0, np.uint32)
                ids = np.append(ids, np.uint32(end)).astype("<u4", copy=False)
                k, total = ks[i].as_py(), len(ids)
                full = total // window * window
                for start in range(0, full, window):
                    emit(k, start, ids[start : start + window], total, base + count, 0, window)
                    cost.append((window, window * window))
                    count += 1
                if total > full:
                    keys.append(k)
                    pending.append((ids[full:].copy(), full, total))
                if len(pending) >= GROUP:
                    settle()
                    yield flush(balanced())
                elif len(cols.get("seq", ())) >= 8192:
                    yield flush(balanced())
        settle()
        if cols:
            yield flush(balanced())

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, SCHEMA.format(key=f"`{key}`", type=kind))
