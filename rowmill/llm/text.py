"""Vectorised reading of text columns inside Arrow tasks.

A text column arrives as an Arrow string array; its bytes are looked at in
place, in runs of rows of about ``CHUNK`` bytes, so that the memory of a task
depends on the chunk (or on its longest single text) and never on the
partition.  Words are identified by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
LETTER = UPPER | UPPER[LOWER ^ 32] | (np.arange(256) >= 0x80)
#: A code point is counted at its first byte.
HEAD = (np.arange(256) & 0xC0) != 0x80

_M1, _M2, _GOLD = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int = 1) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _GOLD)


_BYTE = seeds(256, 7)
#: A weight for each of the first byte positions; those beyond are computed as they are met.
_PLACE = seeds(1 << 14, 13) | np.uint64(1)
_POW = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)


def views(col: pa.Array, limit: int = CHUNK):
    """Yield (first row, bytes, offsets) for runs of rows; a null text is empty.

    A text longer than ``limit`` forms a run of its own."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def strings(col: pa.Array):
    """The texts of a string column, None for null; bytes that are not UTF-8 become U+FFFD."""
    for x in col:
        raw = x.as_buffer()
        yield None if raw is None else raw.to_pybytes().decode("utf-8", "replace")


def clean_utf8(view: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``view`` and ``offs`` with U+FFFD in place of bytes that are not UTF-8."""
    try:
        view.tobytes().decode("utf-8")
        return view, offs
    except UnicodeDecodeError:
        made = [view[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return np.frombuffer(b"".join(made), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in made], dtype=np.int64)))


def heads(view: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """Where the first ``k`` code points of each byte run [start, end) end."""
    at = np.append(np.flatnonzero(HEAD[view]), np.full(k + 1, len(view)))
    return np.minimum(at[np.minimum(np.searchsorted(at, start) + k, len(at) - 1)], end)


def spans(inside: np.ndarray, offs: np.ndarray, cut: np.ndarray | None = None):
    """Starts, ends and rows of the maximal runs of ``inside`` bytes; a run ends
    with its text, and where ``cut`` is set a new one begins."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    if cut is not None:
        first |= cut
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first |= edge[:-1]
    first &= inside
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ~inside[1:] | first[1:]
    last |= edge[1:]
    last &= inside
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def hashes(view: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each byte run [start, end): a sum of its bytes' random values,
    each times the random odd weight of its place, at any length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    total = int(size.sum())
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    pos = np.arange(total) - np.repeat(base, size)
    at = pos + np.repeat(start, size)
    weight = _PLACE[np.minimum(pos, len(_PLACE) - 1)]
    if size.max() > len(_PLACE):
        far = pos >= len(_PLACE)
        weight[far] = mix((pos[far] + 1).astype(np.uint64) * _GOLD + _M1) | np.uint64(1)
    return mix(np.add.reduceat(_BYTE[view[at]] * weight, base) + size.astype(np.uint64) * _GOLD)


def words(view: np.ndarray, offs: np.ndarray, lower: bool = True):
    """(hash, row) of the words ``[^\\x20\\x09-\\x0D]+``; with ``lower``, A-Z count as a-z."""
    start, end, row = spans(~SPACE[view], offs)
    return hashes(LOWER[view] if lower else view, start, end), row


def tokens(view: np.ndarray, offs: np.ndarray, hashed: bool = True):
    """(hash, row, start, end) of runs of letters, of digits, or of other marks, lower-cased."""
    kind = np.where(SPACE[view], 0, np.where(LETTER[view], 1, np.where(DIGIT[view], 2, 3)))
    cut = np.zeros(len(view), bool)
    cut[1:] = kind[1:] != kind[:-1]
    start, end, row = spans(kind > 0, offs, cut)
    return hashes(LOWER[view], start, end) if hashed else None, row, start, end


def windows(h: np.ndarray, row: np.ndarray, k: int):
    """(hash, index of the first word) of the k-word windows that lie in one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out * _POW[i + 8] + h[i : n + i])
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return out[at], at


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights, minlength=n)


def bytes_per_row(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many bytes of each row are flagged."""
    total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]
