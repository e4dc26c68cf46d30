"""Toxic passages by maximum-scoring segments.

Each token has a log-odds of toxic against clean text, under a Dirichlet prior
whose centre is that of the token's stem, and a stem's centre that of its shorter
stem, up to the pooled distribution; so few labelled texts still tell on words not
seen among them.  Less a fixed drift, so that ordinary text scores below zero,
these are the scores in which a linear-time scan finds every maximal-scoring
segment of a text.  Segment scores of clean
texts follow an extreme-value law; its two constants are estimated from clean
training texts, and a document's segments are joined by the sum statistic of
that law into one evidence value, which a logistic curve turns into a score.

Null and empty texts have no segment and score as a text without evidence; texts
of any length are read whole, a text over text.CHUNK bytes in a run of its own;
repeated rows score alike; an empty table gives an empty result; without labelled
rows of both classes all score 0.  Only key and text are read, so extra columns of
any name are no matter; the results' names are fixed.
"""

from __future__ import annotations

from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm import text as T
from rowmill.llm.samples import held_out, labelled
from rowmill.llm.stored import drop, stored

BITS, PRIOR, SURE, DRIFT, MAX_ROWS = 19, 2.0, 1.5, 1.5, 60_000
#: Lengths of a word's stems in code points; a word's own counts are level LAST.
STEMS = (4, 6)
LAST = len(STEMS)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past-the-last, sum) of ``score``.

    A stack of candidate segments carries the running totals at their left and
    right ends; only positive positions are visited.  Every candidate is linked to
    the nearest one before it whose left total is lower.  A search goes along these
    links alone and passes each candidate once, so the time is linear."""
    total = np.cumsum(score)
    stack: list[tuple[int, int, float, float, int]] = []  # first, past, total before, total after, link
    for i in np.flatnonzero(score > 0).tolist():
        first, low, high = i, float(total[i] - score[i]), float(total[i])
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                break
            first, _, low, _, link = stack[j]
            del stack[j:]
            j = link
        stack.append((first, i + 1, low, high, j))
    return [(a, b, r - x) for a, b, x, r, _ in stack]


def moved(up: np.ndarray, n0: np.ndarray, n1: np.ndarray, base: float, weight: float = PRIOR, sure: float = SURE) -> np.ndarray:
    """Log-odds of tokens from their counts on clean and toxic texts, under a Dirichlet
    prior of ``weight`` tokens whose centre has the log-odds ``up``; ``base`` is the
    log ratio of all toxic to all clean tokens.

    They leave the centre only as far as ``sure`` of their standard deviations allow,
    so a token seen once or twice says what its stem says."""
    share = 1 / (1 + np.exp(-np.clip(up + base, -30, 30)))
    y1, y0 = n1 + weight * share, n0 + weight * (1 - share)
    off = np.log(y1) - np.log(y0) - base - up
    return up + np.sign(off) * np.maximum(np.abs(off) - sure * np.sqrt(1 / y1 + 1 / y0), 0)


def law(score: np.ndarray, n: np.ndarray) -> float:
    """lambda with E[exp(lambda * score)] = 1 over ``n`` clean tokens of each score, 2 at most
    (where hardly any clean token scores above 0); the mean must be negative."""
    w = n / max(n.sum(), 1)
    lo, hi = 1e-3, 2.0
    f = lambda x: float((w * np.exp(np.minimum(x * score, 60))).sum()) - 1
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def evidence(sums: list[float], n: int, lam: float, log_k: float) -> float:
    """-log10 of the smallest sum-statistic p-value over the r best segments."""
    best, acc = 0.0, 0.0
    for r, s in enumerate(sorted(sums, reverse=True), 1):
        acc += lam * s - log_k - log(max(n, 2))
        if acc <= 0:
            break
        best = max(best, (acc - (r - 1) * log(max(acc, 1.0)) + lgamma(r + 1) + lgamma(r)) / log(10))
    return best


def levels(view: np.ndarray, offs: np.ndarray):
    """(slots, row, start, end) of the words of letters: for each its stems of STEMS
    code points and itself, the last row of slots."""
    _, row, start, end = T.tokens(view, offs, hashed=False)
    keep = T.LETTER[view[start]] if len(start) else np.zeros(0, bool)
    row, start, end = row[keep], start[keep], end[keep]
    low = T.LOWER[view]
    ends = [*(T.heads(view, start, end, k) for k in STEMS), end]
    slots = [(T.mix(T.hashes(low, start, e) + T.seeds(1, 50 + i)[0]) >> np.uint64(64 - BITS)).astype(np.int64) for i, e in enumerate(ends)]
    return slots, row, start, end


class Model:
    """Token counts by slot, the two constants of the law, and the final curve."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.float32)
        size = counts[:, LAST].sum(1)
        self.base = log(max(size[1], 1)) - log(max(size[0], 1))
        self.lam, self.log_k, self.a, self.b, self.fitted = 1.0, 0.0, 0.0, 0.0, False

    def token_scores(self, slots: list[np.ndarray]) -> np.ndarray:
        """Each token's log-odds, from its shortest stem to itself, less the drift."""
        up = np.zeros(len(slots[0]))
        for k, s in enumerate(slots):
            up = moved(up, self.counts[0, k][s], self.counts[1, k][s], self.base)
        return up - DRIFT

    def scan(self, col: pa.Array):
        """(row, tokens, their spans in UTF-8 bytes, their scores, segments) for every text."""
        for lo, view, offs in T.views(col):
            slots, row, start, end = levels(view, offs)
            s = self.token_scores(slots)
            cut = np.searchsorted(row, np.arange(len(offs)))
            hot = T.per_row(row, len(offs) - 1, (s > 0).astype(float)) if len(row) else np.zeros(len(offs) - 1)
            for r in range(len(offs) - 1):
                a, b = cut[r], cut[r + 1]
                yield lo + r, int(b - a), (start[a:b] - offs[r], end[a:b] - offs[r]), s[a:b], segments(s[a:b]) if hot[r] else []

    def probability(self, sums: list[float], n: int) -> float:
        if not self.fitted:
            return 0.0
        e = evidence(sums, n, self.lam, self.log_k)
        return float(1 / (1 + np.exp(-np.clip(self.a + self.b * np.log1p(e), -35, 35))))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of y on x by Newton steps of bounded length with a small ridge."""
    w, X = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (y - p) - 1e-2 * w
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + 1e-2 * np.eye(2), g)
        w = w + step * min(1.0, 1.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(sample: DataFrame) -> Model:
    """Fit on rows doc_id, text, y, a bounded sample that is stored once.

    Tokens are counted on three quarters of the rows; the law and the curve are
    fitted on the rest, from all segments of each text.  Then the counts of the rest
    are added."""
    sample = stored(sample.select("text", "y", (F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(4)) == 0).cast("int").alias("part")))

    def count(batches):
        total = np.zeros((2, 2, LAST + 1, 1 << BITS), np.int32)
        for b in batches:
            which = 2 * b.column("part").to_numpy() + b.column("y").to_numpy()
            for lo, view, offs in T.views(b.column("text")):
                slots, row, _, _ = levels(view, offs)
                own = which[lo + row]
                for k, slot in enumerate(slots):
                    for c in range(4):
                        i, n = np.unique(slot[own == c], return_counts=True)
                        total[c >> 1, c & 1, k, i] += n.astype(np.int32)
        flat = total.ravel()
        i = np.flatnonzero(flat)
        for k in range(0, len(i), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(i[k : k + 100_000]), pa.array(flat[i[k : k + 100_000]].astype(np.int64))], ["slot", "n"])

    got = sample.select("part", "y", "text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * 2 * (LAST + 1) << BITS, np.int64)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    counts = counts.reshape(2, 2, LAST + 1, 1 << BITS)
    model = Model(counts[0])
    if not counts[0, 0].any() or not counts[0, 1].any():
        drop(sample)
        return model

    def held(batches):
        """One row a text with all its sums; and, with y = -1, how many tokens of clean texts have which score."""
        seen: dict[int, int] = {}
        for b in batches:
            y, out = b.column("y").to_numpy(), []
            for r, n, _, s, segs in model.scan(b.column("text")):
                out.append((int(y[r]), n, [x for *_, x in segs]))
                if not y[r]:
                    for k, c in zip(*np.unique(np.round(s * 50).astype(int), return_counts=True), strict=True):
                        seen[int(k)] = seen.get(int(k), 0) + int(c)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.float64())))], ["y", "n", "sums"])
        yield pa.RecordBatch.from_arrays([pa.array([-1] * len(seen), pa.int32()), pa.array(list(seen.values()), pa.int64()), pa.array([[k / 50] for k in seen], pa.list_(pa.float64()))], ["y", "n", "sums"])

    rows = sample.where("part = 1").select("y", "text").mapInArrow(held, "y int, n long, sums array<double>").collect()
    drop(sample)
    tokens, rows = [r for r in rows if r.y < 0], sorted((r.y, r.n, sorted(r.sums, reverse=True)) for r in rows if r.y >= 0)
    if tokens:
        model.lam = law(np.array([r.sums[0] for r in tokens]), np.array([r.n for r in tokens], float))
    clean = np.array([model.lam * sums[0] - log(max(n, 2)) for y, n, sums in rows if y == 0 and sums])
    if len(clean):  # Gumbel with scale 1 after lambda: location = mean - Euler's constant
        model.log_k = float(clean.mean() - 0.5772)
    if 0 < sum(y for y, *_ in rows) < len(rows):
        x = np.log1p(np.array([evidence(sums, n, model.lam, model.log_k) for _, n, sums in rows]))
        a, b = _curve(x, np.array([y for y, *_ in rows], float))
        lam, log_k = model.lam, model.log_k
        model = Model(counts.sum(0))
        model.lam, model.log_k, model.a, model.b, model.fitted = lam, log_k, a, b, True
    return model


def scorer(model: Model):
    """An Arrow UDF text -> struct(score, passages: array of (begin, end, sum) in UTF-8 bytes)."""
    passage = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("sum", pa.float64())])

    @F.arrow_udf("struct<score: double, passages: array<struct<begin: int, end: int, sum: double>>>")
    def score(col: pa.Array) -> pa.Array:
        out, found = np.zeros(len(col)), [[] for _ in range(len(col))]
        for r, n, (start, end), _, segs in model.scan(col):
            out[r] = model.probability([x for *_, x in segs], n)
            limit = model.log_k + log(max(n, 2)) + 3.0  # E-value below about 0.05
            found[r] = [{"begin": int(start[a]), "end": int(end[b - 1]), "sum": x} for a, b, x in segs if model.lam * x > limit]
        return pa.StructArray.from_arrays([pa.array(out), pa.array(found, pa.list_(passage))], ["score", "passages"])

    return score.asNondeterministic()


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, out_fold: int = 0, max_rows: int = MAX_ROWS) -> Model:
    """The model learnt outside fold ``out_fold``, on at most about ``max_rows`` labelled rows."""
    return train(labelled(docs, labels, "toxic", ~held_out(F.col("doc_id"), folds, out_fold), max_rows))


def toxic_passages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """key, score, predicted and the significant passages of every row of ``docs``."""
    return docs.select(F.col(key), scorer(model)(F.col(text)).alias("_t")).select(key, F.col("_t.score").alias("score"), (F.col("_t.score") >= threshold).cast("int").alias("predicted"), F.col("_t.passages").alias("passages"))
