"""Quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader (FTRL-proximal) updates.

Features of a text, all hashed into ``2**bits`` slots: tokens and token pairs
(runs of letters, digits or marks, lower-cased), and the shapes of tokens and of
token pairs (kind, length, capitals, whether the token repeats an earlier
neighbour).  Their values are shares of the text's tokens.  Every shard of the
bounded sample is trained on its own and the weights are averaged, so no task
sees more than ``max_rows / shards`` texts; a text is scored as a sparse dot
product in one pass, without a shuffle.

Null and empty texts have no features and score the intercept alone; texts of any
length are read whole, one over text.CHUNK bytes in a run of its own; repeated rows
and null keys score alike; with no labelled rows every text scores 0.5; an empty
table gives an empty result.  Only doc_id and text are read, so extra columns of any
name are no matter; the results' names are fixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm import text as T
from rowmill.llm.samples import held_out, labelled

BITS, SHARDS, EPOCHS, MAX_ROWS = 18, 8, 4, 24_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.05
SCALE = 12.0


def features(view: np.ndarray, offs: np.ndarray, bits: int):
    """(slot, row) for every feature occurrence, and the tokens of each row."""
    h, row, start, end = T.tokens(view, offs)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1)
    kind = np.where(T.LETTER[view[start]], 0, np.where(T.DIGIT[view[start]], 1, 2))
    upper = np.concatenate(([0], np.cumsum(T.UPPER[view])))
    caps = upper[end] - upper[start]
    size = end - start
    again = np.zeros(len(h), np.int64)
    for back in (1, 2, 3):
        again[back:] |= (h[back:] == h[:-back]) & (row[back:] == row[:-back])
    alone = np.zeros(len(h), np.int64)  # does white space come before the token?
    alone[1:] = start[1:] > end[:-1]
    case = np.where(caps == 0, 0, np.where(caps == size, 1, np.where(T.UPPER[view[start]] & (caps == 1), 2, 3)))
    shape = ((kind * 4 + case) * 2 + again) * 2 + alone
    shape = T.mix((shape * 32 + np.minimum(size, 24)).astype(np.uint64) + np.uint64(1 << 40))
    coarse = T.mix((((kind * 4 + case) * 2 + again) * 2 + alone).astype(np.uint64) + np.uint64(1 << 41))
    two, at = T.windows(h, row, 2)
    pair, pat = T.windows(coarse, row, 2)
    tri, tat = T.windows(coarse, row, 3)
    slot = np.concatenate([h, two, shape, pair, tri]) >> np.uint64(64 - bits)
    return slot.astype(np.int64), np.concatenate([row, row[at], row, row[pat], row[tat]]), T.per_row(row, len(offs) - 1)


def ftrl(batches, bits: int, epochs: int):
    """FTRL-proximal over (slots, values, y) triples; returns weights with the intercept last."""
    n = 1 << bits
    z, g2 = np.zeros(n + 1), np.zeros(n + 1)
    weights = lambda i: np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(g2[i])) / ALPHA + L2))
    order = np.arange(len(batches))
    for e in range(epochs):
        np.random.default_rng(e).shuffle(order)
        for k in order:
            i, x, y = batches[k]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(g2[i] + g * g) - np.sqrt(g2[i])) / ALPHA * w
            g2[i] += g * g
    return weights(np.arange(n + 1))


def train(sample: DataFrame, bits: int = BITS, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Averaged weights (intercept last) from rows doc_id, text, y."""

    def fit(table: pa.Table) -> pa.Table:
        y = table.column("y").to_numpy()
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        made: list = [None] * len(y)
        for lo, view, offs in T.views(table.column("text")):
            slot, row, n = features(view, offs, bits)
            by = np.argsort(row, kind="stable")
            slot, cut = slot[by], np.searchsorted(row[by], np.arange(len(offs)))
            for r in range(len(offs) - 1):
                i, c = np.unique(slot[cut[r] : cut[r + 1]], return_counts=True)
                made[lo + r] = (np.append(i, 1 << bits), np.append(c * (SCALE / max(n[r], 1)), 1.0), float(y[lo + r]))
        w = ftrl([made[i] for i in order], bits, epochs)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "n": pa.array([len(y)], pa.int64()), "w": pa.array([w.astype("<f4").tobytes()], pa.binary())})

    rows = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards))).groupBy("shard").applyInArrow(fit, "shard long, n long, w binary").collect()
    rows.sort(key=lambda r: r.shard)
    if not rows:
        return np.zeros((1 << bits) + 1, np.float32)
    n = np.array([r.n for r in rows], float)
    return (np.stack([np.frombuffer(r.w, "<f4") for r in rows]) * (n / n.sum())[:, None]).sum(0).astype(np.float32)


def scorer(w: np.ndarray, bits: int = BITS):
    """An Arrow UDF text -> score under the weights."""

    @F.arrow_udf("double")
    def score(col: pa.Array) -> pa.Array:
        out = np.zeros(len(col))
        for lo, view, offs in T.views(col):
            slot, row, n = features(view, offs, bits)
            out[lo : lo + len(n)] = T.per_row(row, len(n), w[slot].astype(np.float64)) * SCALE / np.maximum(n, 1) + w[-1]
        return pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, out_fold: int = 2, threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Labels are learnt outside fold ``out_fold`` only; ``max_rows`` bounds the
    labelled rows that the classifier is fitted on."""
    sample = labelled(docs, labels, "quality", ~held_out(F.col("doc_id"), folds, out_fold), max_rows)
    score = scorer(train(sample))
    return docs.select("doc_id", held_out(F.col("doc_id"), folds, out_fold).alias("held_out"), score("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
