"""Quality rules under weak supervision.

Every rule votes keep (1) or reject (0) on a text, or abstains (-1).  The votes
of the whole corpus are counted by pattern (at most 3**rules patterns, whatever
the input's size), expectation-maximisation over these counts estimates how
each rule votes on good and on bad texts, and the posterior probability of
quality replaces the demand that all rules pass.  Two limits remain absolute
because the caller sets them: a text below ``MIN_WORDS`` words, or one most of
whose words stand in repeated 3-word windows, fails.

Null and empty texts have no words and fail; texts of any length are read whole,
one over text.CHUNK bytes in a run of its own; repeated rows and null keys get equal
results; a posterior of exactly the threshold is kept; an empty table gives an
empty result.  Only key and text are read, so extra columns of any name are no
matter; the results' names are fixed.

How far rates move: ``fit_votes`` mixes pseudo-votes worth PSEUDO of the texts into
every estimate, so a rate ends at most 1 / (1 + PSEUDO) of the way from its start to
what the votes say.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm import text as T
from rowmill.llm.stored import shared_folder

MIN_WORDS, PSEUDO, PRIOR = 50, 0.05, 0.8
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_shout long, n_distinct long, n_lone long, n_stops long"

_SYMBOL, _SHOUT, _STOP, _NEWLINE = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>", b"!?", b".:;,", b"\n"))


def measure(view: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each row.  Windows, lines and words are compared by 64-bit hashes."""
    n = len(offs) - 1
    space = T.SPACE[view]
    start, end, row = T.spans(~space, offs)
    h = T.hashes(view, start, end)
    salt = T.seeds(n, 3)

    win, at = T.windows(h, row, 3)
    key = win ^ salt[row[at]]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key) + 1, bool)
    twice[:-1][order[1:]] |= same
    twice[:-1][order[:-1]] |= same
    covered = np.zeros(len(h) + 2, bool)
    for i in range(3):
        covered[at[twice[:-1]] + i] = True

    lstart, lend, lrow = T.spans(~_NEWLINE[view], offs)
    inked = np.concatenate(([0], np.cumsum(~space)))
    full = inked[lend] > inked[lstart]
    lines = T.hashes(view, lstart[full], lend[full]) ^ salt[lrow[full]]
    lrow = lrow[full]
    _, first = np.unique(lines, return_index=True)
    n_lines = T.per_row(lrow, n)
    _, unique = np.unique(h ^ salt[row], return_index=True)
    mark = ~T.LETTER[view[start]] & ~T.DIGIT[view[start]] if len(start) else np.zeros(0, bool)
    return {
        "n_words": T.per_row(row, n),
        "word_chars": T.bytes_per_row(~space & T.HEAD[view], offs),
        "n_symbols": T.bytes_per_row(_SYMBOL[view], offs),
        "n_dup_lines": n_lines - T.per_row(lrow[first], n),
        "n_repeat_words": T.per_row(row[covered[: len(h)]], n),
        "n_lines": n_lines,
        "n_upper": T.bytes_per_row(T.UPPER[view], offs),
        "n_letters": T.bytes_per_row(T.LETTER[view] & T.HEAD[view], offs),
        "n_shout": T.bytes_per_row(_SHOUT[view], offs),
        "n_distinct": T.per_row(row[unique], n),
        "n_lone": T.per_row(row[mark], n),
        "n_stops": T.bytes_per_row(_STOP[view], offs),
    }


def text_stats():
    """An Arrow UDF text -> struct of STATS."""
    names = [x.split()[0] for x in STATS.split(", ")]

    @F.arrow_udf("struct<" + STATS.replace(" long", ": bigint") + ">")
    def stats(col: pa.Array) -> pa.Array:
        out = {k: np.zeros(len(col), np.int64) for k in names}
        for lo, view, offs in T.views(col):
            for k, v in measure(view, offs).items():
                out[k][lo : lo + len(v)] = v
        return pa.StructArray.from_arrays([pa.array(out[k]) for k in names], names)

    return stats.asNondeterministic()


def rules(prefix: str = "") -> dict[str, Column]:
    """Name -> vote over the columns of STATS, whose names begin with ``prefix``.

    Rules that look for one defect vote reject or abstain: that a text lacks this
    defect says little.  Rules that see signs of ordinary prose may vote keep."""
    c = lambda name: F.col(prefix + name)
    share = lambda a, b: F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0))
    mean = share("word_chars", "n_words")
    over = lambda value, limit: F.when(value > limit, 0).otherwise(-1)
    stops = share("n_stops", "n_words")
    variety = share("n_distinct", "n_words")
    long = c("n_words") >= 2 * MIN_WORDS
    return {
        "length": F.when(c("n_words") < MIN_WORDS, 0).when(long, 1).otherwise(-1),
        "word_size": F.when(mean.between(3, 10), 1).when((mean < 2) | (mean > 14), 0).otherwise(-1),
        "punctuated": F.when(c("n_words") < MIN_WORDS, -1).when(stops.between(0.03, 0.5), 1).when(stops < 0.005, 0).otherwise(-1),
        "variety": F.when((variety < 0.05) | (~long & (variety < 0.15)), 0).when(variety >= 0.3, 1).otherwise(-1),
        "symbols": over(share("n_symbols", "n_words"), 0.25),
        "symbol_share": over(share("n_symbols", "word_chars"), 0.08),
        "dup_lines": over(share("n_dup_lines", "n_lines"), 0.5),
        "repeats": over(share("n_repeat_words", "n_words"), 0.5),
        "capitals": over(share("n_upper", "n_letters"), 0.5),
        "shouting": over(share("n_shout", "n_words"), 0.3),
        "lone_marks": over(share("n_lone", "n_words"), 0.2),
    }


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, prior: float = PRIOR, weight: float = PSEUDO):
    """EM over vote patterns and their counts.

    Returns (prior log-odds of quality, R x 2 array of the log-odds that a reject
    and a keep vote of each rule add).  An abstention adds nothing.  At the start
    a reject vote is held far likelier on a bad text and a keep vote a little
    likelier on a good one; pseudo-votes of this form, as many as ``weight`` of the
    texts, stay in every estimate, so that a rule that never votes keeps its
    start and none decides without bound.  The share of good texts is the
    caller's ``prior``: left free, the two classes may slide into kinds of good
    text."""
    start = np.array([[0.004, 0.6], [0.35, 0.4]])  # class bad last: P(reject), P(keep)
    if not patterns:
        return float(np.log(prior / (1 - prior))), np.zeros((0, 2))
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    one = np.stack([v == 0, v == 1], 2).astype(float)  # patterns x rules x (reject, keep)
    pseudo = weight * n.sum()
    rate = np.repeat(start[:, None, :], v.shape[1], 1)
    for _ in range(rounds):
        odds = np.log(rate[0]) - np.log(rate[1])
        q = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + np.einsum("prv,rv->p", one, odds), -500, 500)))
        new = np.stack([(np.einsum("p,prv->rv", n * w, one) + pseudo * s) / ((n * w).sum() + pseudo) for w, s in ((q, start[0]), (1 - q, start[1]))])
        moved = np.abs(new - rate).max()
        rate = new
        if moved < 1e-7:
            break
    odds = np.log(rate[0]) - np.log(rate[1])
    odds[:, 0] = np.minimum(odds[:, 0], 0)  # a rule is never read against its meaning
    odds[:, 1] = np.maximum(odds[:, 1], 0)
    return float(np.log(prior / (1 - prior))), odds


def learn(stats: DataFrame) -> tuple[float, np.ndarray]:
    """fit_votes over the votes on a frame that has the columns of STATS."""
    made = rules()
    counted = stats.select(*(x.alias(k) for k, x in made.items())).groupBy(*made).count().collect()
    return fit_votes(sorted((tuple(r[k] for k in made), r["count"]) for r in counted))


def verdict(model: tuple[float, np.ndarray], prefix: str = "", threshold: float = 0.5, max_repeat_pct: int = 50) -> dict[str, Column]:
    """base_failed, posterior and kept over the columns of STATS."""
    base, odds = model
    z = F.lit(base)
    for vote, row in zip(rules(prefix).values(), odds, strict=False):
        z = z + F.when(vote == 0, F.lit(float(row[0]))).when(vote == 1, F.lit(float(row[1]))).otherwise(F.lit(0.0))
    n = F.col(prefix + "n_words")
    failed = (n < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > max_repeat_pct * n)
    posterior = 1 / (1 + F.exp(-z))
    return {"base_failed": failed, "posterior": posterior, "kept": ~failed & (posterior >= threshold)}


def quality_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the statistics, base_failed, posterior and kept for every row of ``docs``.

    Texts are read once: their statistics (a few numbers a row) are written to
    the checkpoint folder before votes are counted over them."""
    shared_folder(docs.sparkSession)
    stats = docs.select(F.col(key), text_stats()(F.col(text)).alias("_s")).select(key, "_s.*").checkpoint()
    return stats.withColumns(verdict(learn(stats)))
