"""URL filter: the ratio of two character language models.

One smoothed variable-order Markov model is counted over accepted URLs and one
over rejected URLs.  The probability of a byte interpolates its orders: each
order's counts are joined with a fixed weight of the next shorter order's
probability, down to an even one, so rare long contexts fall back on short ones.
A URL's score is the log-likelihood difference of the models per byte.

URLs are dealt by hash to two folds, and each fold is scored by the models of the other, so
no URL is judged by its own label: what others like it were decides.  A logistic
curve fitted on all labelled URLs calibrates these scores to a probability of acceptance.

Counts are exact and kept in Spark: a byte with the ORDER bytes before it is one
64-bit number, so nothing collides and the tables grow with the corpus.  The
score of each such window is computed once, on the table of different windows, by
joins of each order with the next shorter one; a URL's score is the sum over its
windows.  The windows that make up 1 / ``HOT`` of all or more, ``HOT`` at most, are
summed in the task that reads the URL; only the rarer ones are shuffled.

What is learned from: a URL is a rejected example if its host looks like those of
generated spam sites, by the host statistics of Fetterly, Manasse and Najork
(WebDB 2004): dashes between letters or two dashes in a host's name, many dots, many digits, or a very long
name.  A URL that a rule blocks is neither (else the rule's host and path would be
all that the rejected model sees); all others are accepted examples.

Domain rules come first: a rule fits its host and all subdomains if the path
starts with the rule's, and the longest rule decides (of equally long ones the last
by code point; two such can only fit one URL if they are the same).  Null URLs and
URLs without "://" have an empty host and path; nulls score as an empty URL does,
0; URLs of any length are read whole; repeated rows and null keys score alike; if
one class has no URL, nothing is blocked by model; an empty table gives an empty
result.  Only key and url are read, so extra columns of any name are no matter; the
results' names are fixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm import text as T
from rowmill.llm.stored import drop, stored

ORDER, PULL, HOT = 5, 2.0, 100_000
#: Bits of a byte in a window; value 256 stands before the start of a URL.
WIDE, START = 9, 256


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at = rule.index("/") if "/" in rule else len(rule)
        own, start = rule[:at], rule[at:]
        out = F.when(((host == own) | host.endswith("." + own)) & path.startswith(start), rule).otherwise(out)
    return out


def spam_like(host: Column) -> Column:
    """Whether a host name has the marks of a generated spam site."""
    host = F.regexp_replace(host, r"(^|\.)xn--", "$1")  # the mark of names in other scripts
    dashes, dots, digits = (F.length(host) - F.length(F.regexp_replace(host, x, "")) for x in ("-", r"\.", "[0-9]"))
    return host.rlike("[a-z]-[a-z]") | (dashes >= 2) | (dots >= 5) | (digits >= 5) | (F.length(host) > 60)


def windows(view: np.ndarray, offs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte the number of the window of it and the ``order`` bytes before it, A-Z as a-z."""
    n = len(offs) - 1
    grown = np.full(len(view) + order * n, START, np.int64)
    at = np.arange(len(view)) + order * np.repeat(np.arange(1, n + 1), np.diff(offs))
    grown[at] = T.LOWER[view]
    return sum(grown[at - k] << (WIDE * k) for k in range(order + 1))


def windows_of():
    """An Arrow UDF url -> its windows."""

    @F.arrow_udf("array<bigint>")
    def made(col: pa.Array) -> pa.Array:
        size, parts = np.zeros(len(col) + 1, np.int64), [np.zeros(0, np.int64)]
        for lo, view, offs in T.views(col):
            parts.append(windows(view, offs))
            size[lo + 1 : lo + len(offs)] = np.diff(offs)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(size).astype(np.int32)), pa.array(np.concatenate(parts)))

    return made


def window_scores(counted: DataFrame, order: int = ORDER, pull: float = PULL) -> DataFrame:
    """w, n and score_0, score_1 (log of accepted over rejected probability of its last byte, for URLs of that fold, from
    the counts of the other) for the rows w, n (in all URLs), a_0, r_0, a_1, r_1 (in accepted and rejected examples of the folds).

    Each order's counts and probabilities are stored: as one plan, the orders came to dozens of
    exchanges planned and run at once, too much for the driver's memory.  The result is stored too."""
    short = lambda w, k: F.col(w).bitwiseAND((1 << WIDE * (k + 1)) - 1)
    of = ("a_0", "r_0", "a_1", "r_1")
    level = {order: counted.select("w", "n", *of)}
    for k in range(order - 1, -1, -1):
        level[k] = stored(level[k + 1].groupBy(short("w", k).alias("w")).agg(*(F.sum(c).alias(c) for c in of)))
    score = [(F.ln(f"pa_{1 - f}") - F.ln(f"pr_{1 - f}")).alias(f"score_{f}") for f in (0, 1)]
    prob = None
    for k in range(order + 1):
        own = level[k].withColumn("ctx", F.shiftright("w", WIDE))
        total = own.groupBy("ctx").agg(*(F.sum(c).alias(f"t{c}") for c in of))
        # tables of longer windows grow with the corpus: they meet by sorting, however small
        met = (lambda df: df.hint("merge")) if k > 1 else (lambda df: df)
        own = own.join(met(total), "ctx")
        if prob is None:
            own = own.withColumns({f"p{c}": F.lit(1 / 256) for c in of})
        else:
            own = own.withColumn("s", short("w", k - 1)).join(met(prob.withColumnRenamed("w", "s")), "s")
        own = own.withColumns({f"p{c}": (F.col(c) + pull * F.col(f"p{c}")) / (F.col(f"t{c}") + pull) for c in of})
        made = stored(own.select("w", "n", *score) if k == order else own.select("w", *(f"p{c}" for c in of)))
        drop(prob)
        drop(level.pop(k))
        prob = made
    return prob


def url_scores(rows: DataFrame, scores: DataFrame, hot: int = HOT) -> DataFrame:
    """``rows`` (id, url, fold and others) with their score per byte, from window scores."""
    total = scores.agg(F.sum("n")).head()[0] or 0
    common = scores.where(F.col("n") * hot >= total).select("w", "score_0", "score_1").orderBy("w").toArrow()
    known, values = common.column("w").to_numpy(), [common.column(f"score_{f}").to_numpy() for f in (0, 1)]

    @F.arrow_udf("struct<sum: double, n: bigint, rest: array<bigint>>")
    def split(col: pa.Array, fold: pa.Array) -> pa.Array:
        second = np.asarray(fold) == 1
        n, sums, size, rest = np.zeros(len(col), np.int64), np.zeros(len(col)), np.zeros(len(col) + 1, np.int64), [np.zeros(0, np.int64)]
        for lo, view, offs in T.views(col):
            m = len(offs) - 1
            w, row = windows(view, offs), np.repeat(np.arange(m), np.diff(offs))
            at = np.searchsorted(known, w)
            found = known[np.minimum(at, len(known) - 1)] == w if len(known) else np.zeros(len(w), bool)
            n[lo : lo + m] = np.diff(offs)
            value = np.where(second[lo : lo + m][row[found]], values[1][at[found]], values[0][at[found]])
            sums[lo : lo + m] = T.per_row(row[found], m, value)
            size[lo + 1 : lo + 1 + m] = T.per_row(row[~found], m)
            rest.append(w[~found])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(size).astype(np.int32)), pa.array(np.concatenate(rest)))
        return pa.StructArray.from_arrays([pa.array(sums), pa.array(n), lists], ["sum", "n", "rest"])

    parts = rows.withColumn("_s", split("url", "fold"))
    rare = parts.select("id", "fold", F.explode("_s.rest").alias("w")).join(scores.where(F.col("n") * hot < total).drop("n").hint("merge"), "w")
    rare = rare.groupBy("id").agg(F.sum(F.when(F.col("fold") == 1, F.col("score_1")).otherwise(F.col("score_0"))).alias("_r"))
    whole = F.col("_s.sum") + F.coalesce("_r", F.lit(0.0))
    return parts.join(rare.hint("merge"), "id", "left").withColumn("score", F.round(F.coalesce(F.try_divide(whole, F.col("_s.n")), F.lit(0.0)), 12)).drop("_s", "_r")


def calibrate(scored: DataFrame, bins: int = 200, reach: float = 4.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a + b * score))) from rows score, y, by a histogram of ``bins`` scores."""
    k = F.least(F.greatest(F.floor((F.col("score") + reach) * (bins / (2 * reach))), F.lit(0)), F.lit(bins - 1))
    got = scored.groupBy(k.alias("k"), "y").count().collect()
    x = np.array([(r.k + 0.5) * 2 * reach / bins - reach for r in got])
    y, n = np.array([r.y for r in got], float), np.array([r["count"] for r in got], float)
    if len(set(y)) < 2:
        return 35.0, 0.0
    w, X = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        step = np.linalg.solve((X * (n * p * (1 - p))[:, None]).T @ X + 0.5 * np.eye(2), X.T @ (n * (y - p)) - 0.5 * w)
        w = w + np.clip(step, -5, 5)
    return float(w[0]), float(w[1])


def filter_urls(pages: DataFrame, rules: dict[str, str], key: str = "page_id", url: str = "url", spam=spam_like, threshold: float = 0.5) -> DataFrame:
    """key, host, path, rule, verdict, score and accept (its calibrated probability) of every row.

    ``spam`` makes, from the host column, the condition for rejected examples."""
    rows = pages.select(F.col(key).alias("key"), F.coalesce(url, F.lit("")).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    said = F.create_map(*(F.lit(x) for kv in rules.items() for x in kv))[F.col("rule")] if rules else F.lit(None).cast("string")
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("said", said)
    label = F.when(F.coalesce(F.col("said") == "block", F.lit(False)), None).when(spam(F.col("host")), 0).otherwise(1)
    rows = rows.withColumn("label", label).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(2)).cast("int"))
    rows = stored(rows.withColumn("id", F.monotonically_increasing_id()))

    each = rows.select(F.explode(windows_of()("url")).alias("w"), "fold", "label")
    count = lambda y, f: F.count_if((F.col("label") == y) & (F.col("fold") == f)).alias(f"{'ra'[y]}_{f}")
    counted = stored(each.groupBy("w").agg(F.count(F.lit(1)).alias("n"), *(count(y, f) for f in (0, 1) for y in (1, 0))))
    scores = window_scores(counted)
    scored = stored(url_scores(rows, scores))
    for x in (rows, counted, scores):
        drop(x)
    a, b = calibrate(scored.where("label is not null").select("score", F.col("label").alias("y")))
    accept = 1 / (1 + F.exp(-(a + b * F.col("score"))))
    out = scored.withColumn("accept", accept)
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("said", F.when(F.col("accept") >= threshold, "allow").otherwise("block")).alias("verdict"), "score", "accept")
