"""Vector code compression: product codes whose codebooks are fitted by ball k-means.

Each component becomes the integer floor(1024 * x), and all arithmetic is exact.  A vector
is cut into ``PARTS`` equal consecutive parts; each part position has a codebook that
starts as that part of the ``ENTRIES`` smallest ids, and each of ``ROUNDS`` rounds
assigns every part to the nearest entry (ties to the lower index) and moves each
entry to the componentwise floor of its parts' mean.  Then parts are assigned again.

An entry and its parts form a ball.  From the first codebook on, a part is measured
against the entry that it had before; if that is at distance r, an entry nearer to it, or
as near, lies within 2 r of its own.  So the neighbours of a ball are the entries
within twice its radius, parts in its stable core (r below half of the gap to the
nearest neighbour) keep their code unmeasured, and the parts in the annular ring
between two such halves are measured only against the entries up to that gap.

Spark deals the rows: every task has its rows and the codebooks (a fixed number of
entries), sums of parts are added up in each task before they are shuffled, and only the
codebooks pass through the driver.  Rows with their codes are stored each round in place of
the round before.

Rows whose vector is null or holds null or non-finite components take no part; nor do those
of another length than most, or with an integer of 2**27 or more, for which a squared
distance need not fit a long.  Where the length is no multiple of ``PARTS``, zeros follow.
Null ids are encoded but never start an entry; repeated ids are rows of their own, those
with smaller vectors first.  Equal labels, null ones together, may hold any share of
the rows.  An empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.hot import attach
from rowmill.llm.stored import drop, stored

PARTS, ENTRIES, ROUNDS, TOO_LARGE, CHUNK = 4, 256, 4, 1 << 27, 4096
CODED = "id long, label string, v array<double>, codes array<int>, error long"


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared distances of rows of ``x`` and ``c`` (whole numbers), exactly."""
    top = max(float(np.abs(x).max(initial=0)), float(np.abs(c).max(initial=0)), 1.0)
    if 4 * x.shape[1] * top * top < 1 << 53:  # every term is a whole number that a double holds
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - c[:, k]) ** 2
    return out


def nearest_of_all(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row and the squared distance, by measuring all."""
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), CHUNK):
        d = squared_distances(x[at : at + CHUNK], book)
        code[at : at + CHUNK] = d.argmin(1)
        error[at : at + CHUNK] = d.min(1)
    return code, error


def nearest_by_balls(x: np.ndarray, code: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same from the codes of the round before, and how many distances were measured."""
    gaps = squared_distances(book, book)
    near = np.argsort(gaps, axis=1, kind="stable")
    gaps = np.take_along_axis(gaps, near, 1)
    error = ((x - book[code]) ** 2).sum(1)
    code, measured = code.copy(), len(x)
    by_entry = np.argsort(code, kind="stable")
    edges = np.searchsorted(code[by_entry], np.arange(len(book) + 1))
    for entry in np.flatnonzero(np.diff(edges)):
        ball = by_entry[edges[entry] : edges[entry + 1]]
        reach = np.searchsorted(gaps[entry], 4 * error[ball], side="right")  # entries within twice a part's distance
        outside = reach > 1  # the others are in the stable core
        ball, reach = ball[outside], reach[outside]
        ring = np.frexp(reach)[1]  # rings of 2, 4, 8 ... neighbours
        for r in np.unique(ring):
            rows = ball[ring == r]
            asked = np.sort(near[entry, : reach[ring == r].max()])
            d = squared_distances(x[rows], book[asked])
            measured += d.size
            code[rows], error[rows] = asked[d.argmin(1)], d.min(1)
    return code, error, measured


def _integers(col: pa.Array, width: int) -> np.ndarray:
    """rows x PARTS x width whole numbers of a list<double> column."""
    n = len(col)
    flat = np.floor(1024.0 * np.asarray(col.flatten(), np.float64)).astype(np.int64).reshape(n, -1) if n else np.zeros((0, PARTS * width), np.int64)
    return np.pad(flat, ((0, 0), (0, PARTS * width - flat.shape[1]))).reshape(n, PARTS, width)


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` (id, label, v, codes or null) with codes of ``books`` and the squared error."""
    width = books.shape[2]

    def assign(batches):
        for b in batches:
            x = _integers(b.column("v"), width)
            held = b.column("codes")
            old = None if held.null_count else np.asarray(held.flatten(), np.int64).reshape(len(x), PARTS)
            found = [nearest_of_all(x[:, p], books[p]) if old is None else nearest_by_balls(x[:, p], old[:, p], books[p])[:2] for p in range(PARTS)]
            codes = np.stack([f[0] for f in found], 1).astype(np.int32).ravel()
            error = sum(f[1] for f in found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(codes) + 1, PARTS, dtype=np.int32)), pa.array(codes))
            yield pa.record_batch([b.column("id"), b.column("label"), b.column("v"), lists, pa.array(error, pa.int64())], ["id", "label", "v", "codes", "error"])

    return rows.mapInArrow(assign, CODED)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after each entry's move to the floor of its parts' mean; unused entries stay."""
    width = books.shape[2]

    def add_up(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            x, codes = _integers(b.column("v"), width), np.asarray(b.column("codes").flatten(), np.int64).reshape(-1, PARTS)
            for p in range(PARTS):
                np.add.at(total[p], codes[:, p], x[:, p])
                count[p] += np.bincount(codes[:, p], minlength=books.shape[1])
        part, entry = np.nonzero(count)
        yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = rows.select("v", "codes").mapInArrow(add_up, "part int, entry int, n long, total array<long>")
    total = F.array(*(F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(width)))
    out = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("total")).collect():
        out[r.part, r.entry] = [int(t) // r.n for t in r.total]
    return out


def usable(df: DataFrame, key: str, vec: str, label: str | None) -> tuple[DataFrame, int]:
    """id, label, v of the rows that take part, and the length of their vectors (0: none)."""
    v = F.col(vec).cast("array<double>")
    named = F.col(label).cast("string") if label else F.lit(None).cast("string")
    rows = df.select(F.col(key).cast("long").alias("id"), named.alias("label"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE / 1024)))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    return (rows.where(F.size("v") == most.d), most.d) if most else (rows, 0)


def first_books(rows: DataFrame, d: int) -> np.ndarray:
    """The parts of the ``ENTRIES`` smallest ids."""
    ids = rows.where("id IS NOT NULL").select("id").orderBy("id").limit(ENTRIES)
    last = ids.agg(F.max("id")).head()[0]
    seeds = rows.where(F.col("id") <= F.lit(last)).orderBy("id", "v").limit(ENTRIES).select("v").collect() if last is not None else []
    width = max(1, -(-d // PARTS))
    seeds = seeds or [[[0.0] * d]]
    return np.ascontiguousarray(_integers(pa.array([list(s[0]) for s in seeds], pa.list_(pa.float64())), width).transpose(1, 0, 2))


def fit(df: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str | None = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, label, v, codes, error) of every usable row, stored, and the codebooks (part x entry x position)."""
    rows, d = usable(df, key, vec, label)
    books = first_books(rows, d)
    coded = stored(encoded(rows.withColumn("codes", F.lit(None).cast("array<int>")), books))
    for _ in range(rounds):
        books = moved(coded, books)
        nearer = stored(encoded(coded.drop("error"), books))
        drop(coded)
        coded = nearer
    return coded, books


def decoded(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """id and approx, the vector that the codes stand for (centres of the integers' cells)."""
    tables = F.array(*(F.array(*(F.array(*(F.lit((int(x) + 0.5) / 1024) for x in entry)) for entry in book)) for book in books))
    return coded.select("id", F.flatten(F.transform(F.arrays_zip(tables.alias("t"), F.col("codes").alias("c")), lambda z: F.get(z["t"], z["c"]))).alias("approx"))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(df: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row."""
    coded, books = fit(df, key, vec, label)
    by_label = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    out = attach(coded.select("id", "label", "codes", "error"), by_label, ["label"], "n", coded.count())
    code: list[Column] = [F.lpad(F.lower(F.hex(F.col("codes")[p])), 2, "0") for p in range(PARTS)]
    return out.select(F.col("id").alias("vec_id"), F.concat(*code).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
