"""Exact nearest rows by cosine: cells of base rows times queries, each searched as one matrix product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vector components of a cell's rows and of its queries, queries of a product, and candidates looked at together.
CELL, QUERIES, TOGETHER = 1 << 20, 256, 1 << 20


def nearest(queries: DataFrame, base: DataFrame, key: str, vec: str, k: int, group: str | None = None, tie: float = 0.0, marks: str | None = None) -> DataFrame:
    """(query_id, id, score): for every query a superset of its best k rows of other ids by cosine, ties to the smaller id.

    With ``group`` only rows of the query's group are looked at, with ``marks`` (a column of arrays of one length) only rows
    that have the query's value in one place at least.  Whoever rounds scores before ranking gives the width of the
    rounding as ``tie``: rows that close to the last place come too.  The score is null where a vector is null, has a null
    component or length 0, or where the lengths differ; such rows come last, by id.

    A task holds ``CELL`` components of each side whatever the sizes.  A product in single precision picks the candidates, with
    a margin for its error; these are scored in double precision, component by component, so equal vectors tie."""
    b, q = (_side(df, key, name, vec, group, marks) for df, name in ((base, "id"), (queries, "query_id")))
    sizes = lambda df, n: df.groupBy("_g").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.coalesce(F.greatest(F.size("v"), F.lit(1)), F.lit(1)).cast("long")) / CELL)).cast("int").alias(n))
    plan = F.broadcast(sizes(b, "_parts").join(sizes(q, "_blocks"), "_g"))  # a row a group
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = b.join(plan, "_g").withColumn("_part", place("id", "_parts")).withColumn("_block", every("_blocks")).drop("_parts", "_blocks")
    asks = q.join(plan, "_g").withColumn("_block", place("query_id", "_blocks")).withColumn("_part", every("_parts")).drop("_parts", "_blocks")
    kind = base.schema[key].dataType.simpleString()

    def best(rows: pa.Table, questions: pa.Table) -> pa.Table:
        qi, bi, score = best_of_cell(rows, questions, k, tie)
        return pa.table([questions.column("query_id").take(qi), rows.column("id").take(bi), score], ["query_id", "id", "score"])

    cell = ["_g", "_part", "_block"]
    return own.groupBy(*cell).cogroup(asks.groupBy(*cell)).applyInArrow(best, f"query_id {kind}, id {kind}, score double")


def _side(df: DataFrame, key: str, name: str, vec: str, group: str | None, marks: str | None) -> DataFrame:
    v = F.col(vec) if df.schema[vec].dataType.simpleString() in ("array<float>", "array<double>") else F.transform(vec, lambda x: x.cast("double"))
    rows = df.where(F.col(key).isNotNull() & (F.col(group).isNotNull() if group else F.lit(True)))
    return rows.select(F.col(key).alias(name), F.when(F.forall(v, lambda x: x.isNotNull()), v).alias("v"), (F.col(group) if group else F.lit(0)).alias("_g"), *([F.col(marks).alias("marks")] if marks else []))


def _by_length(col: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length of vectors: the places of its rows and their components; null and empty vectors are left out."""
    size = np.asarray(pc.fill_null(pc.list_value_length(col), 0), np.int64)
    flat = np.concatenate([np.asarray(c.flatten(), np.float64) for c in col.chunks]) if col.num_chunks else np.zeros(0)
    first = np.cumsum(size) - size
    out = {}
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        out[int(n)] = at, flat.reshape(-1, n) if len(at) == len(size) else flat[first[at, None] + np.arange(n)]
    return out


def _norms(m: np.ndarray) -> np.ndarray:
    total = np.zeros(len(m))
    with np.errstate(all="ignore"):
        for d in range(m.shape[1]):
            total += m[:, d] * m[:, d]
        return np.sqrt(total)


def _plain(norm: np.ndarray) -> np.ndarray:
    return (norm > 1e-140) & (norm < 1e140)


def _runs(*cols: np.ndarray) -> np.ndarray:
    """For rows sorted by the columns: the place in its run where each row's run begins."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    at = np.arange(len(new))
    return np.maximum.accumulate(np.where(new, at, 0))


def _few_copies(m: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that are among the k + 1 smallest ids with their vector (and marks): no others can be among the best k."""
    rows = np.ascontiguousarray(m).view(np.dtype((np.void, m.shape[1] * m.itemsize))).ravel()
    _, same = np.unique(rows, return_inverse=True)
    if len(same) == 0 or np.bincount(same).max() <= k + 1:
        return np.arange(len(m))
    order = np.lexsort((rank, same))
    ids = _runs(same[order], rank[order])
    step = np.cumsum(ids == np.arange(len(ids)))  # counts the different ids
    return np.sort(order[step - step[_runs(same[order])] <= k])


def best_of_cell(rows: pa.Table, questions: pa.Table, k: int, tie: float = 0.0) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Places of queries, places of rows, and scores."""
    names, rank = np.unique(np.asarray(rows.column("id")), return_inverse=True)
    asking = np.asarray(questions.column("query_id"))
    mine = np.searchsorted(names, asking) if len(names) else np.zeros(len(asking), np.int64)
    mine = np.where(mine < len(names), mine, 0)
    mine = np.where(names[mine] == asking, mine, -1) if len(names) else np.full(len(asking), -1)
    marks = [np.concatenate([np.asarray(c.flatten()) for c in t.column("marks").chunks] or [np.zeros(0)]).reshape(t.num_rows, -1) for t in (rows, questions)] if "marks" in rows.column_names else None
    base, asked = _by_length(rows.column("v")), _by_length(questions.column("v"))
    found = []
    left = np.ones(len(asking), bool)
    for n, (q_at, q) in asked.items():
        q_norm = _norms(q)
        some = q_norm != 0
        q_at, q, q_norm = q_at[some], q[some], q_norm[some]
        left[q_at] = False
        b_at, b = base.get(n, (np.zeros(0, np.int64), np.zeros((0, n))))
        b_norm = _norms(b)
        blank = np.ones(rows.num_rows, bool)
        blank[b_at[b_norm != 0]] = False
        keep = np.flatnonzero(b_norm != 0)
        alike = np.hstack([b, marks[0][b_at]]) if marks else b
        keep = keep[_few_copies(alike[keep], rank[b_at[keep]], k)]
        cell = _Cell(b[keep], b_norm[keep], rank[b_at[keep]], q, q_norm, mine[q_at], k, tie, [marks[0][b_at[keep]], marks[1][q_at]] if marks else None)
        qi, bi, score, void = cell.search()
        found.append((q_at[qi], b_at[keep][bi], score, void))
        if not marks:
            found.append(_unscored(q_at, np.bincount(qi, minlength=len(q_at)), np.flatnonzero(blank), rank, mine, k))
    if not marks:
        rest = np.flatnonzero(left)
        found.append(_unscored(rest, np.zeros(len(rest), np.int64), np.arange(rows.num_rows), rank, mine, k))
    qi, bi, score, void = (np.concatenate([f[i] for f in found] or [np.zeros(0, t)]) for i, t in enumerate((np.int64, np.int64, np.float64, bool)))
    return qi, bi, pa.array(score, mask=void, from_pandas=False)


def _unscored(q_at, have, blank, rank, mine, k):
    """Rows without a score, by id, for the queries that ``have`` fewer than k others."""
    order = blank[np.argsort(rank[blank], kind="stable")]
    qi, bi = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q, n in zip(q_at[have < k], have[have < k], strict=True) if len(order) else ():
        take = order[: k + 1] if mine[q] < 0 else order[rank[order] != mine[q]]
        take = take[: k - n]
        qi.append(np.full(len(take), q))
        bi.append(take)
    qi, bi = np.concatenate(qi), np.concatenate(bi)
    return qi, bi, np.zeros(len(qi)), np.ones(len(qi), bool)


class _Cell:
    """Vectors of one length, none of norm 0: ``b`` with norms and ranks of ids, ``q`` with norms and the ranks of their own ids."""

    def __init__(self, b, b_norm, rank, q, q_norm, mine, k, tie, marks):
        self.bt, self.qt = np.ascontiguousarray(b.T), np.ascontiguousarray(q.T)
        self.b_norm, self.q_norm, self.rank, self.mine, self.k, self.tie, self.marks = b_norm, q_norm, rank, mine, k, tie, marks
        b_plain, self.q_plain = _plain(b_norm), _plain(q_norm)
        self.odd = np.flatnonzero(~b_plain)
        with np.errstate(all="ignore"):
            self.bu, self.qu = (np.where(p[:, None], m / n[:, None], 0).astype(np.float32) for p, m, n in ((b_plain, b, b_norm), (self.q_plain, q, q_norm)))
        # twice what a product of unit vectors in single precision can be off, and the rounding
        self.margin = np.float32((b.shape[1] + 8) * 2.0**-22 + tie)
        self.by_rank = np.argsort(rank, kind="stable")
        self.sorted_rank = rank[self.by_rank]

    def search(self):
        out = []
        plain = np.flatnonzero(self.q_plain)
        todo = [plain[at : at + QUERIES] for at in range(0, len(plain), QUERIES)][::-1]
        while todo and len(self.rank):
            q = todo.pop()
            qi, bi = self.candidates(q)
            if len(qi) > TOGETHER and len(q) > 1:
                todo += [q[len(q) // 2 :], q[: len(q) // 2]]
                continue
            out.append(self.ranked(q[qi], bi))
        for q in np.flatnonzero(~self.q_plain) if len(self.rank) else ():
            bi = np.flatnonzero((self.rank != self.mine[q]) & self.like(np.full(len(self.rank), q), np.arange(len(self.rank))))
            out.append(self.ranked(np.full(len(bi), q), bi))
        return [np.concatenate([o[i] for o in out] or [np.zeros(0, t)]) for i, t in enumerate((np.int64, np.int64, np.float64, bool))]

    def like(self, qi, bi):
        if self.marks is None:
            return np.ones(len(qi), bool)
        return (self.marks[1][qi] == self.marks[0][bi]).any(axis=1)

    def candidates(self, q):
        """(places in q, rows): all that can be among the best k of a query, by products in single precision."""
        k, s = self.k, self.qu[q] @ self.bu.T
        s[:, self.odd] = -np.inf
        lo, hi = (np.searchsorted(self.sorted_rank, self.mine[q], side) for side in ("left", "right"))
        for i in np.flatnonzero(lo < hi):
            s[i, self.by_rank[lo[i] : hi[i]]] = -np.inf
        n = s.shape[1]
        if n <= k:
            least = np.full(len(q), -np.inf, np.float32)
        else:
            part = s[:, : max(4 * k, n // 4, 1)]
            least = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k]
        qi, bi = np.divmod(np.flatnonzero(s >= (least - self.margin)[:, None]), n)
        if self.marks is not None:
            able = self.like(q[qi], bi)
            sure = np.bincount(qi[able & (s[qi, bi] >= least[qi])], minlength=len(q))
            short = (sure < k) & (least > -np.inf)
            more = [(i, np.flatnonzero((s[i] > -np.inf) & self.like(np.full(n, q[i]), np.arange(n)))) for i in np.flatnonzero(short)]
            able &= ~short[qi]
            qi = np.concatenate([qi[able], *(np.full(len(b), i) for i, b in more)])
            bi = np.concatenate([bi[able], *(b for _, b in more)])
        near = s[qi, bi]
        some = near > -np.inf
        qi, bi, near = qi[some], bi[some], near[some]
        order = np.lexsort((-near, qi))
        qi, bi, near = qi[order], bi[order], near[order]
        if len(qi):
            last = np.minimum(_runs(qi) + k - 1, len(qi) - 1)
            some = near >= np.where(qi[last] == qi, near[last] - self.margin, -np.inf)
            qi, bi = qi[some], bi[some]
        if len(self.odd):  # no product tells anything of these
            x, y = np.repeat(np.arange(len(q)), len(self.odd)), np.tile(self.odd, len(q))
            some = (self.rank[y] != self.mine[q[x]]) & self.like(q[x], y)
            qi, bi = np.concatenate([qi, x[some]]), np.concatenate([bi, y[some]])
        return qi, bi

    def ranked(self, qi, bi):
        """The best k of the pairs of each query, and those within ``tie`` of the last; of equal scores the k smallest ids."""
        score = np.empty(len(qi))
        with np.errstate(all="ignore"):
            for at in range(0, len(qi), 1 << 16):
                x, y = qi[at : at + (1 << 16)], bi[at : at + (1 << 16)]
                total = np.zeros(len(x))
                for d in range(len(self.bt)):
                    total += self.qt[d, x] * self.bt[d, y]
                score[at : at + (1 << 16)] = total / (self.q_norm[x] * self.b_norm[y])
            void = self.q_norm[qi] * self.b_norm[bi] == 0
        order_by = np.where(void, -np.inf, np.where(np.isnan(score), np.inf, score))
        order = np.lexsort((self.rank[bi], -order_by, qi))
        qi, bi, score, void, order_by = qi[order], bi[order], score[order], void[order], order_by[order]
        if len(qi) == 0:
            return qi, bi, score, void
        start, equal = _runs(qi), _runs(qi, order_by)
        last = np.minimum(start + self.k - 1, len(qi) - 1)
        limit = np.where(qi[last] == qi, order_by[last] - self.tie, -np.inf)
        keep = (order_by >= limit) & (np.arange(len(qi)) - equal < self.k)
        return qi[keep], bi[keep], score[keep], void[keep]
