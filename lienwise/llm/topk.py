"""Exact top-k inner products by columnar branch and bound.

Vectors lie dimension by dimension (vertically). For one query the dimensions
are taken in the order of its own mass, a block at a time, over all candidates
at once. What the dimensions to come can still add is at most the product of
the remaining masses of query and candidate (Cauchy-Schwarz); a candidate whose
bound falls below the query's k-th best so far is dropped and the survivors are
compacted before the next block. The k-th best starts from a first small block
of candidates that is scored whole. All components are integers, so scores are
exact.

Queries are broadcast in parts of at most ``QUERIES`` rows; every task keeps k
rows a query, and a ranking merges the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERIES = 1 << 16
#: Dimensions after which the bound is looked at again: many at first, when it can't prune yet.
FIRST, DIMS = 32, 8
SEED, ROWS = 256, 4096
_LOW = np.iinfo(np.int64).min
LARGEST = float(np.finfo(np.float64).max)
_integers = np.vectorize(int, otypes=[object])


def scaled_vectors(frame: DataFrame, factor: float, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` with v = floor(factor * x) as doubles, which stop at the ends
    of their range; vectors that are null
    or hold a null or non-finite component, and rows without an id, go."""
    rows = frame.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda e: e.cast("double")).alias("x"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))

    def whole(e: Column) -> Column:
        y = e * factor  # from 2 ** 52 on a double has no fraction
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).when(F.abs(y) == float("inf"), F.signum(y) * LARGEST).otherwise(y)

    return rows.where(fine).select("id", F.transform("x", whole).alias("v"))


def columns_of(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as a dims x rows matrix, shorter ones filled up by zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    width = max(int(n.max(initial=0)), width or 0)
    out = np.zeros((width, len(lists)))
    row = np.repeat(np.arange(len(n)), n)
    out[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), row] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Search:
    """The k best candidates so far of some queries. ``work`` counts the
    products that were taken, ``whole`` those of a search without a bound."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.k, self.ids, self.q = k, ids, vectors
        self.order = np.argsort(-np.abs(vectors), axis=0, kind="stable")
        with np.errstate(over="ignore", invalid="ignore"):  # masses beyond a double belong to scores that are taken whole
            self.mass = np.take_along_axis(vectors, self.order, 0) ** 2
            self.left = np.sqrt(np.maximum(self.mass.sum(0) - np.cumsum(self.mass, axis=0), 0))
        self.peak = float(np.abs(vectors).max(initial=0))
        self.best = np.full((len(ids), k), _LOW, np.int64)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        self.work = self.whole = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        dims = self.q.shape[0]
        if vectors.shape[0] < dims:
            vectors = np.vstack([vectors, np.zeros((dims - vectors.shape[0], vectors.shape[1]))])
        vectors = vectors[:dims]  # dimensions beyond every query's add nothing
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[:, order]
        top = dims * self.peak * float(np.abs(vectors).max(initial=0))
        at = 0
        while at < len(ids):
            end = at + (SEED if (self.best[:, -1] == _LOW).any() else ROWS)
            self._rows(ids[at:end], vectors[:, at:end], top)
            at = end

    def _rows(self, ids: np.ndarray, v: np.ndarray, top: float) -> None:
        self.whole += v.size * len(self.ids)
        if top >= 2**53:  # beyond exact floating point
            big = _integers(v) if v.size else v.astype(object)
            for n in range(len(self.ids)):
                score = _integers(self.q[:, n]) @ big if len(big) else np.zeros(len(ids), object)
                self._keep(n, np.clip(score, _LOW + 1, np.iinfo(np.int64).max).astype(np.int64), ids)
            return
        kind = np.float32 if top < 2**24 else np.float64
        v = np.ascontiguousarray(v, kind)
        square = v * v
        total = square.sum(0, dtype=np.float64)
        for n in range(len(self.ids)):
            self._one(n, ids, v, square, total, kind)

    def _one(self, n: int, ids: np.ndarray, v: np.ndarray, square: np.ndarray, total: np.ndarray, kind: type) -> None:
        order, floor, dims = self.order[:, n], self.best[n, -1], len(self.q)
        q = self.q[order, n].astype(kind)
        d = min(FIRST if floor > _LOW else dims, dims)
        score = q[:d] @ v[order[:d]]
        seen = square[order[:d]].sum(0) if d < dims else None
        self.work += d * len(ids)
        at, bound = None, float(floor)
        while d < dims:
            rest = total - seen if at is None else total[at] - seen
            # the margins cover the rounding of masses; scores themselves are exact
            alive = np.flatnonzero(score + self.left[d - 1, n] * np.sqrt(np.maximum(rest, 0) * (1 + 1e-5)) + 1 >= bound)
            at = alive if at is None else at[alive]
            if not len(at):
                return
            new = order[d : d + DIMS]
            score = score[alive] + q[d : d + DIMS] @ v[new[:, None], at]
            d += len(new)
            self.work += len(new) * len(at)
            if d < dims:
                seen = seen[alive] + square[new[:, None], at].sum(0)
        self._keep(n, score.astype(np.int64), ids if at is None else ids[at])

    def _keep(self, n: int, score: np.ndarray, found: np.ndarray) -> None:
        better = (score > self.best[n, -1]) | (score == self.best[n, -1]) & (found < self.who[n, -1])
        better &= found != self.ids[n]
        if not better.any():
            return
        score, found = np.concatenate([self.best[n], score[better]]), np.concatenate([self.who[n], found[better]])
        order = np.lexsort((found, ~score))[: self.k]
        self.best[n], self.who[n] = score[order], found[order]


def top_k(frame: DataFrame, is_query: Column, k: int = 20, factor: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of the highest inner
    product with each query, all rows but those of its own id, ties to the
    smaller id. Components are floor(factor * x).

    Vectors that are null or hold null or non-finite components take no part;
    shorter vectors count as filled up by zeros; queries with fewer candidates
    have them all; scores beyond the range of a long stop at its ends. Query
    rows of one id are one query, that of the least vector. Repeated rows of
    another id are candidates of their own. Extra columns are ignored."""
    vectors = scaled_vectors(frame, factor, id_col, vector_col)
    chosen = scaled_vectors(frame.where(is_query), factor, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")).orderBy("id")
    count, out, after = chosen.count(), None, 0
    while after < count or out is None:
        part = chosen.offset(after).limit(QUERIES).toArrow()
        after += QUERIES
        held = frame.sparkSession.sparkContext.broadcast((part["id"].to_numpy(), columns_of(part["v"])))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, vectors = held.value
            search = Search(ids, vectors, k)
            for b in batches:
                if b.num_rows and len(ids):
                    search.add(b.column("id").to_numpy(), columns_of(b.column("v")))
            i, j = np.nonzero(search.best > _LOW)
            yield pa.record_batch([pa.array(ids[i]), pa.array(search.who[i, j]), pa.array(search.best[i, j])], ["query_id", "vec_id", "score"])

        found = vectors.mapInArrow(run, "query_id long, vec_id long, score long")
        out = found if out is None else out.unionByName(found)
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
