"""Document quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds cut its line into grades: P(grade <= k) = sigmoid(t_k - w.x). The
expected grade ranks documents and the probability of reaching the top grade
selects them.

Features: letter-digit runs (lower-cased), their four-byte pieces, the shapes of
white-space words, and how often a word repeats the one before it; each kind as
log counts of unit length. The fit takes a bounded sample of rated documents;
scoring takes every document whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Rated documents that a fit takes at most, by hash order of their ids.
SAMPLE = 6000
WORD_BITS, PIECE_BITS, SHAPE_BITS = 17, 17, 12
DIMENSIONS = (1 << WORD_BITS) + (1 << PIECE_BITS) + (1 << SHAPE_BITS) + 1
GRADES = 3
#: A feature counts in the fit from so many sampled documents.
LEAST_DOCUMENTS = 3
#: Rows of a block of the fit's sums.
BLOCK = 512

_CORE = np.zeros(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 97


def _slices(data: np.ndarray, solid: np.ndarray, off: np.ndarray) -> W.Words:
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
    before[1:] = ~solid
    after[:n] = ~solid
    starts = np.flatnonzero(solid & (before | edge)[:n])
    ends = np.flatnonzero(solid & (after | edge)[1:]) + 1
    return W.Words(data, starts, ends, np.searchsorted(starts, off), np.diff(off))


def _shapes(data: np.ndarray, off: np.ndarray) -> W.Words:
    """Words with runs of letters of one case, and of digits, cut to one."""
    kind = _CLASS[data]
    same = np.zeros(len(data), bool)
    same[1:] = (kind[1:] == kind[:-1]) & _CORE[data[1:]]
    same[off[off < len(data)]] = False
    at = np.concatenate([[0], np.cumsum(~same)])
    short = kind[~same]
    return _slices(short, ~W._SPACE[short], at[off])


def _pieces(words: W.Words, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every ``width``-byte piece inside a word."""
    many = np.maximum(words.ends - words.starts - width + 1, 0)
    first = np.cumsum(many) - many
    at = np.arange(many.sum()) + np.repeat(words.starts - first, many)
    value = np.zeros(len(at), np.uint64)
    for j in range(width):
        value = (value << np.uint64(8)) | words.data[at + j]
    return np.repeat(words.owner(), many), W.mix(value)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pointers, dimensions and values of each text's features."""
    data, off = W.text_buffer(column)
    rows = len(off) - 1
    words, shapes = _slices(W._LOWER[data], _CORE[data], off), _shapes(data, off)
    hashes, owner = words.hashes(3), words.owner()
    parts, base = [], 0
    for (own, h), bits in (((owner, hashes), WORD_BITS), (_pieces(words), PIECE_BITS), ((shapes.owner(), shapes.hashes(3)), SHAPE_BITS)):
        both = np.sort(own * (1 << bits) + (h >> np.uint64(64 - bits)).astype(np.int64))
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(both)))
        both = both[first]
        doc, value = both >> bits, np.log1p(counts)
        norm = np.sqrt(np.bincount(doc, value**2, minlength=rows))
        parts.append((doc, (both & ((1 << bits) - 1)) + base, value / norm[doc]))
        base += 1 << bits
    again = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=rows)
    doc = np.flatnonzero(again)
    parts.append((doc, np.full(len(doc), base), again[doc] / words.counts[doc]))
    doc, dim, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(doc, kind="stable")
    return np.searchsorted(doc[order], np.arange(rows + 1)), dim[order], value[order].astype(np.float32)


@dataclass
class Ordinal:
    """Weights and ordered thresholds; without thresholds (nothing to learn
    from) every document is of the top grade."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, ptr: np.ndarray, dim: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k below the top, a row per document."""
        if not len(self.thresholds):
            return np.ones((len(ptr) - 1, GRADES - 1))
        z = np.concatenate([[0.0], np.cumsum(self.weights[dim] * value)])
        z = z[ptr[1:]] - z[ptr[:-1]]
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))


def _rows(ptr: np.ndarray, a: int, b: int) -> np.ndarray:
    """The row of each feature of rows ``a`` to ``b``, counted from ``a``."""
    return np.repeat(np.arange(b - a), np.diff(ptr[a : b + 1]))


def fit(ptr: np.ndarray, dim: np.ndarray, value: np.ndarray, grade: np.ndarray, penalty: float = 0.02, rounds: int = 80) -> Ordinal:
    """Penalised maximum likelihood by limited-memory BFGS; the features, which
    are on the driver, are read in blocks of rows, so that sums need little
    memory beside them."""
    if len(np.unique(grade)) < 2:
        return Ordinal(np.zeros(DIMENSIONS), np.zeros(0))
    n = len(grade)
    often = np.bincount(dim, minlength=DIMENSIONS) >= min(LEAST_DOCUMENTS, n)
    used, place, keep = np.flatnonzero(often), np.cumsum(often, dtype=np.int32) - 1, often[dim]
    ptr = np.concatenate([[0], np.cumsum(keep)])[ptr]
    dim, value, size = place[dim[keep]], value[keep].astype(np.float32), len(used)
    cuts = list(zip(range(0, n, BLOCK), [*range(BLOCK, n, BLOCK), n], strict=True))
    share = np.clip([np.mean(grade <= k) for k in range(GRADES - 1)], 1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, gaps = x[:size], np.exp(np.minimum(x[size + 1 :], 30))
        cut = np.concatenate([[-np.inf], x[size] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        z = np.concatenate([np.bincount(_rows(ptr, a, b), w[dim[ptr[a] : ptr[b]]] * value[ptr[a] : ptr[b]], minlength=b - a) for a, b in cuts])
        s = 1 / (1 + np.exp(np.clip(z[:, None] - cut[None, :], -60, 60)))
        s[:, 0], s[:, -1] = 0, 1
        upper, lower = s[np.arange(n), grade + 1], s[np.arange(n), grade]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        g = np.zeros_like(x)
        g[:size] = penalty * w
        for a, b in cuts:
            g[:size] += np.bincount(dim[ptr[a] : ptr[b]], value[ptr[a] : ptr[b]] * (du - dl)[a:b][_rows(ptr, a, b)], minlength=size)
        by_cut = -np.bincount(grade + 1, du, minlength=GRADES + 1) + np.bincount(grade, dl, minlength=GRADES + 1)
        g[size] = by_cut[1:GRADES].sum()
        g[size + 1 :] = gaps * np.cumsum(by_cut[1:GRADES][::-1])[::-1][1:]
        return -np.log(p).sum() + penalty / 2 * float(w @ w), g

    def dot(a: np.ndarray, b: np.ndarray) -> float:  # plain sums: threaded products of short vectors are slower on busy cores
        return float((a * b).sum())

    held: list[tuple[np.ndarray, np.ndarray]] = []
    f, g = loss(x)
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(held):
            a = dot(s, q) / dot(s, y)
            alphas.append(a)
            q -= a * y
        q *= dot(held[-1][0], held[-1][1]) / dot(held[-1][1], held[-1][1]) if held else 1 / max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(held, reversed(alphas), strict=True):
            q += (a - dot(y, q) / dot(s, y)) * s
        slope, rate = dot(g, q), 1.0
        while True:
            new = x - rate * q
            f2, g2 = loss(new)
            if f2 <= f - 1e-4 * rate * slope or rate < 1e-8:
                break
            rate /= 2
        s, y = new - x, g2 - g
        if dot(s, y) > 1e-12:
            held = [*held, (s, y)][-8:]
        done = f - f2 < 1e-5 * max(1.0, abs(f))
        x, f, g = new, f2, g2
        if done:
            break
    weights = np.zeros(DIMENSIONS)
    weights[used] = x[:size]
    return Ordinal(weights, x[size] + np.concatenate([[0], np.cumsum(np.exp(x[size + 1 :]))]))


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from flags: 0 toxic, 1 of low quality, 2 neither. Rows
    with a null id or flag are left out."""
    return labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", F.when(F.col("toxic") != 0, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))


def train(docs: DataFrame, rated: DataFrame, sample: int = SAMPLE, penalty: float = 0.02, text_col: str = "text") -> Ordinal:
    """A model from the rated documents (doc_id, grade 0 to 2), at most
    ``sample`` of them; what reaches the driver is their sparse features."""
    some = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    texts = docs.select("doc_id", F.col(text_col).alias("t")).join(F.broadcast(some), "doc_id").select("doc_id", "t", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "t"):
            ptr, dim, value = features(b.column("t"))
            at = pa.array(ptr, pa.int32())
            yield pa.record_batch([b.column("doc_id"), b.column("grade"), pa.ListArray.from_arrays(at, pa.array(dim, pa.int32())), pa.ListArray.from_arrays(at, pa.array(value))], ["doc_id", "grade", "dim", "value"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    got = texts.mapInArrow(run, f"doc_id {kind}, grade int, dim array<int>, value array<float>").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    if not got.num_rows:
        return Ordinal(np.zeros(DIMENSIONS), np.zeros(0))
    lists = got["dim"].combine_chunks()
    ptr = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return fit(ptr, lists.flatten().to_numpy(), got["value"].combine_chunks().flatten().to_numpy(), got["grade"].to_numpy().astype(np.int64), penalty)


def score(docs: DataFrame, model: Ordinal, text_col: str = "text", names: tuple[str, str] = ("expected_grade", "top_probability")) -> DataFrame:
    """``docs``, all columns, with the expected grade (0 to 2) and the
    probability of the top one under ``names``, which replace columns of these
    names. Null texts count as empty; an empty text has the prior's grade."""
    weights = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*weights.value)
        for b in W.pieces(batches, "_t"):
            tails = own.tails(*features(b.column("_t")))
            yield pa.record_batch([*b.columns[:-1], pa.array(tails.sum(1)), pa.array(tails[:, -1])], [*b.schema.names[:-1], *names])

    held = docs.select(*[c for c in docs.columns if c not in names], F.col(text_col).alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name != "_t")
    return held.mapInArrow(run, f"{schema}, {names[0]} double, {names[1]} double")


def select_good(docs: DataFrame, rated: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The documents, all columns, whose probability of the top grade is
    ``least`` or more. Repeated rows stay repeated."""
    names, model = ("_expected", "_top"), train(docs, rated, **options)
    pa.default_memory_pool().release_unused()  # the sample's features, on the driver
    return score(docs, model, names=names).where(F.col(names[1]) >= least).select(docs.columns)
