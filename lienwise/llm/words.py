"""Vectorised word tables over Arrow text columns.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``; texts are UTF-8. Null
texts count as empty. Everything works on whole texts; batches are cut by rows
into pieces of bounded size, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHINGLE = np.random.default_rng(20240501).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Polynomial:
    """Prefix sums of a random byte polynomial modulo 2**64, so that the hash
    of any slice is two look-ups."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1, 2**62)) * 8 + 5
        self.base, self.inverse = np.uint64(base % 2**64), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def slices(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            n = len(data) + len(data) // 4 + 1
            step = np.full(n, self.base)
            step[0] = 1
            self.up = np.cumprod(step)
            step[1:] = self.inverse
            self.down = np.cumprod(step)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


_HASHES: dict[int, _Polynomial] = {}


@dataclass
class Words:
    """The words of some texts: ``ptr[i]:ptr[i+1]`` are those of text ``i``,
    which has ``bytes_of[i]`` bytes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray
    bytes_of: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word; equal words have equal hashes anywhere."""
        if seed not in _HASHES:
            _HASHES[seed] = _Polynomial(seed)
        return _HASHES[seed].slices(self.data, self.starts, self.ends)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def split_words(column: pa.Array, lower: bool = True, space: np.ndarray = _SPACE) -> Words:
    """Words of each row; ``lower`` maps A-Z to a-z. ``space``: which bytes
    stand between words."""
    data, off = text_buffer(column)
    if lower:
        data = _LOWER[data]
    solid = ~space[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.ones(n + 1, bool)
    before[1:] = ~solid
    before |= edge
    after = np.ones(n + 1, bool)
    after[:n] = ~solid
    after |= edge
    starts = np.flatnonzero(solid & before[:n])
    ends = np.flatnonzero(solid & after[1:]) + 1
    return Words(data, starts, ends, np.searchsorted(starts, off), np.diff(off))


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of the batches with about ``limit`` bytes of text at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def shingles(words: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of each text and their pointers; a text
    of fewer words (but one at least) has its whole sequence as the only one."""
    counts = np.diff(ptr)
    if len(words) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(ptr), np.int64)
    ends = np.repeat(ptr[1:], counts)
    at = np.arange(len(words))
    many = np.maximum(counts - k + 1, (counts > 0).astype(np.int64))
    keep = at < np.repeat(ptr[:-1] + many, counts)
    at, ends = at[keep], ends[keep]
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = at + j < ends
        total += np.where(inside, padded[at + j] * _SHINGLE[j], np.uint64(0))
    return mix(total), np.concatenate([[0], np.cumsum(many)])


_LANES = np.zeros(256, np.uint64)
for _j in range(8):
    _LANES |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_j)) & np.uint64(1)) << np.uint64(8 * _j)


def majority(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Of each text's hashes (rows of one or more 64-bit words), the bits set
    in over half of them; zero for a text without hashes.

    Eight bit counters share one 64-bit lane word, so blocks hold 255 rows."""
    h = h.reshape(len(h), 1) if h.ndim == 1 else h
    width, counts = h.shape[1], np.diff(ptr)
    out = np.zeros((len(counts), width), np.uint64)
    if not len(h):
        return out
    has = np.flatnonzero(counts)
    blocks = -(-counts[has] // 255)
    first = np.concatenate([[0], np.cumsum(blocks)])
    start = np.repeat(ptr[:-1][has] - 255 * first[:-1], blocks) + 255 * np.arange(first[-1])
    sums = np.empty((first[-1], 8 * width), np.uint64)
    raw = np.ascontiguousarray(h).view(np.uint8)
    for c in range(8 * width):
        sums[:, c] = np.add.reduceat(_LANES[raw[:, c]], start)
    bits = np.add.reduceat(sums.view(np.uint8).astype(np.int32), first[:-1], axis=0)
    out[has] = np.packbits(2 * bits > counts[has][:, None], axis=1, bitorder="little").view(np.uint64)
    return out
