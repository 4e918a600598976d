"""Compact n-gram levels: monotone sequences in Elias-Fano form, memory-mapped.

A three-level trie holds words, below each its predecessors, and below each of
those the words before. Both the keys and the pointers from level to level are
monotone, so each takes about two bits above the logarithm of its mean gap. Keys
are made monotone by counting them from the place above (context-relative), and
found by a successor search: the high bits lead to a bucket of one or two
entries. Log probabilities are quantised to 16 bits.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

STEP, ZERO = 1024, 32  # codes of log10 values: 1/1024 apart, from -32 on


def quantised(values: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((values + ZERO) * STEP), 0, 65535).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / STEP - ZERO


def mapped(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays as read-only views of one memory-mapped file, which has no
    name any more and goes with the views."""
    with tempfile.TemporaryFile() as f:
        places = {}
        for name, a in arrays.items():
            f.write(b"\0" * (-f.tell() % 8))
            places[name] = (f.tell(), a.dtype, a.shape)
            f.write(np.ascontiguousarray(a).tobytes())
        f.write(b"\0" * 8)
        f.flush()
        view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return {name: np.frombuffer(view, kind, int(np.prod(shape)), at) for name, (at, kind, shape) in places.items()}


def encoded(values: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of unsigned values."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    words = np.zeros(((int(high[-1]) if n else 0) >> 6) + 2, np.uint64)
    np.bitwise_or.at(words, high >> 6, np.uint64(1) << (high & 63).astype(np.uint64))
    bits = np.zeros((n * low >> 6) + 2, np.uint64)
    if low:
        rest, at = values & np.uint64((1 << low) - 1), np.arange(n, dtype=np.int64) * low
        shift = (at & 63).astype(np.uint64)
        np.bitwise_or.at(bits, at >> 6, rest << shift)
        over = (at & 63) + low > 64
        np.bitwise_or.at(bits, (at[over] >> 6) + 1, rest[over] >> (np.uint64(64) - shift[over]))
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
    return {f"{prefix}.shape": np.array([n, low], np.int64), f"{prefix}.high": words, f"{prefix}.low": bits, f"{prefix}.ones": ones}


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the rank-th (from 0) one in each word."""
    place, rank = np.zeros(len(word), np.uint64), rank.copy()
    for width in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count((word >> place) & np.uint64((1 << width) - 1)).astype(np.int64)
        go = rank >= count
        rank -= np.where(go, count, 0)
        place += np.where(go, np.uint64(width), np.uint64(0))
    return place.astype(np.int64)


class EliasFano:
    """Look-ups in an encoded sequence."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str) -> None:
        self.n, self.bits = (int(x) for x in arrays[f"{prefix}.shape"])
        self.high, self.rest, self.ones = (arrays[f"{prefix}.{x}"] for x in ("high", "low", "ones"))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.rest[word] >> shift
        over = shift > 0
        value = value | np.where(over, self.rest[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return value & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.bits)) | self.low_bits(i)

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        """How many values have fewer high bits: where that bucket starts."""
        j = high - 1
        word = np.minimum(np.searchsorted(self.zeros, j, side="right") - 1, len(self.high) - 1)
        place = word * 64 + _select(~self.high[word], j - self.zeros[word])
        return np.where(high > 0, place + 1 - high, 0)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Where each value stands, or -1: successor search in its bucket."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        ask = np.flatnonzero(high < int(self.zeros[-1]))
        start, end = self._bucket(high[ask]), self._bucket(high[ask] + 1)
        want = values[ask] & np.uint64((1 << self.bits) - 1)
        while len(ask):
            more = start < end
            ask, start, end, want = ask[more], start[more], end[more], want[more]
            if not len(ask):
                break
            middle = (start + end) >> 1
            got = self.low_bits(middle)
            same = got == want
            out[ask[same]] = middle[same]
            start = np.where(got < want, middle + 1, start)
            end = np.where(got < want, end, middle)
            ask, start, end, want = ask[~same], start[~same], end[~same], want[~same]
        return out


class TrigramTrie:
    """Words, below each its predecessors, below each of those the words before,
    with quantised log10 values.

    ``words``: sorted keys; ``pairs``: sorted, word place * 2**32 + predecessor;
    ``triples``: sorted, pair place * 2**32 + the word before. Words and pairs
    have a value each and a value as contexts of the next word, triples a value."""

    def __init__(self, words: np.ndarray, of_words: tuple[np.ndarray, np.ndarray], pairs: np.ndarray, of_pairs: tuple[np.ndarray, np.ndarray], triples: np.ndarray, of_triples: np.ndarray) -> None:
        starts = lambda keys, n: np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32)).astype(np.uint64)
        levels = {"words": words, "pairs": pairs, "triples": triples, "pair_starts": starts(pairs, len(words)), "triple_starts": starts(triples, len(pairs))}
        values = {"value1": of_words[0], "context1": of_words[1], "value2": of_pairs[0], "context2": of_pairs[1], "value3": of_triples}
        arrays = mapped({k: v for name, keys in levels.items() for k, v in encoded(keys, name).items()} | {k: quantised(v) for k, v in values.items()})
        self.level = {name: EliasFano(arrays, name) for name in levels}
        self.values = {k: arrays[k] for k in values}

    def place(self, words: np.ndarray) -> np.ndarray:
        return self.level["words"].find(words)

    def _below(self, level: str, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Where each key stands below its place (-1: nowhere)."""
        out, start = np.full(len(places), -1, np.int64), self.level[level[:-1] + "_starts"]
        some = np.flatnonzero(places >= 0)
        some = some[start.get(places[some] + 1) > start.get(places[some])]
        out[some] = self.level[level].find((places[some].astype(np.uint64) << np.uint64(32)) | keys[some].astype(np.uint64))
        return out

    def look_up(self, places: np.ndarray, before: np.ndarray, second: np.ndarray, unknown: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
        """Values of words at places (-1: unknown) under the two words before,
        and of word and predecessor as a context: each from the longest match."""
        pair = self._below("pairs", places, before)
        triple = self._below("triples", pair, second)
        value, context = np.full(len(places), unknown[0]), np.full(len(places), unknown[1])
        for at, out, name in ((places, value, "value1"), (places, context, "context1"), (pair, value, "value2"), (pair, context, "context2"), (triple, value, "value3")):
            hit = at >= 0
            out[hit] = restored(self.values[name][at[hit]])
        return value, context
