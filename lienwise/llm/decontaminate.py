"""Benchmark decontamination by SimHash of item-sized windows.

Every item-sized window of every document gets a 64-bit SimHash of its
``k``-word shingles: counters of all bits run along the text in packed lanes,
so a window is a difference of two places. A multi-index over the items'
fingerprints (four blocks of sixteen bits, each entered under every value within
a quarter of the radius) yields every item within the Hamming radius of a
window; of random windows it lets through one in 25 for each item of that
length, and the whole distance one in 100,000. For what is left the weighted
Jaccard similarity of the shingle multisets decides exactly, over all windows
of the item's length around the place.

Lengths share windows: from 16 words on, windows start at every second word,
from 32 on at every fourth and so on, and an item is entered with as many
starts, so that one of them lines up with a window. There are eight window
lengths to an octave, so the work a word is bounded whatever lengths a benchmark
has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import by_id, written

BLOCKS = 4
#: Windows that are looked up at a time.
WINDOWS = 1 << 16
#: Text bytes of a benchmark that one broadcast index serves; longer benchmarks are taken in parts of that size.
PART_BYTES = 1 << 19

_POP = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)
_TOP = np.uint64(0x8080808080808080)
_ONES = np.uint64(0x0101010101010101)
_GATHER = np.uint64(0x0102040810204080)


@dataclass
class WindowClass:
    """Windows of ``length`` words at every ``step``-th start, and the multi-index
    of the items that they may match: item, start inside it, fingerprint."""

    length: int
    step: int
    width: int
    item: np.ndarray
    shift: np.ndarray
    fps: np.ndarray
    first: list[np.ndarray] = field(default_factory=list)
    owner: list[np.ndarray] = field(default_factory=list)


@dataclass
class Items:
    ids: list
    lengths: np.ndarray
    widths: np.ndarray
    shingles: list[tuple[np.ndarray, np.ndarray]]
    classes: list[WindowClass]
    radius: int


def window_shape(length: int) -> tuple[int, int]:
    """(window length, step) for items of so many words."""
    step = 1 << max(0, length.bit_length() - 4)
    return (length - step + 1) // step * step, step


def running_lanes(h: np.ndarray) -> np.ndarray:
    """Running sums of the bits of hashes, (n + 1) x 8 words of eight lanes of
    eight bits. Sums wrap, differences over up to 255 hashes are exact."""
    out = np.zeros((len(h) + 1, 8), np.uint64)
    raw = np.ascontiguousarray(h).view(np.uint8)
    for a in range(0, len(h), 1 << 14):
        part = out[a + 1 : a + 1 + (1 << 14)]
        np.cumsum(W._LANES.take(raw[8 * a : 8 * (a + (1 << 14))]).reshape(-1, 8), axis=0, out=part)
        part += out[a]
    return out


def window_fingerprints(lanes: np.ndarray, low: int, high: int, step: int, span: int) -> np.ndarray:
    """SimHashes of the ``span`` hashes from every ``step``-th start from
    ``low`` to before ``high``: a bit is set if it is in over half of them."""
    if span > 255:
        total = np.zeros((len(range(low, high, step)), 64), np.int32)
        for a in range(0, span, 255):
            part = lanes[low + min(a + 255, span) : high + min(a + 255, span) : step] - lanes[low + a : high + a : step]
            total += part.view(np.uint8).astype(np.int32)
        return np.packbits(2 * total > span, axis=1, bitorder="little").view(np.uint64)[:, 0]
    count = lanes[low + span : high + span : step] - lanes[low:high:step]
    count += _ONES * np.uint64(127 - span // 2)
    count &= _TOP
    count >>= np.uint64(7)
    count *= _GATHER
    count >>= np.uint64(56)
    return count.astype(np.uint8).view(np.uint64)[:, 0]


def _fingerprint(h: np.ndarray) -> int:
    return int(window_fingerprints(running_lanes(h), 0, 1, 1, len(h))[0])


_NEAR: dict[int, np.ndarray] = {}


def _index(shape: WindowClass, radius: int) -> WindowClass:
    share = radius // BLOCKS
    if share not in _NEAR:
        _NEAR[share] = np.flatnonzero(_POP <= share)
    for block in range(BLOCKS):
        value = ((shape.fps >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
        entered = (value[:, None] ^ _NEAR[share]).ravel()
        order = np.argsort(entered, kind="stable")
        end = np.cumsum(np.bincount(entered, minlength=1 << 16))
        owner = np.concatenate([[-1], order // len(_NEAR[share])]).astype(np.int32)  # place 0: no entry
        owner[end[np.diff(end, prepend=0) > 0]] ^= -1
        shape.owner.append(owner)
        shape.first.append(np.where(np.diff(end, prepend=0) > 0, end - np.diff(end, prepend=0) + 1, 0).astype(np.int32))
    return shape


def index_items(ids: list, texts: list, k: int, radius: int) -> Items:
    """Items without words match nothing and are left out."""
    words = W.split_words(pa.array(texts, pa.large_string()))
    hashes, rows = words.hashes(), np.flatnonzero(words.counts > 0)
    sets, found = [], {}
    for n, i in enumerate(rows.tolist()):
        own = hashes[words.ptr[i] : words.ptr[i + 1]]
        width = min(k, len(own))
        h, _ = W.shingles(own, np.array([0, len(own)]), width)
        sets.append(np.unique(h, return_counts=True))
        length, step = window_shape(len(own))
        for shift in range(step):
            found.setdefault((length, step, width), []).append((n, shift, _fingerprint(h[shift : shift + length - width + 1])))
    classes = []
    for (length, step, width), entries in sorted(found.items()):
        item, shift, fps = zip(*entries, strict=True)
        classes.append(_index(WindowClass(length, step, width, np.array(item), np.array(shift), np.array(fps, np.uint64)), radius))
    lengths = words.counts[rows]
    return Items([ids[i] for i in rows], lengths, np.minimum(lengths, k), sets, classes, radius)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller over sum of larger multiplicities."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][x], b[1][y]).sum()
    return float(common) / float(a[1].sum() + b[1].sum() - common)


def candidates(lanes: np.ndarray, ptr: np.ndarray, shape: WindowClass, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, word where the item would start) of all windows of a
    class within the radius. ``ptr``: the documents' words."""
    span, out = shape.length - shape.width + 1, [np.zeros((2, 0), np.int64)]
    end = len(lanes) - span
    for a in range(0, end, WINDOWS * shape.step):
        fps = window_fingerprints(lanes, a, min(a + WINDOWS * shape.step, end), shape.step, span)
        value = fps.view(np.uint16).reshape(-1, BLOCKS)
        for block in range(BLOCKS):
            place = shape.first[block].take(value[:, block])
            row = np.flatnonzero(place)
            place = place[row]
            while len(row):  # the entries of a value lie together, the last one marked
                entry = shape.owner[block].take(place)
                last = entry < 0
                entry = np.where(last, ~entry, entry)
                near = np.flatnonzero(np.bitwise_count(fps.take(row) ^ shape.fps.take(entry)) <= radius)
                out.append(np.stack([a + row[near] * shape.step, entry[near]]))
                more = np.flatnonzero(~last)
                row, place = row[more], place[more] + 1
    at, entry = np.concatenate(out, axis=1)
    doc = np.searchsorted(ptr, at, side="right") - 1
    whole = at + shape.length <= ptr[np.minimum(doc + 1, len(ptr) - 1)]  # windows over the end of a text are none
    at, entry, doc = at[whole], entry[whole], doc[whole]
    return doc, shape.item[entry], at - shape.shift[entry]


def best_window(h: np.ndarray, low: int, high: int, item: tuple[np.ndarray, np.ndarray], span: int, threshold: float) -> tuple[float, int] | None:
    """The best (similarity, start) of the windows of ``span`` shingles that
    start from ``low`` to ``high``, if it reaches the threshold; ties: the first."""
    own = h[low : high + span]
    known = np.concatenate([[0], np.cumsum(np.isin(own, item[0]))])
    common = known[span:] - known[:-span]  # not less than the common multiplicity
    best = None
    for start in np.flatnonzero(common >= threshold * (2 * span - common) - 1e-9).tolist():
        if best is not None and common[start] <= best[0] * (2 * span - common[start]):
            continue
        score = weighted_jaccard(np.unique(own[start : start + span], return_counts=True), item)
        if score >= threshold and (best is None or score > best[0]):
            best = (score, low + start)
    return best


def _matches(docs: DataFrame, items: Items, threshold: float, item_type: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)
    kind = pa.array(items.ids).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in W.pieces(batches, "t"):
            words = W.split_words(b.column("t"))
            hashes, ptr = words.hashes(), words.ptr
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for width in sorted({c.width for c in own.classes}):
                # a shingle at every word; those over the end of a text are in no window
                padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
                h, _ = W.shingles(padded, np.array([0, len(padded)]), width)
                lanes = running_lanes(h)
                for shape in own.classes:
                    if shape.width != width:
                        continue
                    doc, item, start = candidates(lanes, ptr, shape, own.radius)
                    if not len(doc):
                        continue
                    order = np.lexsort((start, item, doc))
                    doc, item, start = doc[order], item[order], start[order]
                    # windows that reach the threshold overlap a candidate in most of its words, so an eighth of the length on each side covers them
                    room = own.lengths[item] // 8 + shape.step + 1
                    new = np.ones(len(doc), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > 2 * room[1:])
                    for a, z in zip(np.flatnonzero(new).tolist(), np.append(np.flatnonzero(new)[1:], len(doc)).tolist(), strict=True):
                        d, x = int(doc[a]), int(item[a])
                        low = max(int(start[a] - room[a]), int(ptr[d]))
                        high = min(int(start[z - 1] + room[a]), int(ptr[d + 1] - own.lengths[x]))
                        if low > high:
                            continue
                        hit = best_window(h, low, high, own.shingles[x], int(own.lengths[x]) - width + 1, threshold)
                        if hit and ((d, x) not in best or hit[0] > best[d, x][0]):
                            best[d, x] = (hit[0], hit[1] - int(ptr[d]))
            found = sorted(best.items())
            rows = pa.array([d for (d, _), _ in found], pa.int64())
            yield pa.record_batch([b.column("i").take(rows), pa.array([own.ids[x] for (_, x), _ in found], kind), pa.array([s for _, (s, _) in found], pa.float64()), pa.array([w for _, (_, w) in found], pa.int64())], ["i", "item_id", "similarity", "first_word"])

    return docs.mapInArrow(run, f"i {docs.schema['i'].dataType.simpleString()}, item_id {item_type}, similarity double, first_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, item_id, similarity, first_word)``: per document and item the
    best window with a weighted shingle similarity of ``threshold`` or more
    (ties: the first). Words are lower-cased (A-Z).

    Windows whose SimHash is within ``radius`` bits of the item's are found
    without exception; a similarity of 0.8 means 9.7 differing bits on average
    with a deviation of 2.9, so a radius of 15 loses one in 50 at 0.8 and none
    that can be measured from 0.85 on. Items shorter than ``k`` words are one
    shingle, so they match exactly. Null or empty texts and items match
    nothing; repeated rows give repeated results; extra columns are ignored.
    The benchmark, of items (item_id, text), is broadcast as an index for each
    ``PART_BYTES`` of its text."""
    if not 0.0 < threshold <= 1.0:
        raise ValueError("the threshold lies in (0, 1]")
    if not 0 <= radius < 64:
        raise ValueError("the radius is a number of bits from 0 to 63")
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    parts = int(-(-size // PART_BYTES))
    dealt = written(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(parts, 1)))), "benchmark") if parts > 1 else rows.withColumn("part", F.lit(0))
    out = None
    for part in range(parts):
        own = dealt.where(F.col("part") == part).orderBy("item_id", "text").collect()
        items = index_items([r["item_id"] for r in own], [r["text"] for r in own], k, radius)
        if items.ids:
            found = _matches(texts, items, threshold, item_type)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = texts.sparkSession.createDataFrame([], f"i {texts.schema['i'].dataType.simpleString()}, item_id {item_type}, similarity double, first_word long")
    return out.withColumnRenamed("i", id_col)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Documents, all columns, that hold no benchmark item."""
    bad = written(contaminated(docs, benchmark, id_col=id_col, **options).select(id_col).distinct(), "contaminated")
    return by_id(docs, bad, id_col, "left_anti")
