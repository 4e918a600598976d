"""Exact removal of repeated passages, found by recompression.

Recompression renames a word sequence in rounds: runs of one symbol become a
symbol, then adjacent pairs whose first symbol falls into the left half of the
alphabet and whose second falls into the right half become one. Names are
64-bit hashes of what they stand for, so all tasks give equal runs and pairs
equal names and a round needs no shuffle. Which symbols arise strictly inside a
word sequence depends on that sequence alone: a round can change only the
outermost symbol at either end. So each ``window``-word window owns an anchor,
the longest of the few highest symbols that its own words settle, and equal
windows have equal anchors.

Spark sorts the anchors by name; only windows whose anchor occurs in two
different texts are compared, by 96-bit hashes of all their words, which are
sorted too: the first row of a group decides, so no group is ever gathered.
Names that a large share of all texts have are not sorted to one task: a short
list of them is found beforehand, their rows pass where they are, and of their
windows each task first takes the smallest id, so a passage that stands in a
third of all texts is a handful of rows in the shuffle. The different windows among
them with their smallest ids are a list that tasks hold, up to a bound, so that
a text passes as one row with all its covered places.
Texts of equal words are one text: of these, all but the smallest id lose every
window at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import BROADCAST_IDS, beside, by_id, written

#: Symbols among which a window chooses its anchor, from the level where no more are left.
FEW = 4
#: A name is frequent if it makes up one in so many of all rows.
FREQUENT = 1 << 11
_LEFT, _RIGHT, _RUN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def anchors(names: np.ndarray, ptr: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and anchor of every window of the texts ``ptr``."""
    owner = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    at = np.arange(len(names))
    starts = at[at + window <= np.repeat(ptr[1:], np.diff(ptr))]
    out, reach, size = names[starts], np.ones(len(starts), np.int64), np.ones(len(names), np.int64)
    live, lo, hi = np.arange(len(starts)), starts, starts + window
    level = 0
    while len(live):
        level += 1
        salt = np.uint64(level) * _RUN
        # runs of one symbol; the outermost runs of a window may go on outside it
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(names)))
        run = np.cumsum(new) - 1
        names = np.where(length == 1, names[first], W.mix(names[first] + length.astype(np.uint64) * _RUN))
        owner, size = owner[first], np.add.reduceat(size, first)
        # pairs of a left and a right symbol; an outer right (left) symbol may pair outside
        right = (W.mix(names ^ salt) >> np.uint64(17)) & np.uint64(1) == 1
        pair = np.zeros(len(names), bool)
        pair[:-1] = ~right[:-1] & right[1:] & (owner[:-1] == owner[1:])
        keep = np.ones(len(names), bool)
        keep[1:] = ~pair[:-1]
        symbol = np.cumsum(keep) - 1
        # where a window that starts (ends) with a symbol starts (ends) in the new names: one map for each, looked up by all windows
        n = np.arange(len(names))
        start = np.append(symbol, symbol[-1] + 1)[np.append(n + right, len(names))][run + 1]
        end = np.concatenate([[0], symbol + 1])[n - np.concatenate([[False], ~right[:-1]])][run]
        after = np.append(names[1:], np.uint64(0))
        names, owner = np.where(pair, W.mix(names * _LEFT + after * _RIGHT), names)[keep], owner[keep]
        size = np.add.reduceat(size, np.flatnonzero(keep))
        lo, hi = start[lo], end[hi - 1]
        ok = lo < hi
        if not ok.all():
            live, lo, hi = live[ok], lo[ok], hi[ok]
        few = hi - lo <= FEW
        who, a, z = live[few], lo[few], hi[few]
        for _ in range(FEW):
            inside = a < z
            who, a, z = who[inside], a[inside], z[inside]
            name, words = names[a], size[a]
            better = (words > reach[who]) | (words == reach[who]) & (name < out[who])
            out[who[better]], reach[who[better]] = name[better], words[better]
            a = a + 1
    return starts, out


def _window_hash(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    base = 0x5851F42D4C957F2D
    step = np.full(len(words) + 1, np.uint64(base))
    step[0] = 1
    up = np.cumprod(step)
    step[1:] = np.uint64(pow(base, -1, 2**64))
    down = np.cumprod(step)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
    return W.mix((total[starts + window] - total[starts]) * down[starts])


def _key(words: list[bytes]) -> tuple[str, int]:
    digest = hashlib.sha256(b" ".join(words))
    return digest.hexdigest(), int.from_bytes(digest.digest()[:8], "little", signed=True)


def _sketch(docs: DataFrame, window: int) -> DataFrame:
    """(i, n_words, sha, key, anchors): sha and key of the words as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "t"):
            column = b.column("t")
            words = W.split_words(column, lower=False)
            starts, names = anchors(words.hashes(), words.ptr, window)
            new = np.ones(len(starts), bool)
            doc = np.searchsorted(words.ptr, starts, side="right") - 1
            new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
            names, doc = names[new], doc[new]
            keys = [_key((x or "").encode("utf-8", "surrogatepass").split()) for x in column.to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)), pa.int32()), pa.array(names.view(np.int64)))
            yield pa.record_batch([b.column("i"), pa.array(words.counts), pa.array([x for x, _ in keys]), pa.array([x for _, x in keys], pa.int64()), lists], ["i", "n_words", "sha", "key", "anchors"])

    return docs.mapInArrow(run, "i long, n_words long, sha string, key long, anchors array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    """(i, t, names) with the key of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "t"):
            keys = [_key((x or "").encode("utf-8", "surrogatepass").split())[1] for x in b.column("t").to_pylist()]
            yield b.append_column("key", pa.array(keys, pa.int64()))

    return docs.select("i", "t", "names").mapInArrow(run, "i long, t string, names array<long>, key long")


def _found(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of batches (i, t, key, names) with their windows whose anchor is
    among ``names``: 96 bits of hashes (a, b), row and tag, which holds the place
    in the low 32 bits and bits of the text's key above."""
    for b in W.pieces(batches, "t"):
        words = W.split_words(b.column("t"), lower=False)
        first = words.hashes(1)
        starts, names = anchors(first, words.ptr, window)
        doc = np.searchsorted(words.ptr, starts, side="right") - 1
        wanted = b.column("names")
        n = wanted.value_lengths().to_numpy(zero_copy_only=False)
        mine = W.mix(wanted.flatten().to_numpy().view(np.uint64) + np.repeat(np.arange(len(n)), n).astype(np.uint64) * _LEFT)
        hit = np.isin(W.mix(names + doc.astype(np.uint64) * _LEFT), mine)
        starts, doc = starts[hit], doc[hit]
        tag = (starts - words.ptr[doc]) | (b.column("key").to_numpy()[doc] & 0x7FFFFFFF) << 32
        x, y = (_window_hash(h, starts, window).view(np.int64) for h in (first, words.hashes(2)))
        yield b, x, (y >> 32).astype(np.int32), doc, tag


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(a, b, i, tag) of the windows whose anchor is among ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x, y, doc, tag in _found(batches, window):
            yield pa.record_batch([pa.array(x), pa.array(y), b.column("i").take(pa.array(doc)), pa.array(tag)], ["a", "b", "i", "tag"])

    return docs.select("i", "t", "key", "names").mapInArrow(run, "a long, b int, i long, tag long")


def _covered(b: pa.RecordBatch, x: np.ndarray, y: np.ndarray, doc: np.ndarray, tag: np.ndarray, a: np.ndarray, z: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    """A row (i, bits, tags) for each text with windows (x, y) of which the
    sorted list (a, z) knows a smaller id."""
    last = len(a) - 1
    at = np.searchsorted(a, x)
    same = (at <= last) & (a[np.minimum(at, last)] == x)
    while len(go := np.flatnonzero(same & (z[np.minimum(at, last)] != y))):  # the first hash agrees alone
        at[go] += 1
        same[go] = (at[go] <= last) & (a[np.minimum(at[go], last)] == x[go])
    i = b.column("i").to_numpy()
    same[same] = low[at[same]] < i[doc[same]]
    doc, tag = doc[same], tag[same]
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    tags = pa.ListArray.from_arrays(pa.array(np.append(new, len(tag)), pa.int32()), pa.array(tag))
    return pa.record_batch([pa.array(i[doc[new]]), pa.array(tag[new] >> 32), tags], ["i", "bits", "tags"])


def _later(docs: DataFrame, window: int, first: DataFrame) -> DataFrame:
    """(i, bits, tags), a row for each text that has any: its windows that are
    in ``first`` (a, b, low; a list short enough to be held) with a smaller id."""
    held = first.toArrow()
    x, y, low = (held[c].to_numpy() for c in ("a", "b", "low"))
    order = np.lexsort((y, x))
    shared = first.sparkSession.sparkContext.broadcast((x[order], y[order], low[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _found(batches, window):
            yield _covered(*found, *shared.value)

    return docs.select("i", "t", "key", "names").mapInArrow(run, "i long, bits long, tags array<long>")


def _frequent(once: DataFrame) -> list[int]:
    """The names that make up one in ``FREQUENT`` or more of all rows (i, name)
    and belong to two ids or more; at most twice ``FREQUENT``.

    A name of such a share has at least half of it in some batch, so batches
    report only what is frequent in them, and a short list reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            rows += b.num_rows
            name, i = b.column("name").to_numpy(), b.column("i").to_numpy()
            order = np.argsort(name, kind="stable")
            name, i = name[order], i[order]
            first = np.flatnonzero(_starts([name], None))
            n = np.diff(np.append(first, len(name)))
            often = n >= max(2, len(name) / (2 * FREQUENT))
            yield pa.record_batch([pa.array(name[first][often]), pa.array(n[often]), pa.array(np.minimum.reduceat(i, first)[often]), pa.array(np.maximum.reduceat(i, first)[often])], ["name", "n", "low", "high"])
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([rows]), pa.array([0]), pa.array([0])], ["name", "n", "low", "high"])

    found = written(once.select("name", "i").mapInArrow(run, "name long, n long, low long, high long"), "frequent")
    rows = found.where("name is null").agg(F.sum("n")).first()[0] or 0
    sums = found.where("name is not null").groupBy("name").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return sorted(r["name"] for r in sums.where((F.col("n") >= max(2, rows / (2 * FREQUENT))) & (F.col("low") < F.col("high"))).select("name").collect())


def _starts(columns: list[np.ndarray], last: tuple | None) -> np.ndarray:
    """Where a new group of equal values starts, ``last`` being the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    new[0] = last is None or any(c[0] != x for c, x in zip(columns, last, strict=True))
    return new


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order (name, i), the distinct ones of names with two
    ids or more; what is carried from batch to batch is one row."""
    group: tuple | None = None  # name, first id, whether that is out, last id
    for b in batches:
        if not b.num_rows:
            continue
        name, own = b.column("name").to_numpy(), b.column("i").to_numpy()
        new = _starts([name], group and group[:1])
        at = np.cumsum(new)  # 0: the group that came before
        first = np.concatenate([[group[1] if group else 0], own[new]])
        differ = own != first[at]
        fresh = np.ones(len(own), bool)
        fresh[1:] = (own[1:] != own[:-1]) | new[1:]
        fresh[0] = new[0] or own[0] != group[3]
        many = np.bincount(at[differ], minlength=len(first)) > 0
        owed = many.copy()
        owed[0] &= group is not None and not group[2]
        names = np.concatenate([[group[0] if group else 0], name[new]])
        out = differ & fresh
        yield pa.record_batch([pa.array(np.concatenate([first[owed], own[out]])), pa.array(np.concatenate([names[owed], name[out]]))], ["i", "name"])
        here = at[-1]
        group = (name[-1], first[here], bool(many[here] or (here == 0 and group is not None and group[2])), own[-1])


def _after_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order (a, b, i), those of a larger i than the first of
    their (a, b)."""
    last, lowest = None, None
    for b in batches:
        if not b.num_rows:
            continue
        pair, i = [b.column(c).to_numpy() for c in ("a", "b")], b.column("i").to_numpy(zero_copy_only=False)
        new = _starts(pair, last)
        first = np.concatenate([i[:1] if lowest is None else np.array([lowest], i.dtype), i[new]])[np.cumsum(new)]
        last, lowest = (pair[0][-1], pair[1][-1]), first[-1]
        yield b.filter(pa.array(np.asarray(i > first, bool))).select(["i", "tag"])


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """Texts and the places of their covered windows to what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "t"):
            removed, sha, kept = [], [], []
            for text, tags in zip(b.column("t").to_pylist(), b.column("tags"), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                at = tags.values.to_numpy() & 0xFFFFFFFF
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                keep = np.cumsum(cover)[:-1] == 0
                rest = b" ".join(compress(words, keep.tolist()))
                removed.append(len(words) - int(keep.sum()))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.record_batch([b.column("i"), b.column("key"), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept, pa.binary()).cast(pa.string())], ["i", "key", "n_removed", "kept_sha256", "kept"])

    return docs.select("i", "t", "key", "tags").mapInArrow(run, "i long, key long, n_removed long, kept_sha256 string, kept string")


def repeated_passages(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Words covered by a window that also starts in a document of a smaller id.

    Returns two frames. The first has a row per input row: ``(id_col, n_words,
    n_removed, kept_sha256, key, sha)``. The second has ``(id_col, key, kept)``, the
    kept words joined by one space, for rows that lose some but not all words;
    the others keep their text or nothing. ``key`` tells rows of equal id apart.

    Ids are integers. Null texts are empty. A row without an id is never a smaller document and
    loses nothing. Repeated rows (equal id) do not cover each other. An empty
    table gives empty frames; extra columns are ignored."""
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    sketch = written(_sketch(texts, window), "sketch")
    long = sketch.where((F.col("n_words") >= window) & F.col("i").isNotNull())
    lows = written(long.groupBy("sha").agg(F.min("i").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "low"), "texts")
    copies = written(long.select("i", "sha").join(lows, "sha").where("i > low").select("i", "sha").distinct(), "copies")

    once = long.join(beside(copies), ["i", "sha"], "left_anti").select("i", F.explode("anchors").alias("name"))
    frequent = _frequent(once)
    often = F.array(*[F.lit(x) for x in frequent]).cast("array<long>")
    rare = once.where(~F.col("name").isin(frequent)) if frequent else once
    hits = rare.repartition("name").sortWithinPartitions("name", "i").mapInArrow(_shared, "i long, name long")
    if frequent:
        hits = hits.unionByName(once.where(F.col("name").isin(frequent)))
    wanted = written(hits.groupBy("i").agg(F.collect_set("name").alias("names")), "wanted")
    chosen = written(_keyed(by_id(texts, wanted, "i", "left_semi").join(wanted, "i")), "chosen")
    found = _windows(chosen.withColumn("names", F.array_except("names", often)).where(F.size("names") > 0) if frequent else chosen, window)
    covered = found.repartition("a", "b").sortWithinPartitions("a", "b", "i").mapInArrow(_after_first, "i long, tag long")
    whole = None
    if frequent:
        common = chosen.withColumn("names", F.array_intersect("names", often)).where(F.size("names") > 0)
        lowest = _windows(common, window).groupBy("a", "b").agg(F.min("i").alias("low"), F.max("i").alias("high"))
        first = written(lowest.where("low < high").select("a", "b", "low"), "first")
        if 0 < first.count() <= BROADCAST_IDS:
            whole = _later(common, window, first)
        else:  # a row a window, each met by one row of its smallest id
            covered = covered.unionByName(_windows(common, window).join(first, ["a", "b"]).where("i > low").select("i", "tag"))
    lists = covered.groupBy("i", F.shiftright("tag", 32).alias("bits")).agg(F.collect_list("tag").alias("tags"))
    if whole is not None:
        lists = lists.unionByName(whole).groupBy("i", "bits").agg(F.flatten(F.collect_list("tags")).alias("tags"))
    places = written(lists, "places")
    losing = by_id(chosen, places, "i", "left_semi").withColumn("bits", F.col("key").bitwiseAND(F.lit(0x7FFFFFFF)))
    cut = written(_cut(losing.join(places, ["i", "bits"]), window), "cut").distinct()

    rows = sketch.drop("anchors").join(lows, "sha", "left").join(cut.drop("kept"), ["i", "key"], "left")
    copy = F.coalesce(F.col("i") > F.col("low"), F.lit(False))
    out = rows.select(
        F.col("i").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        "key",
        "sha",
    )
    return out, cut.select(F.col("i").alias(id_col), "key", "kept")


def without_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with the covered words gone: a text that loses
    words becomes its kept words joined by one space, any other stays as it is.
    No row goes."""
    rows, kept = repeated_passages(docs, window, id_col, text_col)
    changed = rows.where("n_removed > 0").join(kept, [id_col, "key"], "left").select(id_col, F.col("sha").alias("_sha"), F.coalesce("kept", F.lit("")).alias("_kept")).distinct()
    changed = written(changed, "changed")
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    touched = by_id(docs, changed, id_col, "left_semi").withColumn("_sha", F.sha2(F.array_join(words, " "), 256))
    touched = touched.join(changed, [id_col, "_sha"], "left").withColumn(text_col, F.coalesce("_kept", text_col)).select(docs.columns)
    return by_id(docs, changed, id_col, "left_anti").unionByName(touched)
