"""SimHash near-duplicates: binary-trie self-join of 64-bit fingerprints.

The trie is cut for Spark by pigeonhole: fingerprints within ``budget``
differing bits agree on one of ``budget + 1`` bit groups, so each fingerprint
goes to the sub-tries of its groups' values. A sub-trie with too many
fingerprints is cut again over the bits that are still open, until it is small
or no bits are left to cut. Inside a sub-trie, pairs of nodes are walked
together, level by level, in bounded frontiers; a pair is dropped as soon as
its differing bits exceed the budget. A task keeps a spanning forest of the
links it finds, so dense groups never write all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import _roots, components
from .storage import beside, by_id, written

HOT = 1024
#: A fingerprint is common if more than one in so many rows has it.
COMMON = 1 << 12
#: Two nodes with so few pairs of fingerprints are leaves: their pairs are compared at once.
LEAF = 1024
SKETCH = tuple(f"s{n}" for n in range(4))
#: Sets below so many shingles differ in up to 0.19 of the bits, not 0.16, at a similarity of 0.8.
FEW = 10
#: Sets of similarity 0.8 agree in one of so many bands of so many minima but once in 2800.
BANDS, BAND_ROWS = 20, 5
FRONTIER = 1 << 18


def contract_fingerprint(text: str | None, k: int = 3, seed: int = 42) -> tuple[np.ndarray, int]:
    """XXH64 of each ``k``-word shingle of a lower-cased (A-Z) text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64), 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, seed)], np.uint64), 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - k + 1
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n), n


def xxh64_fingerprints(docs: DataFrame, k: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp)``: bit set if set in over half of the shingles' XXH64,
    repeats counted; no words (or a null text): zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "t"):
            parts = [contract_fingerprint(x, k, seed) for x in b.column("t").to_pylist()]
            ptr = np.concatenate([[0], np.cumsum([n for _, n in parts])])
            fp = W.majority(np.concatenate([h for h, _ in parts]), ptr)[:, 0]
            yield pa.record_batch([b.column("i"), pa.array(fp.view(np.int64))], ["i", "fp"])

    frame = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return frame.mapInArrow(run, f"i {frame.schema['i'].dataType.simpleString()}, fp long").withColumnRenamed("i", id_col)


def _blocks(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(first start, pairs, second width, second start) of the pairs of ranges,
    in blocks of a bounded number of pairs; a large pair is cut over several."""
    width = bhi - blo
    step = np.maximum(1, 4 * FRONTIER // width)
    times = -(-(ahi - alo) // step)
    of = np.repeat(np.arange(len(alo)), times)
    lo = alo[of] + (np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)) * step[of]
    size = (np.minimum(lo + step[of], ahi[of]) - lo) * width[of]
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // (4 * FRONTIER))) + 1
    for part in np.split(np.arange(len(of)), cuts):
        yield lo[part], size[part], width[of[part]], blo[of[part]]


def trie_links(fp: np.ndarray, bucket: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``fp`` (unsigned, sorted in each bucket; buckets are
    contiguous) at ``budget`` or fewer differing bits, bucket by bucket."""
    n = len(fp)
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    lo, hi = edge[:-1], edge[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    ones: dict[int, np.ndarray] = {}
    #: node pairs (first range, second range, differing bits so far) before the given bit
    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int8))] if len(lo) else []
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            for part in (slice(0, len(alo) // 2), slice(len(alo) // 2, None)):
                stack.append((bit, alo[part], ahi[part], blo[part], bhi[part], err[part]))
            continue
        sizes = (ahi - alo) * (bhi - blo)
        small = (sizes <= LEAF) if bit >= 0 else np.ones(len(sizes), bool)
        if small.any():
            for clo, size, width, dlo in _blocks(alo[small], ahi[small], blo[small], bhi[small]):
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                wide = np.repeat(width, size)
                i, j = np.repeat(clo, size) + at // wide, np.repeat(dlo, size) + at % wide
                keep = i < j
                i, j = i[keep], j[keep]
                near = np.bitwise_count(fp[i] ^ fp[j]) <= budget
                if near.any():
                    yield i[near], j[near]
        rest = ~small
        if bit < 0 or not rest.any():
            continue
        alo, ahi, blo, bhi, err = alo[rest], ahi[rest], blo[rest], bhi[rest], err[rest]
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
        one = ones[bit]
        amid, bmid = ahi - (one[ahi] - one[alo]), bhi - (one[bhi] - one[blo])
        for x, y, u, v, step, own in ((alo, amid, blo, bmid, 0, True), (amid, ahi, bmid, bhi, 0, True), (alo, amid, bmid, bhi, 1, True), (amid, ahi, blo, bmid, 1, False)):
            e = err + np.int8(step)
            keep = (x < y) & (u < v) & (e <= budget)
            if not own:  # a node with itself has one mixed pair of children
                keep &= alo != blo
            if step == 0:
                keep &= ~((x == u) & (y - x == 1))
            if keep.any():
                stack.append((bit - 1, x[keep], y[keep], u[keep], v[keep], e[keep]))


def _sorted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows for ``trie_links``, their fingerprints and buckets."""
    columns = {c: rows[c].to_numpy() for c in ("table", "mask", "part")}
    fp = rows["fp"].to_numpy().view(np.uint64)
    order = np.lexsort((fp, columns["part"], columns["mask"], columns["table"]))
    key = np.stack([columns[c][order] for c in ("table", "mask", "part")])
    bucket = np.cumsum(np.concatenate([[False], (key[:, 1:] != key[:, :-1]).any(0)])) if len(fp) else np.zeros(0, np.int64)
    return order, fp[order], bucket


def _forest(rows: pa.Table, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and roots of the links among the rows of some sub-tries."""
    order, fp, bucket = _sorted(rows)
    unique, own = np.unique(rows["node"].to_numpy()[order], return_inverse=True)
    label, waiting, held = np.arange(len(unique)), [], 0
    for i, j in trie_links(fp, bucket, budget):
        waiting.append((own[i], own[j]))
        held += len(i)
        if held > 4 * FRONTIER:
            label, waiting, held = _joined(label, waiting), [], 0
    label = _joined(label, waiting)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return unique[linked], unique[label[linked]]


def _lightest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The edges of a spanning forest of least weight, by Boruvka's rounds."""
    label, chosen, ids = np.arange(n), [], np.argsort(weight, kind="stable")
    while True:
        la, lb = label[a[ids]], label[b[ids]]
        differ = la != lb
        ids, la, lb = ids[differ], la[differ], lb[differ]
        if not len(ids):
            return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        best = np.full(n, len(ids))
        np.minimum.at(best, la, np.arange(len(ids)))
        np.minimum.at(best, lb, np.arange(len(ids)))
        pick = np.unique(best[best < len(ids)])
        chosen.append(ids[pick])
        label = _joined(label, [(a[ids[pick]], b[ids[pick]])])


def _near_sizes(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9


def _candidates(rows: pa.Table, budget: int, limit: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, nearest sketches first, of the pairs of nodes of some
    sub-tries that are within the budget, have sketches that differ in
    ``limit`` or fewer bits (more for sets of few shingles) and sizes that
    allow the similarity."""
    order, fp, bucket = _sorted(rows)
    unique, own = np.unique(rows["node"].to_numpy()[order], return_inverse=True)
    sketch = [rows[c].to_numpy().view(np.uint64)[order] for c in SKETCH]
    size = rows["size"].to_numpy()[order].astype(np.float64)
    most = np.where(size < FEW, limit + 64 * len(sketch) // 25, limit)
    kept, waiting, held = [np.zeros(0, np.int64)] * 3, [], 0
    for i, j in trie_links(fp, bucket, budget):
        able = (own[i] != own[j]) & _near_sizes(size[i], size[j], similarity)
        i, j = i[able], j[able]
        away = np.zeros(len(i), np.int64)
        for word in sketch:
            away += np.bitwise_count(word[i] ^ word[j])
        near = away <= np.maximum(most[i], most[j])
        waiting.append((own[i[near]], own[j[near]], away[near]))
        held += int(near.sum())
        if held > 4 * FRONTIER:
            kept, waiting, held = _kept(len(unique), kept, waiting), [], 0
    i, j, _ = _kept(len(unique), kept, waiting)
    return unique[np.minimum(i, j)], unique[np.maximum(i, j)]


def _kept(n: int, kept: list, waiting: list) -> list:
    a, b, away = (np.concatenate(x) for x in zip(kept, *waiting, strict=True))
    few = _lightest(n, a, b, away)
    return [a[few], b[few], away[few]]


def _joined(label: np.ndarray, links: list) -> np.ndarray:
    if not links:
        return label
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    n = len(label)
    return _roots(n, np.concatenate([a, np.arange(n)]), np.concatenate([b, label]))


def _groups(mask: int, parts: int) -> list[int]:
    """The bits open under ``mask``, in ``parts`` groups, each added to it."""
    open_bits = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(open_bits) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in open_bits[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def sub_tries(rows: DataFrame, budget: int, hot: int = HOT) -> DataFrame:
    """``rows`` (table, fp and more) with mask and part: each under every
    sub-trie of its table that it may share with a fingerprint within the
    budget. Sub-tries of over ``hot`` rows are cut again, up to three times in
    all."""
    names = rows.columns

    def cut(frame: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
        choice = None
        for old, new in masks.items():
            values = F.array(*[F.lit(_signed(m)) for m in new])
            choice = values if choice is None else F.when(F.col("mask") == F.lit(_signed(old)), values).otherwise(choice)
        return frame.select(*names, F.explode(choice).alias("mask")).withColumn("part", F.col("mask").bitwiseAND(F.col("fp")))

    keys = ["table", "mask", "part"]
    masks = {0: _groups(0, budget + 1)}
    now = cut(rows.withColumn("mask", F.lit(0).cast("long")), masks)
    done = None
    for _ in range(2):
        sizes = now.groupBy(keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
        big = written(sizes, "hot-tries")
        if not big.head(1):
            break
        now = written(now, "tries")
        small = now.join(big, keys, "left_anti")
        done = small if done is None else done.unionByName(small)
        masks = {m: _groups(m, budget + 1) for new in masks.values() for m in new}
        now = cut(now.join(big, keys, "left_semi"), masks).distinct()
    return now if done is None else done.unionByName(now)


def fingerprint_links(rows: DataFrame, budget: int = 3, hot: int = HOT) -> DataFrame:
    """``(a, b)``: links of nodes whose closure joins what chains of
    fingerprints of one table at ``budget`` or fewer differing bits join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            a, b = _forest(pa.Table.from_batches(held), budget)
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    if not 0 <= budget < 64:
        raise ValueError("the budget is a number of bits from 0 to 63")
    return sub_tries(rows, budget, hot).repartition("table", "mask", "part").mapInArrow(run, "a long, b long")


def neardup_components(fingerprints: DataFrame, budget: int = 3, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, fp, component_id)``: the smallest id that links of ``budget``
    or fewer differing bits reach, itself included.

    Equal fingerprints are joined first, so a group of copies is one node.
    Rows without an id are left out; repeated rows stay repeated; an empty table
    gives an empty result."""
    own = written(fingerprints.where(F.col(id_col).isNotNull()).select(id_col, "fp"), "fingerprints")
    nodes = written(own.groupBy("fp").agg(F.min(id_col).alias("low"), F.count(F.lit(1)).alias("n")), "nodes")
    links = written(fingerprint_links(nodes.select(F.lit(0).alias("table"), "fp", F.col("fp").alias("node")), budget), "links")
    roots = written(components(links), "roots")
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("node", "root", "low")
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    moved = linked.join(lows, "root").select(F.col("node").alias("fp"), "component_id")
    named = written(nodes.join(moved, "fp", "left").select("fp", "n", F.coalesce("component_id", "low").alias("component_id")), "named")
    # fingerprints of many rows, a short list, are broadcast, so that their rows need not meet in one task
    rows = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = F.broadcast(named.where(F.col("n") > rows / COMMON).select("fp", F.col("component_id").alias("_many")))
    own = own.join(many, "fp", "left")
    few = own.where("_many is null").drop("_many").join(named.select("fp", "component_id"), "fp")
    return few.select(id_col, "fp", "component_id").unionByName(own.where("_many is not null").select(id_col, "fp", F.col("_many").alias("component_id")))


def near_duplicates(docs: DataFrame, k: int = 3, budget: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every document; see the two parts."""
    return neardup_components(xxh64_fingerprints(docs, k, seed, id_col, text_col), budget, id_col)


def _distinct(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's different hashes and their pointers."""
    owner = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
    return h[first], np.searchsorted(owner[first], np.arange(len(ptr)))


def _set_digest(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's set of hashes; 0 for an empty set."""
    out, has = np.zeros(len(ptr) - 1, np.uint64), np.flatnonzero(np.diff(ptr))
    if len(has):
        out[has] = W.mix(np.add.reduceat(W.mix(h), ptr[:-1][has]) + np.diff(ptr)[has].astype(np.uint64))
    return out


def _bands(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """``BANDS`` hashes of each text, each of ``BAND_ROWS`` minima of its set."""
    out, has = np.zeros((len(ptr) - 1, BANDS), np.uint64), np.flatnonzero(np.diff(ptr))
    if len(has):
        start, odd = ptr[:-1][has], np.random.default_rng(7).integers(0, 2**63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for c in range(BANDS):
            key = np.zeros(len(has), np.uint64)
            for m in odd[c]:
                key = W.mix(key + np.minimum.reduceat(h * m, start))
            out[has, c] = key
    return out


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel().view(np.int64)))


def _salted(h: np.ndarray, n: int) -> np.ndarray:
    return W.mix(h[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sketches(docs: DataFrame, k: int, tables: int) -> DataFrame:
    """(i, node, size, fps, bands, s0 to s3): a hash of the set of ``k``-word shingles, its size,
    ``tables`` fingerprints of the distinct words, bands of minima of the
    shingles, and 256 bits of the distinct shingles, each under hashes of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "t", W.CHUNK_BYTES // 2):
            words = W.split_words(b.column("t"))
            h = words.hashes()
            distinct, ptr = _distinct(h, words.ptr)
            fps = W.majority(_salted(distinct, tables), ptr)
            runs, at = _distinct(*W.shingles(h, words.ptr, k))
            sketch = W.majority(_salted(runs, len(SKETCH)), at)
            yield pa.record_batch([b.column("i"), pa.array(_set_digest(runs, at).view(np.int64)), pa.array(np.diff(at)), _lists(fps), _lists(_bands(runs, at)), *(pa.array(np.ascontiguousarray(sketch[:, c]).view(np.int64)) for c in range(len(SKETCH)))], ["i", "node", "size", "fps", "bands", *SKETCH])

    kind = docs.schema["i"].dataType.simpleString()
    return docs.mapInArrow(run, f"i {kind}, node long, size long, fps array<long>, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH))


def _shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, set): the distinct ``k``-word shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "t", W.CHUNK_BYTES // 2):
            words = W.split_words(b.column("t"))
            runs, at = _distinct(*W.shingles(words.hashes(), words.ptr, k))
            yield pa.record_batch([pa.array(_set_digest(runs, at).view(np.int64)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(runs.view(np.int64)))], ["node", "set"])

    return docs.mapInArrow(run, "node long, set array<long>")


def _sets_of(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The shingle sets of the nodes of ``pairs`` (a, b), written."""
    ends = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
    some = nodes.join(beside(ends), "node", "left_semi").select(F.col("low").alias("i"))
    return written(_shingle_sets(by_id(texts, some, "i", "left_semi"), k), "sets")


def _differences(sets: DataFrame, similarity: float) -> DataFrame:
    """``sets`` (node, root, set) as (node, root, size, diff, n, off): the
    shingles, ``n`` of them, in which a set differs from the consensus of its
    root, which is what more than half of the root's sets hold.

    A pair is alike enough if its sets differ in ``share * (size + size)`` or
    fewer shingles. With ``off = n - share * size`` that is so if the two
    ``off`` are 0 or less in sum; else if the two differences have at least
    half of that sum in common. A consensus has less than twice the shingles of
    its root's average set."""
    share = (1 - similarity) / (1 + similarity)
    whole = sets.groupBy("root").agg(F.count(F.lit(1)).alias("whole"))
    held = sets.select("root", F.explode("set").alias("s")).groupBy("root", "s").agg(F.count(F.lit(1)).alias("held"))
    most = held.where("held > 1").join(whole, "root").where("2 * held > whole").groupBy("root").agg(F.collect_list("s").alias("most"))
    both = sets.join(most, "root", "left").withColumn("most", F.coalesce("most", F.array().cast("array<long>")))
    diff = both.select("node", "root", F.size("set").alias("size"), F.concat(F.array_except("set", "most"), F.array_except("most", "set")).alias("diff"))
    return diff.withColumn("n", F.size("diff")).withColumn("off", F.col("n") - F.lit(share) * F.col("size"))


def _open_pairs(marked: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: pairs of one root and different groups that hold all those
    alike enough. ``marked``: differences with ``group``, whether the node is
    one of the ``star`` around the root's node of least ``off``, ``low`` (that)
    and ``next`` (the least ``off`` outside the star).

    Two differences with ``k`` shingles in common have one in common among the
    first ``n - k + 1`` of each, in any order; rare ones come first. A star is
    in one group, so only the others are matched, with it and with each other."""

    def first(n: str, off: F.Column) -> F.Column:
        return F.col(n) + 1 - F.greatest(F.lit(1), F.ceil(off / 2 - 1e-6))

    each = marked.select("root", "node", F.explode("diff").alias("s"))
    times = each.groupBy("root", "s").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = each.join(times, ["root", "s"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "s"))).alias("shared"))
    # what one node alone has comes first and matches nothing
    placed = marked.drop("diff").join(shared, "node").select("*", F.posexplode("shared").alias("at", "e")).withColumn("at", F.col("at") + 1 + F.col("n") - F.size("shared"))
    ways = F.when(F.col("star"), F.array(F.struct(F.lit(0).alias("way"), F.col("next").alias("least")))).otherwise(F.array(F.struct(F.lit(0).alias("way"), F.col("low").alias("least")), F.struct(F.lit(1).alias("way"), F.col("next").alias("least"))))
    placed = placed.select("root", F.col("e.s").alias("s"), "node", "group", "size", "n", "off", "star", "at", F.inline(ways)).where(F.col("at") <= first("n", F.col("off") + F.col("least")))
    placed = written(placed.drop("least"), "placed-shingles")
    keys = ["root", "s", "way"]
    x = placed.where("star or way = 1").select(*keys, *(F.col(c).alias(f"{c}_x") for c in ("node", "group", "size", "n", "off", "at")))
    y = placed.where("not star").select(*keys, *(F.col(c).alias(f"{c}_y") for c in ("node", "group", "size", "n", "off", "at")))
    off = F.col("off_x") + F.col("off_y")
    sizes = F.least("size_x", "size_y") >= F.lit(similarity) * F.greatest("size_x", "size_y") - 1e-9
    meet = [x[k] == y[k] for k in keys]
    able = (F.col("group_x") != F.col("group_y")) & ((x["way"] == 0) | (F.col("node_x") < F.col("node_y"))) & sizes & (F.col("at_x") <= first("n_x", off)) & (F.col("at_y") <= first("n_y", off))
    found = x.join(y, meet[0] & meet[1] & meet[2] & able)
    return found.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _crossing(sets: DataFrame, links: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links and pairs to check, both (a, b), that with ``links`` join all nodes
    of a root that are alike enough. ``sets``: (node, root, set)."""
    diffs = written(_differences(sets, similarity), "differences")
    centre = diffs.groupBy("root").agg(F.min(F.struct("off", "node")).alias("c")).select("root", F.col("c.off").alias("low"), F.col("c.node").alias("centre"))
    marked = diffs.join(centre, "root").withColumn("star", (F.col("node") == F.col("centre")) | (F.col("off") + F.col("low") <= 1e-9))
    star = written(marked.where("star and node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")), "star")
    sure = written(components(links.unionByName(star)).select("node", F.col("root").alias("group")), "sure")
    after = marked.where("not star").groupBy("root").agg(F.min("off").alias("next"))
    marked = written(marked.drop("centre").join(after, "root").join(sure, "node", "left").withColumn("group", F.coalesce("group", "node")), "marked")
    return star, written(_open_pairs(marked, similarity), "crossing")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) with whether their shingle sets are ``similarity`` or
    more alike in Jaccard's measure."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    sure = common >= F.lit(similarity) * (F.size("x") + F.size("y") - common) - 1e-9
    return written(both.select("a", "b", sure.alias("same")).distinct(), "verified")


def similar_documents(docs: DataFrame, k: int = 5, tables: int = 5, budget: int = 4, limit: int = 60, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """``(id_col, component_id)``: groups of documents that chains of pairs join
    whose sets of ``k``-word shingles are ``similarity`` or more alike in
    Jaccard's measure; every such link is exact over the sets themselves.

    Candidates differ in ``budget`` or fewer bits in one of ``tables``
    fingerprints of the distinct words, found by the trie join, or agree in one
    band of minima of their shingles; their 256-bit shingle SimHashes differ in
    ``limit`` bits or fewer (a similarity of 0.8 gives 39 on average, with a
    deviation of 5.7) and their sizes allow the similarity. Spanning
    forests of the candidates are checked first; where one of their links
    fails, the nodes that candidates join are searched for all links, by what
    their sets differ in from what most of them hold. Texts without
    words are copies of each other. Rows without an id are left out; the
    smallest id names a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            a, b = _candidates(pa.Table.from_batches(held), budget, limit, similarity)
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    own = written(_sketches(texts, k, tables), "sketches")
    nodes = written(own.groupBy("node").agg(F.min("i").alias("low"), *(F.first(c).alias(c) for c in ("size", "fps", "bands", *SKETCH))), "nodes")
    tries = sub_tries(nodes.select(F.posexplode("fps").alias("table", "fp"), "node", "size", *SKETCH), budget, hot)
    bands = nodes.select((F.posexplode("bands")).alias("table", "fp"), "node", "size", *SKETCH)
    bands = bands.select((F.col("table") + tables).alias("table"), "fp", "node", "size", *SKETCH, F.lit(-1).cast("long").alias("mask"), F.col("fp").alias("part"))
    rows = tries.unionByName(bands).repartition("table", "mask", "part")
    forest = written(rows.mapInArrow(run, "a long, b long").distinct(), "forest")
    sets = _sets_of(forest, nodes, texts, k)
    first = _verified(forest, sets, similarity)
    links = first.where("same").select("a", "b")
    failed = first.where("not same").select("a", "b")
    if failed.head(1):
        roots = written(components(first.select("a", "b")), "candidate-roots")
        open_roots = failed.join(roots, F.col("a") == F.col("node")).select("root").distinct()
        open_nodes = written(roots.join(open_roots, "root", "left_semi"), "open")
        star, rest = _crossing(sets.join(beside(open_nodes), "node"), links, similarity)
        more = _verified(rest.join(failed, ["a", "b"], "left_anti"), sets, similarity)
        links = links.unionByName(star).unionByName(more.where("same").select("a", "b"))
    roots = written(components(written(links, "links")), "roots")
    placed = written(nodes.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")), "placed")
    lows = placed.groupBy("root").agg(F.min("low").cast("long").alias("component_id"))
    return own.select("i", "node").join(placed.join(lows, "root").select("node", "component_id"), "node").select(F.col("i").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs``, all columns, with one document of each group: the one of the
    smallest id (of repeated ids one row). Rows without an id stay."""
    groups = written(similar_documents(docs, id_col=id_col, **options), "groups")
    out = by_id(docs, groups.where(F.col(id_col) != F.col("component_id")), id_col, "left_anti")
    again = written(groups.groupBy(id_col).count().where("count > 1").select(id_col), "repeated")
    if again.head(1):
        some = by_id(out, again, id_col, "left_semi").dropDuplicates([id_col])
        out = by_id(out, again, id_col, "left_anti").unionByName(some)
    return out
