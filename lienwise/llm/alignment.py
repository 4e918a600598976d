"""Cross-tokenizer alignment: which tokens of two vocabularies end together.

Both tokenizers cover the same bytes (a space and the text). Texts are cut
before spaces where neither of the two can join what stands on both sides, so
that each distinct piece of a batch is encoded once. Over all distinct pieces at
once, NumPy finds the byte ends of the tokens (cumsum), the ends that both have
(intersect1d), the group of each token (searchsorted) and the linked pairs
(repeat-based expansion). Pair counts of the corpus are summed in two salted
shuffles. What each document's links count is looked up for the common pairs, of
which a bounded list is broadcast, and joined for all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import written

#: Pairs that may be broadcast: 2**20 rows of 17 bytes.
LISTED = 1 << 20
#: Distinct pairs that a task holds before it passes its sums on.
HELD = 1 << 20
SALTS = 8
BATCH_BYTES = 2 << 20
#: Packed links that a task unpacks at a time.
LINK_BYTES = 1 << 20
#: Distinct pieces whose ids are Python lists at a time.
STEP = 1 << 14


def default_paths() -> tuple[str, str, str]:
    """Rank file and JSON form of A, model of B."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def _byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers, with the bytes of each of their tokens."""

    def __init__(self, ranks: str, json: str, model: str) -> None:
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.json = json
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes_a = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.bytes_a[i] = token
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode() for p in pieces]
        self.length_a, self.length_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.blank = self.model.piece_to_id("▁")
        probe = "  ﬁＡ \téé  x "
        plain = self.model.normalize(probe) == "▁" + probe.replace(" ", "▁")
        #: B can be taken piece by piece if no token of it goes on after a space and texts are not changed.
        self.local = plain and not any("▁" in p.lstrip("▁") for p in pieces)

    @cached_property
    def exact(self):
        """The JSON form of A; special tokens' strings are plain text."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.json)
        out.encode_special_tokens = True
        return out

    def encode_a(self, piece: str) -> list[int]:
        """The fast library's pattern gives up on about a million white-space
        characters in a row; the JSON form takes those."""
        try:
            return self.fast.encode_ordinary(piece)
        except ValueError:
            return self.exact.encode(piece, add_special_tokens=False).ids

    def encode_b(self, pieces: list[str]) -> list[list[int]]:
        """Of pieces that begin with the space that the model adds itself."""
        out = self.model.encode([p[1:] for p in pieces], num_threads=1)
        return [ids if len(p) > 1 else [self.blank] for p, ids in zip(pieces, out, strict=True)]


    def fits(self, pieces: list[str], *sides: list[list[int]]) -> list[bool]:
        """Whether each side's tokens have a piece's own bytes; piece by piece
        only if not all of them do."""
        raw = [p.encode() for p in pieces]
        whole = b"".join(raw)
        every = True
        for ids, table, length in zip(sides, (self.bytes_a, self.bytes_b), (self.length_a, self.length_b), strict=True):
            n = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
            ends = np.concatenate([[0], np.cumsum(length[flat])])[np.cumsum(n)]
            every &= b"".join(map(table.__getitem__, flat.tolist())) == whole and np.array_equal(ends, np.cumsum([len(x) for x in raw]))
        if every:
            return [True] * len(raw)
        return [all(b"".join(map(table.__getitem__, x)) == t for x, table in zip(both, (self.bytes_a, self.bytes_b), strict=True)) for t, *both in zip(raw, *sides, strict=True)]


@cache
def tokenizers(paths: tuple[str, str, str]) -> Pair:
    return Pair(*paths)


def spaced_pieces(column: pa.Array, local: bool = True) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The texts with a space before them, cut before each space that follows a
    character that is surely no white space (a printable ASCII one, or one of two
    bytes from U+00C0 on); the piece pointers of each text, and bytes of pieces."""
    raw, off = W.text_buffer(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column.cast(pa.large_string()), pa.scalar("", pa.large_string())))
    n = len(raw)
    before, second = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], second[2:] = raw[:-1], raw[:-2]
    cut = (raw == 32) & ((before > 32) & (before < 127) | (before > 127) & (second >= 0xC3) & (second <= 0xDF)) if local else np.zeros(n, bool)
    cut[off[:-1]] = True
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, n).astype(np.int64)
    array = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(raw))
    return array.dictionary_encode(), np.searchsorted(starts, off), np.diff(bounds)


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The common cuts of two rising sequences of ends, and each token's group."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)  # no token is without bytes
    return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)


def expanded(group_a: np.ndarray, group_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs with the same group, for two rising label lists."""
    n_b = np.bincount(group_b, minlength=groups)
    first_b = np.cumsum(n_b) - n_b
    times = n_b[group_a]
    left = np.repeat(np.arange(len(group_a)), times)
    within = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    return left, first_b[group_a[left]] + within


def gathered(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions of the given runs, one run after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def joined(values: pa.Array, ptr: np.ndarray, between: str) -> pa.Array:
    lists = pa.LargeListArray.from_arrays(pa.array(ptr, pa.int64()), values)
    return pc.binary_join(lists, pa.scalar(between, values.type))


class Aligned:
    """Tokens, groups and links of a list of distinct pieces, which don't cross
    pieces. ``fits``: both token sequences give the piece's own bytes; others
    have no tokens."""

    def __init__(self, pair: Pair, pieces: pa.Array) -> None:
        a, b, n_a, n_b, fits = ([] for _ in range(5))
        sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        for k in range(0, len(pieces), STEP):
            part = pieces[k : k + STEP].to_pylist()
            ids_a, ids_b = [pair.encode_a(p) for p in part], pair.encode_b(part)
            good = pair.fits(part, ids_a, ids_b)
            if not all(good):
                ids_a, ids_b = ([x if g else [] for x, g in zip(ids, good, strict=True)] for ids in (ids_a, ids_b))
            for ids, flat, n in ((ids_a, a, n_a), (ids_b, b, n_b)):
                n.append(np.array([len(x) for x in ids], np.int64))
                flat.append(np.fromiter(chain.from_iterable(ids), np.int32, int(n[-1].sum())))
            fits.append(np.array(good, bool))
        none = [np.zeros(0, np.int64)]
        a, b, self.n_a, self.n_b = (np.concatenate(x or none) for x in (a, b, n_a, n_b))
        self.fits = np.concatenate(fits or [np.zeros(0, bool)])
        size = np.where(self.fits, sizes, 0)
        ends_a, ends_b = np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b])
        cuts, group_a, group_b = groups_of(ends_a, ends_b)
        bounds = np.concatenate([[0], np.searchsorted(cuts, np.cumsum(size), side="right")])
        self.n_groups = np.diff(bounds)
        last_a, last_b = np.flatnonzero(ends_a == cuts[group_a]), np.flatnonzero(ends_b == cuts[group_b])
        left, right = expanded(group_a[last_a], group_b[last_b], len(cuts))
        half, kind = code_type(pair)
        self.links = (a[last_a][left].astype(np.uint64) << half | b[last_b][right].astype(np.uint64)).astype(kind)
        self.first_link = np.searchsorted(group_a[last_a][left], bounds)
        self.n_links = np.diff(self.first_link)
        text = lambda ids, group: joined(pa.array(ids).cast(pa.large_string()), np.searchsorted(group, np.arange(len(cuts) + 1)), ",")
        self.text = joined(pc.binary_join_element_wise(text(a, group_a), text(b, group_b), pa.scalar("|", pa.large_string())), bounds, ";")


def code_type(pair: Pair) -> tuple[np.uint64, str]:
    """How a pair of ids is one number: the bits of each, and its type."""
    return (np.uint64(16), "<u4") if max(len(pair.bytes_a), len(pair.bytes_b)) <= 1 << 16 else (np.uint64(32), "<u8")


def aligned(docs: DataFrame, paths: tuple[str, str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id_col, n_a, n_b, n_groups, n_links, groups, links)`` per row of
    ``docs``, settled: ``groups`` has the ids of both sides (``a1,a2|b1;a3|b2``),
    ``links`` the pairs of tokens that end together, packed.

    Texts that are null or empty, or that a tokenizer doesn't give back byte for
    byte, have no tokens. Special tokens' strings are plain text. Repeated and
    null ids are rows of their own; other columns are not read; an empty table
    gives an empty result. A text is encoded whole, however long; batches are
    cut to about ``BATCH_BYTES`` of text. The files have to be readable on every
    executor."""
    paths = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(paths)
        for b in W.pieces(batches, "t", BATCH_BYTES):
            whole = pc.fill_null(b.column("t"), "")
            coded, ptr, _ = spaced_pieces(whole, pair.local)
            found = Aligned(pair, coded.dictionary)
            piece = coded.indices.to_numpy().astype(np.int64)
            per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ptr])
            good = (per(~found.fits[piece]) == 0) & (pc.binary_length(whole).to_numpy() > 0)
            kept = piece[np.repeat(good, np.diff(ptr))]
            ptr = np.concatenate([[0], np.cumsum(np.where(good, np.diff(ptr), 0))])
            figures = [np.diff(np.concatenate([[0], np.cumsum(x[kept])])[ptr]) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
            links = found.links[gathered(found.first_link[:-1][kept], found.n_links[kept])]
            bounds = np.concatenate([[0], np.cumsum(figures[3])]) * links.itemsize
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(good), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(links)])
            yield pa.record_batch([b.column("i"), *map(pa.array, figures), joined(found.text.take(pa.array(kept)), ptr, ";").cast(pa.string()), packed.cast(pa.binary())], ["i", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    frame = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    out = frame.mapInArrow(run, f"i {frame.schema['i'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, links binary")
    return written(out.withColumnRenamed("i", id_col).withColumn("row", F.monotonically_increasing_id()), "aligned")


def _codes(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed links, and the pointers of each row."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind).astype(np.int64), (off - off[0]) // np.dtype(kind).itemsize


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate(codes)
    order = np.argsort(both, kind="stable")
    both, n = both[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    return both[first], np.add.reduceat(n, first) if len(both) else n


def pair_counts(links: DataFrame, kind: str = "<u4") -> DataFrame:
    """``(code, n, best)``, settled: how many links hold each pair, and whether
    no other pair of its B id has more. Tasks sum what they read, passing it on
    when they hold over ``HELD`` pairs; a pair's sums meet by pair and salt
    first, so that none is one task's work. B's highest are a row for an id of
    its vocabulary, which bounds their broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt, codes, counts, held = TaskContext.get().partitionId() % SALTS, [], [], 0

        def rows(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(code), pa.array(n), pa.array(np.full(len(code), salt, np.int32))], ["code", "n", "salt"])

        for b in W.pieces(batches, "links", LINK_BYTES):
            code, n = np.unique(_codes(b.column("links"), kind)[0], return_counts=True)
            codes.append(code)
            counts.append(n.astype(np.int64))
            held += len(code)
            if held > HELD:
                code, n = _summed(codes, counts)
                if len(code) > HELD // 2:
                    yield rows(code, n)
                    code, n = code[:0], n[:0]
                codes, counts, held = [code], [n], len(code)
        if codes:
            yield rows(*_summed(codes, counts))

    parts = links.select("links").mapInArrow(run, "code long, n long, salt int")
    sums = parts.groupBy("code", "salt").agg(F.sum("n").alias("n")).groupBy("code").agg(F.sum("n").alias("n"))
    sums = written(sums.withColumn("b", F.col("code").bitwiseAND((1 << 4 * np.dtype(kind).itemsize) - 1)), "pairs")
    most = sums.groupBy("b").agg(F.max("n").alias("most"))
    return written(sums.join(F.broadcast(most), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def link_figures(docs: DataFrame, paths: tuple[str, str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", listed: int = LISTED, text: Column | None = None) -> DataFrame:
    """``aligned`` without ``row`` and ``links``, with ``n_best``, the links
    whose count is the highest of their B id, ties included, and ``count_sum``,
    the counts of all links added up.

    Pairs from some count on, ``listed`` at most, are broadcast; the others are
    joined by pair, none of which is common. ``text``, an expression over
    ``groups``, takes its place: long texts then need not pass this step."""
    paths = paths or default_paths()
    kind = code_type(tokenizers(paths))[1]
    rows = aligned(docs, paths, id_col, text_col)
    pairs = pair_counts(rows, kind)
    sizes = {r["p"]: r["k"] for r in pairs.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()}
    least, room = 64, listed
    while least and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    common = pairs.where(F.floor(F.log2("n")) >= least).toArrow()
    code = common.column("code").to_numpy()
    order = np.argsort(code)
    table = rows.sparkSession.sparkContext.broadcast((code[order], common.column("n").to_numpy()[order], common.column("best").to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = table.value
        for b in W.pieces(batches, "links", LINK_BYTES):
            codes, ptr = _codes(b.column("links"), kind)
            at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            at = at[hit]
            first = np.concatenate([[0], np.cumsum(hit)])[ptr]
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at].astype(np.int64))])[first]) for x in (best, n)]
            rest = pa.ListArray.from_arrays(pa.array((ptr - first).astype(np.int32)), pa.array(codes[~hit]))
            yield pa.record_batch([*b.columns[:-1], *map(pa.array, sums), rest], [*b.schema.names[:-1], "n_best", "count_sum", "rest"])

    shape = rows.select("row", id_col, "n_a", "n_b", "n_groups", "n_links", (F.col("groups") if text is None else text).alias("groups"), "links")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema if f.name != "links")
    found = shape.mapInArrow(run, f"{schema}, n_best long, count_sum long, rest array<long>")
    if not least:
        return found.drop("row", "rest")
    found = written(found, "links")
    rare = found.select("row", F.explode("rest").alias("code")).groupBy("row", "code").agg(F.count(F.lit(1)).alias("k"))
    more = rare.join(pairs.where(F.floor(F.log2("n")) < least), "code").groupBy("row").agg(F.sum(F.col("k") * F.col("best").cast("long")).alias("b"), F.sum(F.col("k") * F.col("n")).alias("c"))
    full = found.join(more, "row", "left")
    return full.withColumn("n_best", F.col("n_best") + F.coalesce("b", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("c", F.lit(0))).drop("row", "rest", "b", "c")
