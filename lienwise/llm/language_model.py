"""Language-model scores from sharded Elias-Fano trigram tries.

p(w | u, v) = (c(u, v, w) + A c(v, w) / max(c(v), K) + m p(w))
            / (c(u, v) + A min(c(v), K) / K + m)

with p(w) = (c(w) - d) / N for words of the training texts and d V / N for all
others together; the end of a text is a word, and stands before its first word
too. So the bigram counts as A observations (fewer after a word seen less than K
times) and the unigram as m.

The log of the numerator needs what is known about w under its predecessors,
that of the denominator what is known about v under its predecessor; so one
shuffle by word brings every occurrence to the shard that counts it, builds its
part of the trie and scores it, and no shard needs another's counts, but for a
bounded list of the most frequent words, which is broadcast; counts of other
words seen more than K times come to the shards that ask for them. Words that
a shard could not hold are split by their predecessor, pairs that it could not
hold by the word before, and triples by the block; the counts of those, bounded
lists too, are broadcast. Occurrences travel in packed blocks; what comes back
for a block is two bytes an occurrence and a count a word, in the order in which
they went, so that the way back costs the same with any number of shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .eliasfano import STEP, TrigramTrie
from .storage import written

SHARD_TOKENS = 1_200_000
BLOCK_TOKENS = 1_000_000
#: Entries that a broadcast list of frequent words, or of words, pairs or triples to be split, may have.
LISTED = 1 << 20
END = np.uint64(0x5BD1E995C2B2AE35)
PRIOR, PAIRED, DISCOUNT, OFTEN = 2.0, 2.0, 0.5, 64


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word, the two before it and text of each token; each text ends with END."""
    words = W.split_words(column)
    counts = words.counts
    ends = words.ptr[1:] + np.arange(len(counts))
    out = np.empty(len(words.starts) + len(counts), np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = words.hashes(7), END
    before, second = np.full(len(out), END), np.full(len(out), END)
    before[1:], second[2:] = out[:-1], out[:-2]
    second[(ends + 1)[:-1]] = END  # the first word of a text
    return out, before, second, np.repeat(np.arange(len(counts)), counts + 1)


def _pair(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The key of a pair, by the 32 bits of the predecessor that travel; in
    that of a triple the word before counts by the 24 bits that travel."""
    return W.mix(word + W.mix(before >> np.uint64(32)))


def _triple(pair: np.ndarray, second: np.ndarray) -> np.ndarray:
    return W.mix(pair ^ W.mix((second >> np.uint64(40)) + np.uint64(0x51)))


@dataclass
class Listed:
    """Counts (in training texts, in all) of some keys, sorted."""

    keys: np.ndarray
    train: np.ndarray
    every: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Sets the training counts of the keys that are listed."""
        hit = self.has(keys)
        counts[hit] = self.train[np.searchsorted(self.keys, keys[hit])]


def _listed(counts: DataFrame) -> Listed:
    held = counts.select("x", "n", "m").toArrow()
    keys = held["x"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Listed(keys[order], held["n"].to_numpy()[order], held["m"].to_numpy()[order])


def _counts(texts: DataFrame, parents: list[Listed]) -> DataFrame:
    """(x, n, m): occurrences in training and in all texts of words (no
    parents), of pairs whose word is listed, of triples whose pair is too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            key, back = np.unique(np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.uint64), return_inverse=True)
            sums = [np.bincount(back, np.concatenate([h[j] for h in held]) if held else None, len(key)).astype(np.int64) for j in (1, 2)]
            return pa.record_batch([pa.array(key.view(np.int64)), *map(pa.array, sums)], ["x", "n", "m"])

        for b in W.pieces(batches, "t"):
            key, before, second, owner = tokens(b.column("t"))
            train = b.column("train").to_numpy(zero_copy_only=False)[owner]
            for level, listed in enumerate(parents):
                own = listed.has(key)
                key, before, second, train = key[own], before[own], second[own], train[own]
                key = _triple(key, second) if level else _pair(key, before)
            key, back = np.unique(key, return_inverse=True)
            held.append((key, np.bincount(back, train, len(key)), np.bincount(back, minlength=len(key))))
            size += len(key)
            if size > 1 << 20:
                yield out()
                held, size = [], 0
        yield out()

    return texts.mapInArrow(run, "x long, n long, m long").groupBy("x").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _shard(word: np.ndarray, before: np.ndarray, second: np.ndarray, hot: list[Listed], shards: int, block: int) -> np.ndarray:
    key, at = word.copy(), np.flatnonzero(hot[0].has(word)) if hot else np.zeros(0, np.int64)
    if len(at):
        key[at] = _pair(word[at], before[at])
        at = at[hot[1].has(key[at])] if len(hot) > 1 else at[:0]
    if len(at):
        key[at] = _triple(key[at], second[at])
        at = at[hot[2].has(key[at])] if len(hot) > 2 else at[:0]
        key[at] += W.mix(np.uint64(block) + np.zeros(1, np.uint64))
    return (W.mix(key ^ np.uint64(0xA5A5)) % np.uint64(shards)).astype(np.int32)


_BLOCK = "shard int, block long, train binary, words binary, counts binary, previous binary, second binary, docs binary, owner binary"
_FOUND = "block long, shard int, docs binary, owner binary, counts binary, found binary, codes binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _blocks(texts: DataFrame, held_hot, shards: int) -> DataFrame:
    """Occurrences by shard, packed: the words with their counts, and for each
    occurrence, in word order, 32 and 24 bits of the hashes of the two words
    before and whether it is in a training text. A row of negative shard holds
    the block's texts, (id, training, tokens), and the text of each occurrence in
    the order of all shards."""

    def pack(held: list, block: int) -> pa.RecordBatch:
        word, before, second, owner, docs = (np.concatenate([h[i] for h in held]) for i in range(5))
        shard = _shard(word, before, second, held_hot.value, shards, block)
        order = np.lexsort((word, shard))
        word, owner, shard = word[order], owner[order], shard[order]
        short, far = ((x[order] >> np.uint64(32)).astype(np.uint32) for x in (before, second))
        train, edges = docs[owner, 1] > 0, np.searchsorted(shard, np.arange(shards + 1))
        rows = [(-1 - block % shards, block, b"", b"", b"", b"", b"", docs.tobytes(), zstandard.compress(owner.astype(np.uint16).tobytes(), 1))]
        for s in np.flatnonzero(np.diff(edges)).tolist():
            a, z = edges[s], edges[s + 1]
            first = np.flatnonzero(np.concatenate([[True], word[a + 1 : z] != word[a : z - 1]]))
            counts = np.diff(np.append(first, z - a)).astype(np.uint32)
            rows.append((s, block, np.packbits(train[a:z]).tobytes(), word[a:z][first].tobytes(), counts.tobytes(), short[a:z].tobytes(), far[a:z].view(np.uint8).reshape(-1, 4)[:, 1:].tobytes(), b"", b""))
        return _batch(rows, _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts_held, block = [], 0, 0, TaskContext.get().partitionId() << 32
        for b in (piece.slice(at, 16_384) for piece in W.pieces(batches, "t") for at in range(0, piece.num_rows, 16_384)):
            word, before, second, owner = tokens(b.column("t"))
            docs = np.stack([b.column("i").to_numpy().astype(np.int64), b.column("train").to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(owner, minlength=b.num_rows)], axis=1)
            if held and (size + len(word) > BLOCK_TOKENS or texts_held + len(docs) > 65_535):
                yield pack(held, block)
                held, size, texts_held, block = [], 0, 0, block + 1
            held.append((word, before, second, owner + texts_held, docs))
            size, texts_held = size + len(word), texts_held + len(docs)
        if held:
            yield pack(held, block)

    return texts.mapInArrow(run, _BLOCK)


@dataclass
class Model:
    """What all shards share: sizes, weights, the counts of frequent words by
    32 bits of their hashes, and those of words, pairs and triples that are split."""

    total: int
    vocabulary: int
    texts: int
    prior: float
    paired: float
    discount: float
    often: float
    short: np.ndarray
    short_counts: np.ndarray
    hot: list[Listed]

    def __post_init__(self) -> None:
        order = np.lexsort((-self.short_counts, self.short))  # of words of equal bits the most frequent counts
        self.short, self.short_counts = self.short[order], self.short_counts[order]

    def knowing(self, short: np.ndarray, counts: np.ndarray) -> Model:
        """The same with more frequent words."""
        return replace(self, short=np.concatenate([self.short, short]), short_counts=np.concatenate([self.short_counts, counts]))

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts - self.discount) / max(self.total, 1)

    def bigram_weight(self, before: np.ndarray) -> np.ndarray:
        """A / max(c(v), K) for 32 bits of the hash of v."""
        count = np.full(len(before), self.often)
        if len(self.short):
            at = np.minimum(np.searchsorted(self.short, before), len(self.short) - 1)
            count = np.where(self.short[at] == before, np.maximum(self.short_counts[at], self.often), count)
        return self.paired / count

    def context(self, pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The log10 of the denominator after words and pairs of these counts."""
        return np.log10(pairs + self.paired * np.minimum(words, self.often) / self.often + self.prior)


def score_shard(words: np.ndarray, counts: np.ndarray, previous: np.ndarray, second: np.ndarray, train: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The training count of each word and the code of each occurrence's score."""
    own, word_place = np.unique(words, return_inverse=True)
    place = np.repeat(word_place.astype(np.int32), counts)

    # distinct triples, pairs and words with their training counts; those of split ones come from the lists
    pair_key = (place.astype(np.uint64) << np.uint64(32)) | previous
    pairs, pair_of = np.unique(pair_key, return_inverse=True)
    triples, triple_of = np.unique((pair_of.astype(np.uint64) << np.uint64(32)) | second, return_inverse=True)
    word_of_pair, pair_of_triple = (pairs >> np.uint64(32)).astype(np.int64), (triples >> np.uint64(32)).astype(np.int64)
    c3 = np.bincount(triple_of[train], minlength=len(triples)).astype(np.float64)
    c2 = np.bincount(pair_of_triple, c3, len(pairs))
    c1 = np.bincount(word_of_pair, c2, len(own))
    for listed, count, keys in zip(model.hot, (c1, c2, c3), (lambda: own, lambda: _pair(own[word_of_pair], pairs << np.uint64(32)), lambda: _triple(_pair(own[word_of_pair], pairs << np.uint64(32))[pair_of_triple], triples << np.uint64(32))), strict=False):
        listed.put(keys(), count)

    known = c1 > 0

    # the trie holds what occurs in training texts; each distinct triple is looked up once
    low = model.prior * model.unigram(c1)
    before = (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    middle = c2 * model.bigram_weight(before)
    seen2, seen3 = c2 > 0, c3 > 0
    rank1, rank2 = np.cumsum(known) - 1, np.cumsum(seen2) - 1
    word_of, pair_in = word_of_pair[seen2], pair_of_triple[seen3]
    trie = TrigramTrie(
        own[known],
        (np.log10(low[known]), -model.context(np.zeros(int(known.sum())), c1[known])),
        (rank1[word_of].astype(np.uint64) << np.uint64(32)) | before[seen2],
        (np.log10(middle[seen2] + low[word_of]), -model.context(c2[seen2], c1[word_of])),
        (rank2[pair_in].astype(np.uint64) << np.uint64(32)) | (triples[seen3] & np.uint64(0xFFFFFFFF)),
        np.log10(c3[seen3] + middle[pair_in] + low[word_of_pair[pair_in]]),
    )
    unknown = math.log10(model.prior * model.discount * max(model.vocabulary, 1) / max(model.total, 1)), -math.log10(model.prior)
    at = trie.place(own)[word_of_pair[pair_of_triple]]
    value, context = trie.look_up(at, before[pair_of_triple], (triples & np.uint64(0xFFFFFFFF)).astype(np.uint32), unknown)
    # the end of a text stands for the start before it: the context of its first word
    start = -float(model.context(np.array([model.texts]), np.array([model.texts]))[0])
    context[own[word_of_pair[pair_of_triple]] == END] = start
    codes = np.clip(np.rint(-STEP * (value + context)), 0, 65535).astype(np.uint16)
    return c1[word_place], codes[triple_of]


def _least_listed(counts: DataFrame, often: int, most: int) -> int:
    """The least count from ``often`` on that at most ``LISTED`` words exceed;
    ``most``, which so few do exceed in any case, bounds what is looked at."""
    held = counts.where(F.col("n") > often).groupBy(F.least("n", F.lit(most + 1)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect() if most > often else []
    listed = 0
    for r in held:
        listed += r["words"]
        if listed > LISTED:
            return r["n"]
    return often


def _mask(rest: DataFrame) -> np.ndarray:
    """A set bit for the first 26 of the 32 bits of each word of ``rest``: 8 MB
    at any size, which tells most other words from these."""
    place = F.shiftrightunsigned("x", 6)
    held = rest.groupBy(F.shiftrightunsigned(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(x, 6) & 63 as int))")).alias("bits")).toArrow()
    mask = np.zeros(1 << 20, np.uint64)
    mask[held["at"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
    return mask


def _asked(blocks: DataFrame, rest: DataFrame, held_mask) -> DataFrame:
    """(shard, x, n): the words of ``rest`` (x: 32 bits of the hash, n) that
    stand before a word of the shard. Words that the mask rules out don't travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = held_mask.value
        for b in batches:
            for shard, previous in zip(b.column("shard").to_pylist(), b.column("previous"), strict=True):
                x = np.frombuffer(previous.as_buffer(), np.uint32)
                x = np.unique(x[(mask[x >> np.uint32(12)] >> ((x >> np.uint32(6)) & np.uint32(63)).astype(np.uint64)) & np.uint64(1) > 0]).astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(x), shard, np.int32)), pa.array(x)], ["shard", "x"])

    return blocks.where("shard >= 0").select("shard", "previous").mapInArrow(run, "shard int, x long").distinct().join(rest, "x").select("shard", "x", "n")


def _scores(blocks: DataFrame, held_model, kind: type, rest: DataFrame | None = None) -> DataFrame:
    """Counts and codes by block and shard; rows of texts pass. ``rest`` has
    the frequent words that the model lacks."""
    names = [x.split()[0] for x in _BLOCK.split(", ")]

    def run(group: pa.Table, more: pa.Table | None = None) -> pa.Table:
        model = held_model.value
        if more is not None and more.num_rows:
            model = model.knowing(more["x"].to_numpy().astype(np.uint32), more["n"].to_numpy())
        rows = [r for b in group.to_batches() for r in zip(*(b.column(x) for x in names), strict=True)]
        if rows[0][0].as_py() < 0:
            return pa.Table.from_batches([_batch([(r[1].as_py(), -1, r[7].as_py(), r[8].as_py(), b"", b"", b"") for r in rows], _FOUND)])
        column = lambda j, kind: [np.frombuffer(r[j].as_buffer(), kind) for r in rows]
        words, counts, previous = column(3, np.uint64), column(4, np.uint32), column(5, np.uint32)
        size, ends = [len(x) for x in previous], np.cumsum([[len(w), len(p)] for w, p in zip(words, previous, strict=True)], axis=0)
        train = np.concatenate([np.unpackbits(x, count=n).astype(bool) for x, n in zip(column(2, np.uint8), size, strict=True)])
        second = np.zeros((sum(size), 4), np.uint8)
        second[:, 1:] = np.concatenate(column(6, np.uint8)).reshape(-1, 3)
        found, codes = score_shard(np.concatenate(words), np.concatenate(counts), np.concatenate(previous), second.view(np.uint32)[:, 0], train, model)
        found = found.astype(kind)
        out = [(r[1].as_py(), r[0].as_py(), b"", b"", c.tobytes(), found[w - len(c) : w].tobytes(), codes[z - n : z].tobytes()) for r, c, n, (w, z) in zip(rows, counts, size, ends, strict=True)]
        return pa.Table.from_batches([_batch(out, _FOUND)])

    if rest is None:
        return blocks.groupBy("shard").applyInArrow(lambda group: run(group), _FOUND)
    asked = _asked(blocks, rest, blocks.sparkSession.sparkContext.broadcast(_mask(rest)))
    return blocks.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(lambda group, more: run(group, more), _FOUND)


def _totals(found: DataFrame, kind: type) -> DataFrame:
    """One row a text from all that came back for its block."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["shard"])  # the block's texts, then its shards
        docs = np.frombuffer(rows[0]["docs"], np.int64).reshape(-1, 3)
        owner = np.frombuffer(zstandard.decompress(rows[0]["owner"]), np.uint16)
        counts, count, codes = (np.concatenate([np.frombuffer(r[c], k) for r in rows]) for c, k in (("counts", np.uint32), ("found", kind), ("codes", np.uint16)))
        n = len(docs)
        known = np.bincount(owner, np.repeat(count > 0, counts), n).astype(np.int64)
        base = np.bincount(owner, np.repeat(np.log10(count + 1.0), counts), n)
        score = np.bincount(owner, codes, n) / -STEP
        return pa.table([pa.array(docs[:, 0]), pa.array(docs[:, 1] == 0), pa.array(docs[:, 2]), pa.array(known), pa.array(base), pa.array(score)], ["i", "held_out", "n_tokens", "n_known", "base", "score"])

    return found.groupBy("block").applyInArrow(run, "i long, held_out boolean, n_tokens long, n_known long, base double, score double")


def score_texts(docs: DataFrame, is_training, prior: float = PRIOR, paired: float = PAIRED, discount: float = DISCOUNT, often: int = OFTEN, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text", steady: bool = False) -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score,
    score)`` of every row: log10 probabilities under add-one unigrams and under
    the trigram model, both learnt from the rows where ``is_training`` (a
    Column) holds; null counts as false. ``prior``, ``paired`` and ``often`` are
    m, A and K. If ``steady``, K is ``often`` at any size, and what the list of the
    ``LISTED`` most frequent words lacks is joined; else K grows where more than ``LISTED``
    words could be above it.

    Predecessors are known by 32 bits within a word, the words before by 24 bits
    within a pair: of a million different predecessors of a word one in 4000 is
    taken for another, of a thousand words before a pair one in 16,000. Null texts are empty: one token, the end.
    Rows without an id are left out; repeated rows are texts of their own.
    Without training texts all words are unknown. An empty table gives an empty
    result; extra columns are ignored."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.coalesce(is_training, F.lit(False)).alias("train"))
    context = docs.sparkSession.sparkContext
    counts = written(_counts(texts, []), "words")
    total, every, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0))).first()
    bound = max(often, -(-total // LISTED))
    if steady:
        bound = _least_listed(counts, often, bound)
    frequent, rest = _listed(counts.where(F.col("n") > bound)), None  # at most LISTED words
    if not steady:
        often = bound
    elif bound > often:
        rest = counts.where((F.col("n") > often) & (F.col("n") <= bound)).groupBy(F.shiftrightunsigned("x", 32).alias("x")).agg(F.max("n").alias("n"))
    ends = counts.where(F.col("x") == F.lit(int(END.view(np.int64)))).select("n").first()
    limit = max(shard_tokens // 4, 1, -(-every // LISTED))
    hot = [_listed(counts.where(F.col("m") > limit))]
    while len(hot) < 3 and len(hot[-1].keys):  # split ones are counted level by level, under LISTED a level
        hot.append(_listed(_counts(texts, hot).where(F.col("m") > limit)))
    short = (frequent.keys >> np.uint64(32)).astype(np.uint32)
    model = Model(total, vocabulary, ends["n"] if ends else 0, prior, paired, discount, float(often), short, frequent.train, hot)
    shards = max(1, math.ceil(every / shard_tokens))
    kind = np.uint32 if total < 2**32 else np.uint64
    rows = _totals(_scores(_blocks(texts, context.broadcast(hot), shards), context.broadcast(model), kind, rest), kind)
    return rows.select(
        F.col("i").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(total + vocabulary + 1))).alias("base_score"),
        "score",
    )
