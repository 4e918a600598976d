"""BPE encoding and decoding through a minimal acyclic transducer.

The most frequent words of the corpus, counted over all texts, are encoded once
and compiled into the smallest automaton that holds them: words share prefixes
and, by merging equal states from their ends, suffixes. Each edge carries the
number of words that sort before those behind it, so that the sums along a path
number the words without gaps, and a word's number leads to its ids. Tasks
memory-map the automaton and walk all distinct words of a batch through it at
once, a byte a step. Words outside it are merged pair by pair, lowest rank
first, which gives exactly the ids of the vocabulary's own library.

Vocabularies are JSON files with byte-level words, an end-of-word mark, runs of
letters, single digits, runs of other signs and English contractions, lower
case, white space dropped, and no decoder: tokens are joined by spaces.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .alignment import _byte_chars, gathered
from .eliasfano import mapped

#: Words in the transducer, and the bytes of the longest one.
WORDS, LONGEST = 1 << 17, 48
#: Distinct words that a task counts before it passes its sums on, and merged words that it remembers.
HELD, REMEMBERED = 1 << 18, 1 << 16
BATCH_BYTES = 1 << 20
#: Code points below this are split by tables; texts with others by the library.
TABLE = 0x240
SPACE, LETTER, DIGIT, SIGN = range(4)
CONTRACTIONS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Vocabulary:
    """Ids, merges and the library's own normaliser and splitter."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        self.chars = _byte_chars()
        self.inner, self.last = np.zeros(256, np.int64).tolist(), np.zeros(256, np.int64).tolist()
        for char, byte in self.chars.items():
            self.inner[byte], self.last[byte] = vocab[char], vocab[char + self.end]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.library = Tokenizer.from_file(path)
        self.find_special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word: again and again the pair of lowest rank is merged,
        of equal ones the first. A heap and links keep long words at n log n."""
        ids = [*map(self.inner.__getitem__, word[:-1]), self.last[word[-1]]]
        n, pairs = len(ids), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*pairs[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heap = [(rank, i, new, p) for rank, new, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, p = heapq.heappop(heap)
            j = after[i] if ids[i] == p[0] else -1
            if j < 0 or ids[j] != p[1]:
                continue
            ids[i], ids[j], k = new, -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if (q := (new, ids[k])) in pairs:
                    heapq.heappush(heap, (pairs[q][0], i, pairs[q][1], q))
            if (h := before[i]) >= 0 and (q := (ids[h], new)) in pairs:
                heapq.heappush(heap, (pairs[q][0], h, pairs[q][1], q))
        return [x for x in ids if x >= 0]

    def library_words(self, text: str) -> list[bytes]:
        """The words of any text, by the library. A special token is a word that
        begins with a byte that UTF-8 doesn't use."""
        out, at = [], 0
        for m in chain(self.find_special.finditer(text), [None]):
            plain = self.library.normalizer.normalize_str(text[at : m.start() if m else len(text)])
            out += [bytes(map(self.chars.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
            if m:
                out.append(b"\xff" + m[0].encode())
                at = m.end()
        return out

    @property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each low code point: its lower-case code point, its class, and
        whether it must go to the library as it changes its size or is joined
        with its neighbours. Asked of the library itself."""
        if not hasattr(self, "_tables"):
            low, kind, odd = np.arange(TABLE), np.full(TABLE, SIGN), np.zeros(TABLE, bool)
            split = lambda t: len(self.library.pre_tokenizer.pre_tokenize_str(t))
            for c in range(TABLE):
                out = self.library.normalizer.normalize_str("x" + chr(c) + "x")[1:-1]
                odd[c] = len(out) != 1 or ord(out) >= TABLE or len(out.encode()) != len(chr(c).encode())
                if not odd[c]:
                    low[c] = ord(out)
                    n = split(out + out)
                    kind[c] = SPACE if n == 0 else DIGIT if n == 2 else LETTER if split("a" + out) == 1 else SIGN
            if odd[:128].any():
                raise ValueError("this vocabulary changes the size of an ASCII character")
            self._tables = low, kind, odd
            self.bytes_low, self.bytes_kind = (np.concatenate([x[:128], np.zeros(128, np.int64)]).astype(np.uint8) for x in (low, kind))
        return self._tables


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _table_words(v: Vocabulary, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts whose code points all have tables: their lower-case bytes
    one after the other, their sizes, and the pointers of each text."""
    low, kind, _ = v.tables
    n = len(raw)
    data, what = v.bytes_low[raw], v.bytes_kind[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    point = (raw[lead].astype(np.int64) & 0x1F) << 6 | raw[lead + 1] & 0x3F
    data[lead], data[lead + 1] = low[point] >> 6 | 0xC0, low[point] & 0x3F | 0x80
    what[lead] = what[lead + 1] = kind[point]
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = (what[1:] != what[:-1]) | (what[1:] == DIGIT)
    fresh[lead + 1] = False
    fresh[off] = True
    # a sign that begins a run may be the apostrophe of a contraction, which ends after its letters
    mark = np.flatnonzero(data == 39)
    mark = mark[fresh[mark]]
    text_end = off[np.searchsorted(off, mark, side="right")]
    done = np.zeros(len(mark), bool)
    for tail in CONTRACTIONS:
        hit = ~done & (mark + len(tail) < text_end) & np.logical_and.reduce([data[np.minimum(mark + 1 + i, n - 1)] == c for i, c in enumerate(tail)])
        done |= hit
        fresh[mark[hit] + 1] = False
        fresh[mark[hit] + 1 + len(tail)] = True
    bounds = np.flatnonzero(fresh)
    solid = what[bounds[:-1]] != SPACE
    return data[what != SPACE], np.diff(bounds)[solid], np.searchsorted(bounds[:-1][solid], off)


def split_texts(v: Vocabulary, column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All words of the texts in order, and the pointers of each text."""
    raw, off = W.text_buffer(column)
    lead = np.flatnonzero(raw >= 0xC0)  # ASCII always has tables
    point = (raw[lead].astype(np.int64) & 0x1F) << 6 | raw[np.minimum(lead + 1, max(len(raw) - 1, 0))] & 0x3F
    bad = lead[(raw[lead] >= 0xC0 + (TABLE >> 6)) | v.tables[2][np.minimum(point, TABLE - 1)]]
    slow = np.zeros(len(off) - 1, bool)
    slow[np.searchsorted(off, bad, side="right") - 1] = True
    for token in v.special:
        slow |= pc.match_substring(pc.fill_null(column, ""), token).to_numpy(zero_copy_only=False)
    sizes = np.where(slow, 0, np.diff(off))
    flat, size, ptr = _table_words(v, raw[np.repeat(~slow, np.diff(off))] if slow.any() else raw, np.concatenate([[0], np.cumsum(sizes)]))
    counts = np.diff(ptr)
    if slow.any():
        lists = {int(i): v.library_words(column[int(i)].as_py()) for i in np.flatnonzero(slow)}
        parts, sizes, at = [], [], np.concatenate([[0], np.cumsum(size)])
        for i in range(len(counts)):  # in order of texts
            if i in lists:
                parts.append(np.frombuffer(b"".join(lists[i]), np.uint8))
                sizes.append(np.array([len(w) for w in lists[i]], np.int64))
                counts[i] = len(lists[i])
            else:
                a, z = ptr[i], ptr[i + 1]
                parts.append(flat[at[a] : at[z]])
                sizes.append(size[a:z])
        flat, size = np.concatenate(parts), np.concatenate(sizes)
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(flat))])
    return array, np.concatenate([[0], np.cumsum(counts)])


def word_counts(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``(word, n)``: how often each word of at most ``LONGEST`` bytes stands in
    all texts. Tasks sum what they read first."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, held, size = vocabulary(path), [], 0

        def total() -> pa.RecordBatch:
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.table({"word": t["word"].cast(pa.binary()), "n": t["n_sum"]}).combine_chunks()

        for b in W.pieces(batches, "t", BATCH_BYTES):
            found = split_texts(v, b.column("t"))[0].value_counts()
            word, n = found.field("values"), found.field("counts")
            short = pc.less_equal(pc.binary_length(word), LONGEST)
            held.append(pa.table({"word": word.filter(short).cast(pa.binary()), "n": n.filter(short)}))
            size += len(held[-1])
            if size > HELD:
                held = [total()]
                size = len(held[0])
                if size > HELD // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from total().to_batches()

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compiled(entries: Iterable[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of words (any order, no repeats, not empty),
    as arrays: edges sorted by state and byte with target and words before, the
    final states, and by word number the ids."""
    entries = sorted(entries)
    known: dict[tuple, int] = {}
    states: list[tuple] = []  # of each settled state: final, edges
    path: list[list] = [[False, []]]  # of the last word: final, edges settled so far

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    last = b""
    for word, _ in entries:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for k in range(len(last), same, -1):
            node = path.pop()
            path[-1][1].append((last[k - 1], settle(node)))
        path += [[False, []] for _ in range(same, len(word))]
        path[-1][0] = True
        last = word
    for k in range(len(last), 0, -1):
        node = path.pop()
        path[-1][1].append((last[k - 1], settle(node)))
    root = settle(path[0])
    size: list[int] = []  # words behind each state; targets settle before their sources
    key, target, skip = [], [], []
    for s, (final, edges) in enumerate(states):
        n = int(final)
        for label, t in edges:
            key.append(s << 8 | label)
            target.append(t)
            skip.append(n)
            n += size[t]
        size.append(n)
    ids = [x for _, x in entries]
    return {
        "key": np.array(key, np.int64),
        "target": np.array(target, np.int32),
        "skip": np.array(skip, np.int32),
        "final": np.array([final for final, _ in states], bool),
        "root": np.array([root], np.int64),
        "first": np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64),
        "ids": np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids))),
    }


def numbers(auto: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The number of each word, -1 if the automaton doesn't hold it."""
    out = np.full(len(starts), -1, np.int64)
    key, live = auto["key"], np.flatnonzero((size > 0) & (size <= LONGEST))
    if not len(key):
        return out
    state, total = np.full(len(live), auto["root"][0]), np.zeros(len(live), np.int64)
    k = 0
    while len(live):
        want = state << 8 | data[starts[live] + k]
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[at] == want
        live, at = live[hit], at[hit]
        state, total = auto["target"][at].astype(np.int64), total[hit] + auto["skip"][at]
        k += 1
        ended = size[live] == k
        right = ended & auto["final"][state]
        out[live[right]] = total[right]
        live, state, total = live[~ended], state[~ended], total[~ended]
    return out


def lexicon(docs: DataFrame, path: str | None = None, text_col: str = "text", words: int = WORDS) -> dict[str, np.ndarray]:
    """The transducer of the ``words`` most frequent words, ties by byte order:
    a bounded list, whatever the corpus. Which words it holds changes no result."""
    path = path or default_vocabulary()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            yield pa.record_batch([b.column("word"), pa.array([v.merged(w) for w in b.column("word").to_pylist()], pa.list_(pa.int32()))], ["word", "ids"])

    top = word_counts(docs, path, text_col).where("substring(word, 1, 1) <> X'FF'").orderBy(F.desc("n"), "word").limit(words).select("word")
    found = top.repartition(16, "word").mapInArrow(merged, "word binary, ids array<int>").toArrow()
    return compiled(zip(found.column("word").to_pylist(), found.column("ids").to_pylist(), strict=True))


def coded_batches(v: Vocabulary, lex: dict[str, np.ndarray], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, ids, decoded) of batches (i, t), ``BATCH_BYTES`` of text at a time."""
    tokens = pa.array(v.tokens, pa.large_string())
    kept: dict[bytes, list[int]] = {}
    for b in W.pieces(batches, "t", BATCH_BYTES):
        words, ptr = split_texts(v, b.column("t"))
        coded = words.dictionary_encode()
        distinct, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        off = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1] if len(distinct) else np.zeros(1, np.int64)
        data = np.frombuffer(distinct.buffers()[2], np.uint8) if len(distinct) else np.zeros(0, np.uint8)
        number = numbers(lex, data, off[:-1], np.diff(off))
        seen = number >= 0
        first, count = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        first[seen], count[seen] = lex["first"][number[seen]], lex["first"][number[seen] + 1] - lex["first"][number[seen]]
        more: list[list[int]] = []
        for i in np.flatnonzero(~seen):
            w = distinct[int(i)].as_py()
            ids = [v.special[w[1:].decode()]] if w[0] == 0xFF else kept.get(w) or v.merged(w)
            if len(w) <= LONGEST:
                if len(kept) >= REMEMBERED:
                    kept.clear()
                kept[w] = ids
            more.append(ids)
        count[~seen] = [len(x) for x in more]
        first[~seen] = len(lex["ids"]) + np.cumsum(count[~seen]) - count[~seen]
        flat = np.concatenate([lex["ids"], np.fromiter(chain.from_iterable(more), np.int32, sum(map(len, more)))])
        ids = flat[gathered(first[code], count[code])]
        bounds = np.concatenate([[0], np.cumsum(count[code])])[ptr]
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
        text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), tokens.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))
        yield pa.record_batch([b.column("i"), lists, text.cast(pa.string())], ["i", "ids", "decoded"])


def encoded(docs: DataFrame, auto: dict[str, np.ndarray] | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids, decoded)`` per row of ``docs``: the ids of the whole text,
    and the text that they decode to.

    Null texts are empty: no ids. The strings of special tokens are those
    tokens, as the library takes them. Repeated and null ids are rows of their
    own; other columns are not read; an empty table gives an empty result. The
    vocabulary has to be readable on every executor."""
    path = path or default_vocabulary()
    auto = lexicon(docs, path, text_col) if auto is None else auto
    shared = docs.sparkSession.sparkContext.broadcast(auto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from coded_batches(vocabulary(path), mapped(shared.value), batches)

    frame = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return frame.mapInArrow(run, f"i {frame.schema['i'].dataType.simpleString()}, ids array<int>, decoded string").withColumnRenamed("i", id_col)


def decoded(ids: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``ids`` with a column ``decoded``; null id lists give null. An id that the
    vocabulary lacks is left out, as the library does. DataFrame functions alone
    but for the token table, which is a literal map of the vocabulary's size."""
    v = vocabulary(path or default_vocabulary())
    spark: SparkSession = ids.sparkSession
    names = spark.createDataFrame([(v.tokens,)], "_tokens array<string>")
    rows = ids.drop("decoded").crossJoin(F.broadcast(names))
    text = F.array_join(F.transform(F.filter(ids_col, lambda i: (i >= 0) & (i < len(v.tokens))), lambda i: F.col("_tokens")[i]), " ")
    return rows.withColumn("decoded", F.when(F.col(ids_col).isNotNull(), text)).drop("_tokens")
