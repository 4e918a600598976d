"""Sequence packing by minimum bin slack over a histogram of piece lengths.

Documents are cut at every ``width`` tokens; what is left of each is shorter
than a window. The lengths of all pieces form a histogram of at most ``width``
rows, which is all that the driver sees. It repeats: take the longest length
left, find by a subset-sum dynamic programme over bit sets which multiset of
the remaining lengths fills the window closest to its capacity, backtrack the
counts of that multiset, and use it as often as the counts last. Spark numbers
the pieces of each length and looks their places up in the plan.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .storage import written

END_ID = 0
#: What the JSON form of the vocabulary takes for one token wherever it stands.
SPECIAL = {"<|endoftext|>": 50256}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_json() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_ENCODINGS: dict = {}


def encoding(path: str):
    """The byte-level BPE of a rank file. Its ids are those of the JSON form of
    the same vocabulary, the special token in a text included (tests hold the
    two together); this library encodes about four times as many bytes a second."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODINGS[path]


def token_ids(text: str, ranks: str, json: str) -> np.ndarray:
    """The ids of a text. The fast library's pattern gives up on white space of
    about a million characters in a row; such a text goes to the JSON form."""
    try:
        return encoding(ranks).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        if json not in _ENCODINGS:
            from tokenizers import Tokenizer

            _ENCODINGS[json] = Tokenizer.from_file(json)
        return np.array(_ENCODINGS[json].encode(text, add_special_tokens=False).ids, np.uint32)


def token_pieces(docs: DataFrame, width: int = 1024, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary_json: str | None = None) -> DataFrame:
    """``(id_col, start, length, ids_crc32, doc_tokens)``: each document's ids
    and a closing id 0, cut every ``width`` ids. Null texts are empty: one piece
    of one id; texts of any length and any run of one character are encoded
    whole. The two forms of the vocabulary (ranks and JSON) have to be readable
    on every executor."""
    path, json = vocabulary or default_vocabulary(), vocabulary_json or default_json()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "t"):
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(b.column("t").to_pylist()):
                ids = np.append(token_ids(text or "", path, json), np.uint32(END_ID)).astype("<u4")
                raw = memoryview(ids).cast("B")
                for a in range(0, len(ids), width):
                    z = min(a + width, len(ids))
                    row.append(i)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * z]))
                    total.append(len(ids))
            yield pa.record_batch([b.column("i").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["i", "start", "length", "ids_crc32", "doc_tokens"])

    frame = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return frame.mapInArrow(run, f"i {frame.schema['i'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long").withColumnRenamed("i", id_col)


def fill(counts: dict[int, int], longest: int, width: int) -> dict[int, int]:
    """The multiset with ``longest`` that fills ``width`` closest: a subset-sum
    over bit sets, lengths in falling order, each up to its count. A total that
    is a power of two needs no padding, so it counts as full."""
    room = width - longest
    left = counts | {longest: counts[longest] - 1}
    reach, steps, limit = 1, [], (1 << room + 1) - 1
    for length in sorted((x for x, n in left.items() if n and x <= room), reverse=True):
        steps.append((length, reach))
        n = min(left[length], room // length)
        k = 1
        while n:
            k = min(k, n)
            reach |= reach << k * length & limit
            n -= k
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    if total < room:
        powers = [p - longest for p in (1 << i for i in range(width.bit_length())) if 0 <= p - longest <= room and reach >> p - longest & 1]
        total = max(powers, default=total)
    used = {longest: 1}
    for length, before in reversed(steps):
        while not before >> total & 1:
            used[length] = used.get(length, 0) + 1
            total -= length
    return used


def slack_plan(histogram: dict[int, int], width: int) -> np.ndarray:
    """Rows (length, first index, end index, copies a sequence, first sequence,
    offset), by length and index: where the pieces of a length, numbered from 0,
    go. A few rows for each of the at most ``width`` lengths."""
    counts = {k: n for k, n in histogram.items() if n}
    used, rows, sequence = dict.fromkeys(counts, 0), [], 0
    while counts:
        longest = max(counts)
        chosen = fill(counts, longest, width)
        times = min(counts[x] // n for x, n in chosen.items())
        offset = 0
        for x in sorted(chosen, reverse=True):
            n = chosen[x]
            rows.append((x, used[x], used[x] + n * times, n, sequence, offset))
            used[x] += n * times
            offset += n * x
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, width: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with new sequence_id and offset: every piece lies in one sequence
    of at most ``width`` tokens, offsets run from 0 without gaps. Extra columns
    stay; an empty table gives an empty result; repeated rows are pieces of
    their own. Lengths outside 1 to ``width`` are an error."""
    pieces = written(pieces.drop("sequence_id", "offset"), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(x is None or not 1 <= x <= width for x in histogram):
        raise ValueError(f"a piece's length is outside 1 to {width}")
    plan = slack_plan(histogram, width)
    stride = np.int64(1) << np.int64(44)
    start_key = plan[:, 0] * stride + plan[:, 1]
    own = "_"  # begins the names of columns that no caller has
    while any(c.startswith(own) for c in pieces.columns):
        own += "_"
    # the pieces of one length are numbered over many small groups, so a length that most pieces have is no single task
    parts = 16 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = pieces.withColumn(own + "part", F.pmod(F.xxhash64(id_col, "start"), F.lit(parts)))
    sizes = held.groupBy("length", own + "part").agg(F.count(F.lit(1)).alias(own + "n"))
    before = sizes.withColumn(own + "before", F.coalesce(F.sum(own + "n").over(Window.partitionBy("length").orderBy(own + "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(own + "n")
    ranked = held.withColumn(own + "rank", F.row_number().over(Window.partitionBy("length", own + "part").orderBy(id_col, "start")) - 1)
    numbered = ranked.join(before, ["length", own + "part"]).withColumn(own + "index", F.col(own + "before") + F.col(own + "rank")).select(*pieces.columns, own + "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, index = (b.column(c).to_numpy().astype(np.int64) for c in ("length", own + "index"))
            row = plan[np.searchsorted(start_key, length * stride + index, side="right") - 1] if len(index) else plan[:0]
            at = index - row[:, 1]
            sequence, offset = row[:, 4] + at // np.maximum(row[:, 3], 1), row[:, 5] + at % np.maximum(row[:, 3], 1) * length
            yield pa.record_batch([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")
