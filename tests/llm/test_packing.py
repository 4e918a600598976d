import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lienwise.llm import packing


def json_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "Hello world's  end\n\n\t x", "ünï 漢字 🙂🙂", "a" * 5000, "12345 67,89", "  z", "<|endoftext|> it's we'll'd", "\x00\x1c ok", "é ​!?"]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_those_of_the_json_form(text):
    assert packing.encoding(packing.default_vocabulary()).encode_to_numpy(text, disallowed_special=()).tolist() == json_ids(text)


def default_ids(text):
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


MARKED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", " <|endoftext|>\n\n z", "<|endoftext|", "it's<|ENDOFTEXT|> <|endoftext|>'s"]


@pytest.mark.parametrize("text", [*ODD, *MARKED])
def test_special_token_in_a_text_is_one_id(spark, text):
    ids = np.array([*default_ids(text), 0], "<u4")
    (row,) = packing.token_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), width=1 << 20).collect()
    assert (row["length"], row["doc_tokens"], row["ids_crc32"]) == (len(ids), len(ids), zlib.crc32(ids.tobytes()))


LONG = [" " * 2_000_000, "x" + "\n" * 1_200_000 + " y", "a" * 1_000_000, "ab \t\n" * 100_000]


@pytest.mark.parametrize("text", LONG)
def test_ids_of_very_long_runs(text):
    assert packing.token_ids(text, packing.default_vocabulary(), packing.default_json()).tolist() == default_ids(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(list(" \t\n\r\xa0aZ1é!'漢") + ["<|endoftext|>", "'s"]), st.integers(1, 400)), max_size=5))
def test_ids_agree_on_long_runs(runs):
    text = "".join(c * n for c, n in runs)
    assert packing.token_ids(text, packing.default_vocabulary(), packing.default_json()).tolist() == default_ids(text)


def test_contract_of_the_query(odd_docs):
    width = 64
    rows = packing.pack(packing.token_pieces(odd_docs, width), width).collect()
    ids = defaultdict(list)
    for r in odd_docs.collect():
        ids[r["doc_id"]].append(np.array([*default_ids(r["text"] or ""), 0], "<u4"))
    for r in rows:  # every column against the ids of its own document
        own = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert own and r["ids_crc32"] in {zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) for x in own}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for (doc, tokens), parts in pieces.items():
        copies = sum(len(x) == tokens for x in ids[doc])
        cover = np.zeros(tokens, int)
        for start, length in parts:
            cover[start : start + length] += 1
        assert (cover == copies).all()
    assert sorted(windows) == list(range(len(windows)))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    padding = sum(width - sum(n for _, n in p) for p in windows.values())
    assert padding < 0.02 * width * len(windows) + width


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_ids_agree_on_any_text(text):
    assert packing.encoding(packing.default_vocabulary()).encode_to_numpy(text, disallowed_special=()).tolist() == json_ids(text)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
def test_plan_places_every_piece_once(histogram):
    plan = packing.slack_plan(histogram, 64)
    windows = defaultdict(list)
    for length, a, z, n, sequence, offset in plan.tolist():
        for i in range(z - a):
            windows[sequence + i // n].append((offset + i % n * length, length))
    assert sorted(windows) == list(range(len(windows)))
    placed = defaultdict(int)
    for rows in windows.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
            placed[length] += 1
        assert at <= 64
    assert dict(placed) == histogram


def test_fill_is_closest_to_capacity():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 33, 6)}
        longest = max(counts)
        used = packing.fill(counts, longest, 32)
        sums = {longest}
        for x, n in counts.items():
            for _ in range(n - (x == longest)):
                sums |= {s + x for s in sums if s + x <= 32}
        total = sum(x * n for x, n in used.items())
        assert all(n <= counts[x] for x, n in used.items())
        assert total in sums and (total == max(sums) or max(sums) < 32 and total & (total - 1) == 0)


def test_odd_documents(odd_docs, no_docs):
    pieces = packing.token_pieces(odd_docs)
    rows = packing.pack(pieces).collect()
    want = sorted((str(r["doc_id"]), len(json_ids(r["text"] or "")) + 1) for r in odd_docs.collect())
    got = defaultdict(int)
    for r in rows:
        if r["start"] == 0:
            got[str(r["doc_id"]), r["doc_tokens"]] += 1
    assert sorted(k for k, n in got.items() for _ in range(n)) == want
    assert sum(r["length"] for r in rows) == sum(n for _, n in want)
    ids = np.array([*json_ids("two words"), 0], "<u4")
    assert next(r["ids_crc32"] for r in rows if r["doc_id"] == 7) == zlib.crc32(ids.tobytes())
    assert packing.pack(packing.token_pieces(no_docs)).collect() == []
    with pytest.raises(ValueError):
        packing.pack(pieces, width=8)


def test_extra_columns_may_have_any_name(spark):
    rows = [(i, 0, 1 + i % 9, "p", "x", 7, "r", "b", "n") for i in range(60)]
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, _part string, _index string, _rank int, _before string, _n string, __part string")
    out = packing.pack(pieces, 16)
    assert out.columns == [*pieces.columns, "sequence_id", "offset"]
    assert sorted(map(tuple, out.select(pieces.columns).collect())) == sorted(map(tuple, rows))
