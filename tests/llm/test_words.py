import numpy as np
import pyarrow as pa

from lienwise.llm import words as W


def test_words_are_those_of_ascii_space_splitting():
    texts = ["a b", None, "", " \t\n\v\f\rX\x1cY ", "ä b  C", "z" * 5]
    w = W.split_words(pa.array(texts), lower=False)
    got = [[bytes(w.data[s:e]) for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.ptr, w.ptr[1:])]
    assert got == [(t or "").encode().split() for t in texts]
    sliced = W.split_words(pa.array(texts).slice(4, 2))
    assert sliced.counts.tolist() == [2, 1]


def test_hashes_do_not_depend_on_place():
    a = W.split_words(pa.array(["one two three"])).hashes()
    b = W.split_words(pa.array(["filler text", "three ONE"])).hashes()
    assert b[3] == a[0] and b[2] == a[2] and len(set(a.tolist())) == 3


def test_majority_against_counting():
    rng = np.random.default_rng(0)
    ptr = np.array([0, 0, 1, 300, 301, 900])
    h = rng.integers(0, 2**63, 900, dtype=np.uint64) * np.uint64(2)
    got = W.majority(h, ptr)[:, 0]
    for i in range(5):
        own = h[ptr[i] : ptr[i + 1]].tolist()
        assert int(got[i]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own))


def test_shingles_of_short_texts():
    w = W.split_words(pa.array(["a b c d", "a b", "", "c d"]))
    h, ptr = W.shingles(w.hashes(), w.ptr, 3)
    assert ptr.tolist() == [0, 2, 3, 3, 4]
    pair, _ = W.shingles(w.hashes(), w.ptr, 2)
    assert h[2] == pair[0 + 3] and h[3] == pair[2]
