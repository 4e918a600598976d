import hashlib

import numpy as np
import pyarrow as pa
import pytest

from lienwise.llm import recompression


def brute(rows, window):
    first = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").encode().split()
            for a in range(len(w) - window + 1):
                k = tuple(w[a : a + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        if i is not None:
            for a in range(len(w) - window + 1):
                if first[tuple(w[a : a + window])] < i:
                    keep[a : a + window] = [False] * window
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(x for x, k in zip(w, keep) if k)).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


def test_odd_documents(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert result(recompression.repeated_passages(odd_docs)[0]) == brute(rows, 50)


@pytest.mark.parametrize(("seed", "frequent"), [(0, 1), (1, 8), (2, 1 << 11)])
def test_random_repeats(spark, seed, frequent, monkeypatch):
    """With no, some and all repeated anchors on the list of frequent ones."""
    monkeypatch.setattr(recompression, "FREQUENT", frequent)
    rng = np.random.default_rng(seed)
    pool = [" ".join(rng.choice(list("abcdef"), int(n))) for n in rng.integers(5, 40, 8)]
    rows = [(int(i), " ".join(rng.choice(pool, int(rng.integers(0, 6))))) for i in range(60)]
    rows += [(70, "a " * 80), (71, "a " * 60 + "b"), (70, "c d " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(recompression.repeated_passages(df, 12)[0]) == brute(rows, 12)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(7)
    core = rng.integers(0, 9, 60).astype(np.uint64) + np.uint64(100)
    a = np.concatenate([rng.integers(0, 9, 33).astype(np.uint64) + np.uint64(100), core])
    both = np.concatenate([a, core])
    starts, names = recompression.anchors(both, np.array([0, len(a), len(both)]), 50)
    one = {int(s): int(n) for s, n in zip(starts, names)}
    assert [one[33 + k] for k in range(11)] == [one[93 + k] for k in range(11)]


def test_texts_are_rewritten(odd_docs, no_docs):
    out = recompression.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    before = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] is not None}
    assert texts[2] == "" and texts[1] == before[1] and texts[4] is None and texts[10] == before[10]
    assert len(texts[9].split()) == len(before[9].split()) - 70
    assert recompression.without_repeats(no_docs).collect() == [] and recompression.repeated_passages(no_docs)[0].collect() == []


def test_a_passage_of_many_texts_makes_no_row_a_window(spark, monkeypatch):
    monkeypatch.setattr(recompression, "FREQUENT", 8)
    rng = np.random.default_rng(4)
    passage = " ".join(rng.choice(list("abcdef"), 300))
    rows = [(i, f"x{i} {passage} y{i} " + " ".join(rng.choice(list("abcdef"), 20))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    made, write = {}, recompression.written
    monkeypatch.setattr(recompression, "written", lambda frame, name: made.setdefault(name, write(frame, name)))
    want = brute(rows, 50)
    assert result(recompression.repeated_passages(df)[0]) == want
    assert max(t.count() for t in made.values()) < 5 * len(rows)
    made.clear()
    monkeypatch.setattr(recompression, "BROADCAST_IDS", 0)  # the list is too long to be held
    assert result(recompression.repeated_passages(df)[0]) == want


def test_windows_that_agree_in_one_hash_alone():
    held = pa.table({"a": [5, 5, 5, 9], "b": pa.array([1, 2, 3, 1], pa.int32()), "low": [3, 1, 9, 0]})
    piece = pa.record_batch([pa.array([2, 4]), pa.array(["", ""])], ["i", "t"])
    a, b, doc, tag = np.array([5, 5, 5, 5, 9, 7]), np.array([3, 2, 1, 4, 1, 1], np.int32), np.array([0, 0, 0, 1, 1, 1]), np.arange(6)
    out = recompression._covered(piece, a, b, doc, tag, *(held[c].to_numpy() for c in ("a", "b", "low")))
    assert out.to_pylist() == [{"i": 2, "bits": 0, "tags": [1]}, {"i": 4, "bits": 0, "tags": [4]}]
