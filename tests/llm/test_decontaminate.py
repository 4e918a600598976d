import random
from collections import Counter

import numpy as np
import pytest

from lienwise.llm import decontaminate

from .conftest import prose


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute(docs, items, threshold=0.8):
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, x in items:
            iw = (x or "").lower().split()
            s, best = shingles(iw), (0, 0)
            for a in range(len(w) - len(iw) + 1) if iw else ():
                y = shingles(w[a : a + len(iw)])
                c = sum((s & y).values())
                j = c / (sum(s.values()) + sum(y.values()) - c)
                if j > best[0]:
                    best = (j, a)
            if best[0] >= threshold:
                out[d, i] = best
    return out


def test_against_brute_force(spark, odd_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.where("doc_id is not null").collect()]
    base = dict(docs)[1].split()
    edited = base[30:70]
    edited[3] = "changed"
    long = dict(docs)[8].split()
    late = long[29_000:29_300]
    late[100] = late[250] = "changed"
    items = [(9, " ".join(late)), (10, " ".join(long[5:21])), (1, " ".join(base[10:50])), (2, " ".join(edited)), (3, None), (4, ""), (5, "two words"), (6, "nothing here at all matches anything"), (7, " ".join(base[10:50])), (8, "a a a a a a a a")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in decontaminate.contaminated(odd_docs, bench).collect() if r["doc_id"] is not None}
    want = brute(docs, items)
    assert got == want and (8, 9) in want and (9, 2) in want and (7, 5) in want and (1, 1) in want


def test_stage_and_empty_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    kept = decontaminate.without_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.without_contaminated(odd_docs, none).count() == odd_docs.count()
    assert decontaminate.contaminated(no_docs, bench).collect() == []


def test_parts_of_a_large_benchmark(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_BYTES", 60)
    bench = spark.createDataFrame([(1, "two words"), (2, "absent words here"), (3, "two words")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd_docs, bench).collect()) == [(7, 1), (7, 3)]


def fingerprint(h, span, start):
    bits = ((h[start : start + span, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
    return sum(1 << i for i, n in enumerate(bits.tolist()) if 2 * n > span)


@pytest.mark.parametrize("span", [1, 2, 30, 254, 255, 256, 700])
def test_window_fingerprints(span):
    h = np.random.default_rng(span).integers(0, 2**63, 1500, dtype=np.uint64) * np.uint64(2)
    got = decontaminate.window_fingerprints(decontaminate.running_lanes(h), 3, 3 + 120, 7, span)
    assert got.tolist() == [fingerprint(h, span, a) for a in range(3, 123, 7)]


def test_the_index_finds_every_fingerprint_within_the_radius_and_prunes():
    rng, radius = np.random.default_rng(0), 15
    fps = rng.integers(0, 2**63, 40, dtype=np.uint64)
    shape = decontaminate._index(decontaminate.WindowClass(14, 1, 5, np.arange(40), np.zeros(40, int), fps), radius)
    asked = looked = 0
    for n in range(2000):
        fp = int(fps[n % 40])
        for bit in rng.permutation(64)[: n % 18]:
            fp ^= 1 << int(bit)
        held = set()
        for block in range(decontaminate.BLOCKS):
            at = int(shape.first[block][fp >> 16 * block & 0xFFFF])
            while at:
                entry = int(shape.owner[block][at])
                held.add(entry if entry >= 0 else ~entry)
                at = at + 1 if entry >= 0 else 0
        assert {i for i, x in enumerate(fps.tolist()) if (x ^ fp).bit_count() <= radius} <= held
        asked, looked = asked + 40, looked + len(held - {n % 40})
    assert looked < 0.06 * asked  # of unrelated fingerprints


def test_recall_of_edited_passages(spark):
    """Passages edited down to the threshold are found as by brute force."""
    rng, items, docs = random.Random(5), [], []
    for i in range(120):
        words = prose(100 + i, rng.randrange(14, 60)).split()
        items.append((i, " ".join(words)))
        for at in rng.sample(range(len(words)), rng.randrange(0, 2 + len(words) // 40)):
            words[at] = f"edit{i}"
        docs.append((i, prose(900 + i, rng.randrange(0, 50)) + " " + " ".join(words) + " " + prose(600 + i, rng.randrange(0, 50))))
    want = {(i, i) for i in range(120) if (i, i) in brute(docs[i : i + 1], items[i : i + 1])}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 50 and got <= want | {x for x in got if x[0] != x[1]} and len(got & want) >= 0.98 * len(want)
