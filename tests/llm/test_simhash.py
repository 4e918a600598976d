import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lienwise.llm import components as module
from lienwise.llm import simhash
from lienwise.llm.components import components


def brute_fp(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    hs = [xxhash.xxh64_intdigest(" ".join(w[a : a + 3]).encode(), 42) for a in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps: dict, budget: int) -> dict:
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_odd_documents_match_brute_force(spark, odd_docs):
    rows = {(r["doc_id"]): r["text"] for r in odd_docs.collect() if r["doc_id"] is not None}
    want_fp = {i: brute_fp(t) for i, t in rows.items()}
    want = brute_groups(want_fp, 3)
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == 12 and got[0].asDict().keys() == {"doc_id", "fp", "component_id"}
    assert {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in got} == {i: (want_fp[i], want[i]) for i in rows}
    assert want[3] == 1 and want[5] == want[4] == 4


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.one_of_each(no_docs).columns == no_docs.columns


@pytest.mark.parametrize("leaf", [1, 16, 1024])
def test_trie_finds_exactly_the_close_pairs(leaf, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = np.random.default_rng(5)
    fp = np.unique(rng.integers(0, 2**10, 300, dtype=np.uint64) << np.uint64(30) | rng.integers(0, 8, 300, dtype=np.uint64))
    found = [(int(i), int(j)) for a, b in simhash.trie_links(fp, np.zeros(len(fp), int), 3) for i, j in zip(a, b)]
    want = [(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 3]
    assert sorted((min(p), max(p)) for p in found) == want


def test_dense_groups_and_cut_tries_lose_no_link(spark):
    rng = np.random.default_rng(3)
    fps = []
    for _ in range(6):
        f = int(rng.integers(0, 2**63))
        for _ in range(60):  # chains of few-bit steps
            f ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False))
            fps.append(f % 2**64)
    fps = sorted(set(fps))
    want = brute_groups({f: f for f in fps}, 3)
    rows = spark.createDataFrame([(0, f - 2**64 if f >= 2**63 else f) for f in fps], "table int, fp long").withColumn("node", F.col("fp"))
    for hot in (4096, 5):
        links = simhash.fingerprint_links(rows, 3, hot)
        assert links.count() < 16 * len(fps)
        got = {r["node"] % 2**64: r["root"] % 2**64 for r in components(links).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(got.get(f, f), set()).add(f)
        expected = {}
        for f in fps:
            expected.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(5, 5), (None, 3), (100, 101)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_components_in_one_block_equal_those_of_rounds(spark, monkeypatch):
    """Few edges take two tables, not one a round."""
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(-60, 60)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (250, 2))] + [(7, 7), (9000, 9000), (-(2**63), 2**62)]
    rows, made, put = spark.createDataFrame(edges, "a long, b long"), [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: made.append(name) or put(df, name))
    ask = lambda: sorted(tuple(r) for r in components(rows).collect())
    got, few = ask(), len(made)
    monkeypatch.setattr(module, "BLOCK_EDGES", 0)
    assert ask() == got and few == 2 < len(made) - few
    assert dict(got)[9000] == 9000 and dict(got)[2**62] == -(2**63)


def test_one_of_each_keeps_clean_documents(odd_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 4, 7, 8, 9, 10, 11, None]


def shingle_set(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()


def test_groups_are_those_of_exact_shingle_similarity(spark):
    rng, docs = np.random.default_rng(8), []
    for g in range(60):  # one run of words replaced, so that similarity lies around 0.8
        words = [f"w{x}" for x in rng.integers(0, 4000, 150)]
        docs.append(" ".join(words))
        for n in (8, 11, 13, 16, 20, 26):
            at = int(rng.integers(0, 150 - n))
            docs.append(" ".join(words[:at] + [f"v{x}" for x in rng.integers(0, 4000, n)] + words[at + n :]))
        docs.append(" ".join(words[:40] + "so it goes on and on ".split() * (20 + g)))
        docs.append(" ".join(words[75:115] + "so it goes on and on ".split() * (20 + g)))
    sets = [shingle_set(x) for x in docs]
    root = list(range(len(docs)))
    for j in range(len(docs)):
        for i in range(j - j % 9, j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = simhash.similar_documents(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(root))


def test_equal_fingerprints_are_walked_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    blocks = [len(i) for i, _ in simhash.trie_links(np.zeros(1000, np.uint64), np.zeros(1000, int), 3)]
    assert sum(blocks) == 1000 * 999 // 2 and max(blocks) <= 1000


def near_copies(rng, base, n, most=12):
    """Texts with up to ``most`` single words of ``base`` replaced by new ones."""
    out = []
    for c in range(n):
        words = list(base)
        for at in rng.choice(len(base), int(rng.integers(0, most + 1)), replace=False):
            words[at] = f"n{c}x{at}x{rng.integers(1 << 40)}"
        out.append(" ".join(words))
    return out


def exact_groups(docs, similarity=0.8):
    sets, root = [shingle_set(x) for x in docs], list(range(len(docs)))
    for j in range(len(docs)):
        for i in range(j):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return dict(enumerate(root))


@pytest.mark.parametrize("families", [1, 2])
def test_checked_pairs_follow_the_number_of_near_copies(spark, monkeypatch, families):
    """Near copies of one text (or of two that are 0.75 alike), most of them
    less than 0.8 alike: few pairs are checked, no link is lost."""
    rng, check, found = np.random.default_rng(3), simhash._verified, []
    base = [f"w{x}" for x in range(150)]
    other = base[:131] + [f"o{x}" for x in range(19)]
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *more: found.append(pairs.count()) or check(pairs, *more))
    for n in (80, 240):
        docs = [x for b in (base, other)[:families] for x in near_copies(rng, b, n // families)]
        got = simhash.similar_documents(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == exact_groups(docs)
        assert len(found) == 2 and found[1] <= n
        found.clear()
