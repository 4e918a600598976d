import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lienwise.llm import alignment as A
from lienwise.llm import queries

ODD = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "你好", "<s>", "<unk>", "</s>", "<|endoftext|>", "the", "The ", ".", "1", "23", "\0", "\x1f", "\u0085", " ", " ", "　", "é", "😀", "ﬁ", "<0x41>", " 's", "ü "]


def strange(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def brute(rows):
    """Token by token, texts encoded whole by the two libraries."""
    p = A.tokenizers(A.default_paths())
    found = []
    for doc_id, text in rows:
        a = p.exact.encode(" " + text, add_special_tokens=False).ids if text else []
        b = p.model.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(p.bytes_a[x] for x in a) != raw or b"".join(p.bytes_b[x] for x in b) != raw:
            a = b = []
        ends = []
        for ids, table in ((a, p.bytes_a), (b, p.bytes_b)):
            at, out = 0, []
            for x in ids:
                at += len(table[x])
                out.append((at, x))
            ends.append(out)
        both = {e for e, _ in ends[0]} & {e for e, _ in ends[1]}
        groups, links, k = [], [], 0
        left = []
        for e, x in ends[0]:
            left.append(x)
            if e in both:
                right = []
                while not right or ends[1][k - 1][0] < e:
                    right.append(ends[1][k][1])
                    k += 1
                groups.append((left, right))
                links.append((x, right[-1]))
                left = []
        found.append((doc_id, a, b, groups, links))
    count = Counter(pair for *_, links in found for pair in links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    text = lambda g: ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
    return sorted((repr(d), len(a), len(b), len(g), len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), text(g)) for d, a, b, g, ls in found)


def result(df):
    return sorted((repr(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in df.collect())


def test_pieces_are_encoded_as_whole_texts():
    p = A.tokenizers(A.default_paths())
    assert p.local
    for text in strange(1, 1500):
        coded, _, _ = A.spaced_pieces(pa.array([text]))
        pieces = [coded.dictionary[i].as_py() for i in coded.indices.to_pylist()]
        assert "".join(pieces) == " " + text
        assert [x for q in pieces for x in p.encode_a(q)] == p.exact.encode(" " + text, add_special_tokens=False).ids
        assert [x for ids in p.encode_b(pieces) for x in ids] == p.model.encode(text)


def test_expansion_gives_all_pairs_of_a_group():
    left, right = A.expanded(np.array([0, 0, 1, 3]), np.array([0, 1, 1, 2, 3, 3]), 4)
    assert list(zip(left.tolist(), right.tolist())) == [(0, 0), (1, 0), (2, 1), (2, 2), (3, 4), (3, 5)]


@pytest.mark.parametrize("listed", [0, 40, 1 << 20])
def test_equals_brute_force(spark, odd_docs, listed):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(100 + i, t) for i, t in enumerate([*strange(2, 200), " ", "▁", "a ▁b", "\n" * 50])]
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, row int, links string").repartition(5)
    assert result(A.link_figures(docs, listed=listed)) == brute(rows)


def test_empty_table(spark, no_docs):
    assert A.link_figures(no_docs).count() == 0


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    got = sorted((repr(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in queries.op11_cross_tokenizer(spark, sf).collect())
    assert got == [(*x[:7], sha(x[7])) for x in brute(rows)]
