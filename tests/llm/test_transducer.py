import hashlib
import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lienwise.llm import queries
from lienwise.llm import transducer as T

ODD = ["a", "B", " ", "\n", "'s", "'", "'LL", "'re", "''", "é", "É", "ß", "İ", "Σ", "ΟΔΟΣ", "你好", "<|startoftext|>", "<|endoftext|>", "<|", "the", "1", "23", "\0", "\x1f", "\u0085", " ", "é", "😀", "ﬁ", "_", "...", "²", "½", "ǅ", "Ⱥ", "ª", "µ", "river", "mountain"]


def strange(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(T.default_vocabulary())


def brute(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((repr(doc_id), ids, library.decode(ids, skip_special_tokens=False)))
    return sorted(out)


def test_merges_equal_the_library(library):
    v = T.vocabulary(T.default_vocabulary())
    rng = random.Random(5)
    for _ in range(1500):
        word = "".join(rng.choice("abeinorstlè'") for _ in range(rng.choice([1, 2, 5, 12, 40])))
        if "'" not in word:
            assert v.merged(word.encode()) == library.encode(word, add_special_tokens=False).ids
    word = "aab" * 40_000
    assert v.merged(word.encode()) == library.encode(word, add_special_tokens=False).ids


def test_splitting_equals_the_library(library):
    v = T.vocabulary(T.default_vocabulary())
    low = [chr(c) for c in range(T.TABLE + 64)]
    texts = [*strange(3, 800), "", *[a + c + b for c in low for a, b in (("", ""), ("x", "y"), ("'", "s"), ("1", "."))]]
    words, ptr = T.split_texts(v, pa.array(texts))
    for i, text in enumerate(texts):
        ids = [x for w in words[ptr[i] : ptr[i + 1]].to_pylist() for x in ([v.special[w[1:].decode()]] if w[0] == 0xFF else v.merged(w))]
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({w.encode() for w in ["tap", "taps", "top", "tops", "stop", "stops", "a", "as", "é"]})
    auto = T.compiled([(w, [i]) for i, w in enumerate(words)])
    raw = np.frombuffer(b"".join(words) + b"tastoxtopsy", np.uint8)
    size = np.array([*map(len, words), 2, 3, 1, 5])
    found = T.numbers(auto, raw, np.cumsum(size) - size, size)
    assert found.tolist() == [*range(len(words)), -1, -1, -1, -1]
    tails = lambda lang: {frozenset(w[len(p) :] for w in lang if w.startswith(p)) for w in lang for p in (w[:k] for k in range(len(w) + 1))}
    assert len(auto["final"]) == len(tails(words))  # a state for each different set of continuations


@pytest.mark.parametrize("words", [0, 60, T.WORDS])
def test_equals_the_library(spark, library, odd_docs, words):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(100 + i, t) for i, t in enumerate(strange(4, 300))]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    out = T.encoded(docs, T.lexicon(docs, words=words))
    got = out.collect()
    assert sorted((repr(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == brute(library, rows)
    again = T.decoded(out.withColumnRenamed("decoded", "first")).where("decoded <> first or decoded is null")
    assert again.count() == 0


def test_counts_cover_all_words(spark, odd_docs):
    got = {bytes(r["word"]).decode(): r["n"] for r in T.word_counts(odd_docs.where("doc_id = 10")).collect()}
    assert got == {"a": 200}


def test_empty_table(spark, no_docs):
    assert T.encoded(no_docs).count() == 0


def test_query_on_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_transducer_bpe(spark, sf).collect())
    assert got == [(d, len(ids), sha(" ".join(map(str, ids))), sha(text)) for d, ids, text in brute(library, rows)]


def test_a_batch_of_much_text_takes_little_memory():
    script = """
import random, resource
import pyarrow as pa
from lienwise.llm import transducer as T
v, rng = T.vocabulary(T.default_vocabulary()), random.Random(0)
lex = T.compiled([(w, v.merged(w)) for w in (b"stone", b"river")])
text = lambda n: " ".join(rng.choice(("stone", "river", "the")) + str(rng.randrange(1000)) for _ in range(n))
batch = lambda n, k: pa.record_batch([pa.array(range(k)), pa.array([text(n) for _ in range(k)])], ["i", "t"])
small, large = batch(50, 10), batch(200, 8000)
list(T.coded_batches(v, lex, [small]))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for _ in T.coded_batches(v, lex, [large]):
    pass
print(large.nbytes >> 20, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before >> 10)
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    size, peak = map(int, out.stdout.split())
    assert size >= 12 and peak < 120, peak
