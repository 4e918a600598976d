import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lienwise.llm import language_model, queries
from lienwise.llm.eliasfano import EliasFano, encoded, mapped


@pytest.mark.parametrize("top", [5, 1000, 2**40, 2**63])
def test_elias_fano_round_trip(top):
    rng = np.random.default_rng(0)
    for n in (1, 2, 63, 64, 65, 3000):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        ef = EliasFano(mapped(encoded(values, "v")), "v")
        assert np.array_equal(ef.get(np.arange(n)), values)
        ask = np.concatenate([values, rng.integers(0, top, 200, dtype=np.uint64), np.array([0, top], np.uint64)])
        found = ef.find(ask)
        held = set(values.tolist())
        assert all((f >= 0) == (a in held) and (f < 0 or values[f] == a) for a, f in zip(ask.tolist(), found.tolist()))
    assert EliasFano(mapped(encoded(np.zeros(0, np.uint64), "v")), "v").find(np.array([3], np.uint64)).tolist() == [-1]


def words_of(t):
    return [*"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split(), None]


def brute(rows, prior, paired, d, often):
    c, b, t, contexts = (collections.Counter() for _ in range(4))
    for _, text, train in rows:
        if train:
            x = [None, None, *words_of(text)]  # None: start and end
            c.update(x[2:])
            b.update(zip(x[1:], x[2:]))
            t.update(zip(x, x[1:], x[2:]))
            contexts.update(zip(x, x[1:-1]))
    n, v = sum(c.values()), len(c)
    out = []
    for i, text, train in rows:
        x = [None, None, *words_of(text)]
        s = 0.0
        for u, y, w in zip(x, x[1:], x[2:]):
            p1 = (c[w] - d) / n if c[w] else d * max(v, 1) / max(n, 1)
            up = t[u, y, w] + paired * b[y, w] / max(c[y], often) + prior * p1
            s += math.log10(up / (contexts[u, y] + paired * min(c[y], often) / often + prior))
        x = x[2:]
        out.append((i, not train, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), s))
    return sorted(out)


ARGS = (language_model.PRIOR, language_model.PAIRED, language_model.DISCOUNT)


@pytest.mark.parametrize(("shard", "often", "listed"), [(3_000_000, 64, 1 << 20), (2_000, 5, 1 << 20), (40, 5, 1 << 20), (2_000, 1, 100)])
def test_against_brute_force(spark, odd_docs, shard, often, listed, monkeypatch):
    """Whole, and with words, pairs and triples split over shards."""
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 5_000)
    monkeypatch.setattr(language_model, "LISTED", listed)
    rows = [(r["doc_id"], r["text"], r["doc_id"] % 3 != 2) for r in odd_docs.collect() if r["doc_id"] is not None]
    got = sorted(tuple(r) for r in language_model.score_texts(odd_docs, F.col("doc_id") % 3 != 2, shard_tokens=shard, often=often).collect())
    want = brute(rows, *ARGS, max(often, -(-got[0][4] // listed)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and abs(g[6] - w[6]) < 2e-3 * w[2]


def test_many_empty_rows_are_spread_over_shards(spark):
    rows = spark.range(30_000).selectExpr("id doc_id", "if(id % 10 = 0, 'a b', '') text")
    hot = language_model._listed(language_model._counts(rows.selectExpr("doc_id i", "text t", "true train"), []).where("m > 1000"))
    pairs = language_model._listed(language_model._counts(rows.selectExpr("doc_id i", "text t", "true train"), [hot]).where("m > 1000"))
    triples = language_model._listed(language_model._counts(rows.selectExpr("doc_id i", "text t", "true train"), [hot, pairs]).where("m > 1000"))
    end = np.full(100, language_model.END)
    shards = {int(language_model._shard(end, end, end, [hot, pairs, triples], 16, block)[0]) for block in range(64)}
    assert len(shards) > 8
    got = language_model.score_texts(rows, F.lit(True), shard_tokens=4000).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("a"), F.max("score").alias("b")).orderBy("n_tokens").collect()
    assert [r["n"] for r in got] == [27_000, 3000] and all(abs(r["a"] - r["b"]) < 1e-9 for r in got)
    assert got[0]["a"] == pytest.approx(math.log10(0.9), abs=0.01)


def test_held_out_texts_gain_on_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_model.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).groupBy("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).collect()
    for held_out, score, base in got:
        assert score > base + (0.5 if held_out else 2)


def test_no_training_and_empty(spark, odd_docs, no_docs):
    got = language_model.score_texts(odd_docs, F.lit(None).cast("boolean")).collect()
    assert len(got) == 12 and all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)
    assert language_model.score_texts(no_docs, F.lit(True)).collect() == []


def test_probabilities_of_a_context_sum_to_one():
    total, vocabulary, (m, paired, d), often = 10, 3, ARGS, 64
    c, after, after_pair, c_v, c_uv = {"a": 5, "b": 3, "e": 2}, {"a": 2, "b": 3}, {"b": 2}, 5, 2
    below = c_uv + paired * min(c_v, often) / often + m
    known = sum((after_pair.get(w, 0) + paired * after.get(w, 0) / max(c_v, often) + m * (n - d) / total) / below for w, n in c.items())
    assert known + m * d * vocabulary / total / below == pytest.approx(1)


def test_the_query_scores_alike_with_a_list_that_is_too_short(spark, odd_docs, monkeypatch, tmp_path):
    """K doesn't grow with the tokens; frequent words beyond the list are joined."""
    odd_docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    ask = lambda: sorted(tuple(r) for r in queries.op6_elias_fano(spark, str(tmp_path)).collect())
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 5_000)
    want = ask()
    monkeypatch.setattr(language_model, "LISTED", 100)
    got = ask()
    assert len(want) == 12 and want[0][4] > 100 * language_model.OFTEN
    assert got == want
    rows = [(r["doc_id"], r["text"], r["doc_id"] % 3 != 2) for r in odd_docs.collect() if r["doc_id"] is not None]
    got = sorted(tuple(r) for r in language_model.score_texts(odd_docs, F.col("doc_id") % 3 != 2, shard_tokens=2_000, often=1, steady=True).collect())
    assert all(abs(g[6] - w[6]) < 2e-3 * w[2] for g, w in zip(got, brute(rows, *ARGS, 1), strict=True))


def test_words_are_asked_for_only_where_the_list_is_full(spark, monkeypatch):
    """Beyond K times LISTED tokens the list still holds all frequent words if
    these are few; of those it lacks, only words that are in question travel."""
    rows = spark.range(400).selectExpr("id doc_id", "concat_ws(' ', repeat('a b c d e ', 10), 'f', id, id + 1, id + 2) text")
    ask = lambda: sorted(tuple(r) for r in language_model.score_texts(rows, F.lit(True), often=64, steady=True).collect())
    want = ask()
    assert want[0][4] > 100 * 64
    travelled, asked = [], language_model._asked
    monkeypatch.setattr(language_model, "_asked", lambda *a: travelled.append(asked(*a)) or travelled[-1])
    monkeypatch.setattr(language_model, "LISTED", 100)
    assert ask() == want and not travelled
    monkeypatch.setattr(language_model, "LISTED", 3)
    assert ask() == want and len(travelled) == 1
    mask = language_model._mask(spark.createDataFrame([(0, 5), (77, 5), (2**32 - 1, 5)], "x long, n long"))
    sent = spark.createDataFrame([(1, np.array([0, 77, 1 << 20, 2**32 - 1, 123_456_789], np.uint32).tobytes())], "shard int, previous binary")
    rest = spark.range(0, 1).selectExpr("cast(id as long) x", "9L n").unionByName(spark.createDataFrame([(1 << 20, 7)], "x long, n long"))
    got = asked(sent, rest, spark.sparkContext.broadcast(mask)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 9)]
