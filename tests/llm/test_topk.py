import math

import numpy as np
from pyspark.sql import functions as F

from lienwise.llm import topk


def brute(rows, k):
    good = [(i, [math.floor(max(-topk.LARGEST, min(topk.LARGEST, 64 * float(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, queries = [], {}
    for q, a in good:
        if q % 20 == 0:
            queries[q] = min(queries.get(q, a), a)
    for q, a in queries.items():
        held = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
        found = sorted(((-held(sum(x * y for x, y in zip(a, b))), i) for i, b in good if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(3)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k).collect())


def test_random_ties_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=40).round(2).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]  # one very common vector
    rows += [(500, None), (520, [1.0, None]), (540, [float("nan"), 1.0]), (560, [float("inf")]), (580, [0.5, -0.25]), (600, []), (None, [1.0])]
    rows += [(40, rows[40][1]), (60, [0.25] * 40), (61, rows[61][1])]  # repeated rows and ids
    for name, n in (("ROWS", 64), ("SEED", 32), ("FIRST", 8), ("DIMS", 4)):
        monkeypatch.setattr(topk, name, n)
    assert run(spark, rows, 20) == brute(rows, 20)


def test_few_candidates_large_values_and_none(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, 2.0]), (20, [-3e9, 5.0]), (3, [2e9, 1e9])]
    assert run(spark, rows, 20) == brute(rows, 20)
    assert run(spark, [], 5) == [] and run(spark, [(0, [1.0])], 5) == []


def test_tiny_negatives_and_products_beyond_a_double(spark):
    rows = [(0, [-1e-20, 1.0]), (1, [3.0, -1e-300]), (2, [1e308, 0.0]), (20, [1e308, -1e308]), (3, [1e17, 1.0]), (40, [-(2.0**50), 2.0**46 + 0.01]), (4, [0.0, -0.0])]
    assert run(spark, rows, 20) == brute(rows, 20)


def test_repeated_query_rows_are_one_query(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.1, 0.0]), (2, [0.2, 0.0]), (3, [0.3, 0.0]), (4, [0.4, 0.0])]
    assert [r[2] for r in run(spark, rows, 4)] == [4, 3, 2, 1]


def test_the_bound_prunes_the_drivers_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    held = topk.scaled_vectors(df, 64.0, "vec_id", "embedding").toArrow().combine_chunks()
    ids, vectors = held["id"].to_numpy(), topk.columns_of(held["v"])
    search = topk.Search(ids[ids % 20 == 0], vectors[:, ids % 20 == 0], 20)
    search.add(ids, vectors)
    assert search.work < 0.75 * search.whole
