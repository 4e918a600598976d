import random

import pytest
from pyspark.sql import functions as F

from lienwise.operators import graph
from lienwise.params import DEFAULT


def by_rounds(pairs, seeds):
    """All nodes, every round."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    score = {n: seeds.get(n, 0.0) for n in near}
    for _ in range(DEFAULT.propagation_rounds):
        score = {n: seeds[n] if n in seeds else DEFAULT.propagation_damping * sum(score[m] for m in near[n]) / len(near[n]) for n in near}
    return {n: min(1.0, max(0.0, x)) for n, x in score.items()}


def random_graph(seed):
    """A hub that most nodes know, a far path, a part without seeds."""
    rng = random.Random(seed)
    pairs = {tuple(sorted((f"n{rng.randrange(80)}", f"n{rng.randrange(80)}"))) for _ in range(120)}
    pairs |= {("hub", f"n{i}") for i in range(80)} | {(f"p{i:02}", f"p{i + 1:02}") for i in range(50)} | {("hub", "p00"), ("x", "y")}
    return sorted((a, b) for a, b in pairs if a != b)


@pytest.mark.parametrize("hub", [graph.HUB, 20])
def test_changes_add_up_to_the_scores(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    pairs, seeds = random_graph(1), {"n1": 1.0, "n5": 0.0, "p40": 0.7, "absent": 1.0}
    edge, at = spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(list(seeds.items()), "node string, label double")
    got = {r["node"]: r["score"] for r in graph.propagate(edge, at).collect()}
    want = by_rounds(pairs, {n: x for n, x in seeds.items() if n != "absent"})
    assert got.keys() == want.keys()
    assert max(abs(got[n] - want[n]) for n in got) <= graph.TOLERANCE * 0.85 / 0.15


def test_fewer_rows_are_sent_round_by_round_and_it_ends_early(spark, monkeypatch):
    pairs = [(f"a{i:03}", f"a{i + 1:03}") for i in range(200)]
    edge, seeds = spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame([("a100", 1.0)], "node string, label double")
    tolerance = 0.01
    monkeypatch.setattr(graph, "SETTLED", 1)
    sent = [r.where(F.abs("rest") > tolerance).count() for r in graph.push_rounds(edge, seeds, tolerance=tolerance)]
    assert len(sent) < DEFAULT.propagation_rounds and max(sent) < 40  # of 201 nodes
    assert sent[-1] < max(sent)
    monkeypatch.undo()
    got, want = {r["node"]: r["score"] for r in graph.propagate(edge, seeds, tolerance=tolerance).collect()}, by_rounds(pairs, {"a100": 1.0})
    assert max(abs(got[n] - want[n]) for n in got) <= tolerance * 0.85 / 0.15


def test_no_seeds_and_no_edges(spark):
    edge, none = spark.createDataFrame([("a", "b")], "a string, b string"), spark.createDataFrame([], "node string, label double")
    assert {(r["node"], r["score"]) for r in graph.propagate(edge, none).collect()} == {("a", 0.0), ("b", 0.0)}
    assert graph.propagate(edge.limit(0), none).count() == 0
