"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Edges that one task joins at once; more are contracted by rounds of joins.
BLOCK_EDGES = 1 << 20


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest connected node of each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        first = np.concatenate([[True], high[1:] != high[:-1]])
        label[high[first]] = low[first]
        while not np.array_equal(label, jumped := label[label]):
            label = jumped


def _stars(edges: DataFrame) -> DataFrame:
    """The edges of each partition (a bounded number) as stars: each node to the
    smallest that they reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            rows = pa.Table.from_batches(held)
            node, place = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), return_inverse=True)
            root = _roots(len(node), place[: rows.num_rows], place[rows.num_rows :])
            moved = np.flatnonzero(root < np.arange(len(node)))
            yield pa.record_batch([pa.array(node[moved], rows.schema.field("a").type), pa.array(node[root[moved]], rows.schema.field("b").type)], ["a", "b"])

    return edges.mapInArrow(run, edges.schema)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("xxhash64(b, a) % 1000003"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns a, b): the root is
    the smallest node that is reachable.

    Each round joins the edges to one minimum per node, a pre-aggregated row,
    so a node with very many edges is only a skewed join key, which adaptive
    execution splits; no group is gathered. Rounds grow with the logarithm of
    the longest path; edges of few enough for one block, counted first, are
    joined at once instead, so that short jobs don't pile up on the driver. Self-loops and repeated edges are harmless; null ends are
    left out. An empty table gives an empty result."""
    same = edges.where("a is not null and b is not null").select(F.col("a").alias("node")).union(edges.where("a is not null and b is not null").select("b"))
    state = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _digest(state)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        if seen[0] <= BLOCK_EDGES:
            state = written(_stars(state.repartition(1)), "edges")
            break
        both = state.unionAll(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        state = written(small.where("a <> b").distinct(), "edges")
        now = _digest(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = same.distinct()
    return nodes.join(state, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("root"))
