"""Components of a growing graph, batch by batch.

Every node keeps the label it got first. Labels that have become part of another
component point at its root, and roots hold sizes. A batch looks up the labels
of its own nodes, follows them to their roots, finds the components of the graph
of these roots alone (its edges are the batch's), and writes what changed: new
nodes, the labels that it met, the merged roots. So work follows the batch and
the labels that it touches, not the graph; pointers that it met are shortened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.keyed import KeyedTable
from ..storage import settled


class Union:
    """Tables under ``path``: nodes (node, label), pointers (label, root), sizes
    (root, size)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark = spark
        self.nodes = KeyedTable(spark, f"{path}/nodes", ["node"], buckets)
        self.pointers = KeyedTable(spark, f"{path}/pointers", ["label"], buckets)
        self.sizes = KeyedTable(spark, f"{path}/sizes", ["root"], buckets)

    def _roots(self, labels: DataFrame, version: int, whole: bool = False) -> DataFrame:
        """(label, root) of distinct labels, along the pointers."""
        found = settled(labels.select("label", F.col("label").alias("root")), "labels")
        while True:
            held = self.pointers.read(version) if whole else self.pointers.lookup(found.select(F.col("root").alias("label")), version)
            if held is None:
                return found
            step = held.select(F.col("label").alias("_at"), F.col("root").alias("_to"))
            moved = settled(found.join(step, found["root"] == step["_at"], "left").select("label", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")), "labels")
            found = moved.drop("_moved")
            if not moved.where("_moved").head(1):
                return found

    def add(self, edges: DataFrame, version: int) -> None:
        """Takes in the edges (a, b) of one batch; of a batch that is done,
        nothing. All tables are read as of the batch before, so a batch that
        broke off between two tables gives the same rows again."""
        before = version - 1
        pairs = settled(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
        names = settled(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
        known = self.nodes.lookup(names, before)
        here = names.join(known, "node", "left") if known is not None else names.withColumn("label", F.lit(None).cast("string"))
        here = settled(here.select("node", F.coalesce("label", "node").alias("label"), F.col("label").isNull().alias("new")), "nodes")
        roots = self._roots(here.select("label").distinct(), before)
        at = settled(here.join(roots, "label"), "nodes")
        side = at.select("node", "root")
        links = pairs.join(side.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(side.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        links = links.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        joined = settled(graph.components(links).select(F.col("node").alias("root"), F.col("component").alias("top")), "merged")
        at = settled(at.join(joined, "root", "left").withColumn("top", F.coalesce("top", "root")), "nodes")
        fresh = at.where("new").groupBy("top").agg(F.count(F.lit(1)).alias("more"))
        olds = joined.unionByName(at.select("root", F.col("root").alias("top")).join(joined.select("root"), "root", "left_anti").distinct())
        held = self.sizes.lookup(olds.select("root"), before)
        sums = olds.join(held, "root").groupBy("top").agg(F.sum("size").alias("had")) if held is not None else self.spark.createDataFrame([], "top string, had long")
        sizes = fresh.join(sums, "top", "full").select(F.col("top").alias("root"), (F.coalesce("more", F.lit(0)) + F.coalesce("had", F.lit(0))).alias("size"))
        moved = at.where("not new").select("label", F.col("top").alias("root")).unionByName(joined.join(held.select("root"), "root", "left_semi").select(F.col("root").alias("label"), F.col("top").alias("root")) if held is not None else self.spark.createDataFrame([], "label string, root string"))
        self.nodes.upsert(at.where("new").select("node", F.col("top").alias("label")), version)
        self.pointers.upsert(moved.where("label <> root").distinct(), version)
        self.sizes.upsert(sizes, version, gone=joined.where("root <> top").select("root"))

    def components(self, version: int | None = None) -> DataFrame:
        """(node, component, size) of all nodes, as ``graph.components`` gives."""
        at = self.nodes._before(version)
        rows = self.nodes.read(at)
        roots = self._roots(rows.select("label").distinct(), at, whole=True)
        return rows.join(roots, "label").join(self.sizes.read(at), "root").select("node", F.col("root").alias("component"), "size")
