"""Training sets with point-in-time features, and the models on them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import node_id
from ..storage import settled
from . import scan


def examples(labels: DataFrame, vectors: DataFrame, **dealing) -> DataFrame:
    """(token_id, vector, y, w): each label with the last vector of its token
    at or before it. Both sides are merged in one ordered pass per token, so
    there is no range join; tokens of very many rows are passed in ranges, with
    the last vector of the ranges before carried in. Labels before any vector go."""
    rows = vectors.select("token_id", "occurred_at", F.col("seq"), "vector", F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("weight"), F.lit(0).alias("is_label"))
    asks = labels.select("token_id", "occurred_at", F.lit(0).cast("long").alias("seq"), F.lit(None).cast("array<double>").alias("vector"), "value", "weight", F.lit(1).alias("is_label"))
    both = scan.last_before(settled(rows.unionByName(asks), "examples"), ["token_id"], "occurred_at", [F.col("is_label"), F.col("seq")], F.col("vector"), "last", **dealing)
    return both.where("is_label = 1 and last is not null").select("token_id", F.col("last").alias("vector"), F.round("value").alias("y"), F.col("weight").alias("w"))


def graph_examples(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Seeds (node, label) of the labelled tokens that the graph knows."""
    rows = labels.select(node_id("token", F.col("token_id")).alias("node"), F.col("value").alias("label"))
    return rows.join(nodes.select("node").distinct(), "node", "left_semi")


def fit_scorer(rows: DataFrame, trees: int = 20, seed: int = 0) -> PipelineModel | None:
    """Boosted trees and an isotonic calibration of their probability; None if
    fewer than two classes are there."""
    if rows.select("y").distinct().count() < 2:
        return None
    data = rows.select(array_to_vector("vector").alias("features"), F.col("y").cast("double").alias("label"))
    gbt = GBTClassifier(maxIter=trees, maxDepth=4, seed=seed).fit(data)
    raw = gbt.transform(data).select("label", vector_to_array("probability")[1].alias("p"))
    iso = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(raw)
    return PipelineModel([gbt, iso])


def calibrated(model: PipelineModel, rows: DataFrame) -> DataFrame:
    gbt, iso = model.stages
    out = gbt.transform(rows.withColumn("features", array_to_vector("vector"))).withColumn("p", vector_to_array("probability")[1])
    return iso.transform(out).drop("features", "rawPrediction", "probability", "prediction", "p")


def isolation_floor(rows: DataFrame, trees: int = 50, sample: int = 256, seed: int = 0, scale: float = 0.1) -> DataFrame:
    """``rows`` with iso_floor: how easily random cuts isolate a vector. The
    forest grows on the driver from a bounded sample, each tree to the depth at
    which its sample is halved to single rows; scoring runs over Arrow batches."""
    first = rows.select("vector").where("vector is not null").head(1)
    if not first:
        return rows.withColumn("iso_floor", F.lit(0.0))
    held = rows.where("vector is not null").orderBy(F.xxhash64("vector")).limit(sample * 4).select("vector").collect()
    got, rng = np.array([r[0] for r in held], float), np.random.default_rng(seed)
    n = min(sample, len(got))
    most = max(1, math.ceil(math.log2(n)))

    def length(n: int) -> float:
        return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def grow(x: np.ndarray, depth: int, nodes: list) -> int:
        """Adds (column, cut, left, right, depth), column -1 for a leaf."""
        place = len(nodes)
        spread = np.flatnonzero(np.ptp(x, axis=0) > 0) if len(x) > 1 and depth < most else []
        nodes.append((-1, 0.0, 0, 0, depth + length(len(x))))
        if len(spread):
            c = int(rng.choice(spread))
            cut = float(rng.uniform(x[:, c].min(), x[:, c].max()))
            left = grow(x[x[:, c] < cut], depth + 1, nodes)
            nodes[place] = (c, cut, left, grow(x[x[:, c] >= cut], depth + 1, nodes), 0.0)
        return place

    forest = []
    for _ in range(trees):
        nodes: list = []
        grow(got[rng.choice(len(got), n, replace=False)], 0, nodes)
        forest.append(tuple(np.array(x) for x in zip(*nodes, strict=True)))
    norm = max(length(n), 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("vector")
            fine = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            x = np.array(vectors.take(pa.array(fine)).to_pylist(), float).reshape(len(fine), -1)
            total = np.zeros(len(fine))
            for column, cut, left, right, depth in forest if len(fine) else ():
                at = np.zeros(len(fine), np.int64)
                for _ in range(most):
                    inner = column[at] >= 0
                    go = x[np.arange(len(x)), np.maximum(column[at], 0)] < cut[at]
                    at = np.where(inner, np.where(go, left[at], right[at]), at)
                total += depth[at]
            out = np.full(b.num_rows, np.nan)
            out[fine] = 1 / (1 + np.exp(-(2.0 ** -(total / trees / norm) - 0.5) / scale))
            yield pa.record_batch([*b.columns, pa.array(out, mask=np.isnan(out))], [*b.schema.names, "iso_floor"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, iso_floor double")


def retrain(layers: dict[str, DataFrame], trees: int = 20) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fits a scorer for each layer's examples (vector, y) and reports (layer,
    n, trained, reason, mean_misuse, mean_legit): whether and why not, and the
    mean calibrated figure of either class."""
    models, rows = {}, []
    spark = next(iter(layers.values())).sparkSession
    for layer, data in layers.items():
        data = settled(data.select("vector", F.col("y").cast("double").alias("y")).where("vector is not null"), "examples")
        n = data.count()
        model = fit_scorer(data, trees) if n else None
        if model is None:
            rows.append((layer, n, False, "no examples" if not n else "one class", None, None))
            continue
        models[layer] = model
        mean = {r["y"]: r["m"] for r in calibrated(model, data).groupBy("y").agg(F.avg("calibrated").alias("m")).collect()}
        rows.append((layer, n, True, None, mean.get(1.0), mean.get(0.0)))
    return models, spark.createDataFrame(rows, "layer string, n long, trained boolean, reason string, mean_misuse double, mean_legit double")


def learned_network_risk(features: DataFrame, seeds: DataFrame, trees: int = 20) -> DataFrame:
    """(node, learned): a calibrated figure for every node from its hop features
    (node and numbers), learnt from the seeds (node, label); null if they are of
    one class. For ``combine_risk``."""
    names = [c for c in features.columns if c != "node"]
    rows = settled(features.select("node", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]).alias("vector")), "hops")
    model = fit_scorer(rows.join(seeds.select("node", F.round("label").alias("y")), "node"), trees)
    if model is None:
        return rows.select("node", F.lit(None).cast("double").alias("learned"))
    return calibrated(model, rows).select("node", F.col("calibrated").alias("learned"))
