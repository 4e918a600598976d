"""The entity graph: edges, structure, components and propagated suspicion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import DEFAULT, Params
from ..storage import settled

ATTRIBUTES = ("device", "policy")
LINKED = ("agent", "customer", "merchant", "device", "policy")


def edges(log: DataFrame) -> DataFrame:
    """(a, b, ts): each unordered pair of a token and an entity of its events
    once, with the time of the last arrival. Self-edges go."""
    have = [k for k in LINKED if f"{k}_id" in log.columns]
    others = F.array(*[F.when(F.coalesce(F.col(f"{k}_id"), F.lit("")) != "", S.node_id(k, F.col(f"{k}_id"))) for k in have])
    rows = log.where(F.coalesce("token_id", F.lit("")) != "").select(S.node_id("token", F.col("token_id")).alias("t"), F.explode(others).alias("o"), "seq", F.col("occurred_at").alias("ts"))
    pairs = rows.where("o is not null and t <> o").select(F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "seq", "ts")
    return pairs.groupBy("a", "b").agg(F.max_by("ts", "seq").alias("ts"))


def neighbours(edge: DataFrame) -> DataFrame:
    """Both directions of each edge, as (node, other)."""
    return edge.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")


def degrees(edge: DataFrame) -> DataFrame:
    return neighbours(edge).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def fan_out(edge: DataFrame) -> DataFrame:
    """The most neighbours of one type."""
    by_type = neighbours(edge).groupBy("node", S.node_type(F.col("other")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return by_type.groupBy("node").agg(F.max("n").alias("fan_out"))


def shared_attributes(edge: DataFrame) -> DataFrame:
    """Others that share a device or policy, summed over those."""
    near = neighbours(edge).where(S.node_type(F.col("other")).isin(*ATTRIBUTES))
    d = degrees(edge).select(F.col("node").alias("other"), "degree")
    return near.join(d, "other").groupBy("node").agg(F.sum(F.col("degree") - 1).alias("shared_attributes"))


def components(edge: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component, size): the smallest node that is reachable. Each round
    hooks the label of a node, not only the node, under the smallest label
    beside it, and labels jump along themselves, so rounds grow slowly. It is
    an error if labels have not settled after ``max_rounds``."""
    near = settled(neighbours(edge), "graph")
    label = settled(near.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "graph")
    for _ in range(max_rounds):
        other = label.select(F.col("node").alias("other"), F.col("label").alias("l"))
        low = near.join(other, "other").groupBy("node").agg(F.min("l").alias("m"))
        seen = label.join(low, "node")
        hooks = seen.where("m < label").groupBy(F.col("label").alias("node")).agg(F.min("m").alias("hook"))
        hop = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = seen.join(hop, "label", "left").join(hooks, "node", "left")
        new = new.select("node", F.least("label", "m", F.coalesce("up", "label"), F.coalesce("hook", "label")).alias("next"), F.col("label").alias("was"))
        new = settled(new, "graph")
        label = new.select("node", F.col("next").alias("label"))
        if not new.where("next <> was").head(1):
            break
    else:
        raise RuntimeError("components did not settle")
    sizes = label.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return label.join(sizes, "label").select("node", F.col("label").alias("component"), "size")


def structural_floor(edge: DataFrame, p: Params = DEFAULT, parts: DataFrame | None = None) -> DataFrame:
    """``parts``: the components of the graph, where they are known."""
    parts = components(edge) if parts is None else parts
    rows = degrees(edge).join(fan_out(edge), "node", "left").join(shared_attributes(edge), "node", "left").join(parts, "node", "left")
    rows = rows.select("node", "degree", "fan_out", F.coalesce("shared_attributes", F.lit(0)).alias("shared_attributes"), "size")
    floor = S.noisy_or(S.squash(F.col("degree"), p.degree_scale), S.squash(F.col("fan_out"), p.fan_out_scale), S.squash(F.col("shared_attributes"), p.shared_scale), S.squash(F.col("size"), p.component_scale))
    return rows.withColumn("floor", floor)


#: A node with more than one in HUB of all edges passes its changes on from SLOTS places.
HUB, SLOTS = 1024, 64
#: Changes up to this wait until they add up to more.
TOLERANCE = 1e-8
#: Rounds between tables that end lineage.
SETTLED = 5


def push_rounds(edge: DataFrame, seeds: DataFrame, p: Params = DEFAULT, tolerance: float = TOLERANCE) -> Iterator[DataFrame]:
    """After every ``SETTLED`` rounds the nodes that changes have reached (node,
    rest, score): ``score`` is the sum of what came, seeds without their label,
    ``rest`` the part that has not been passed on yet.

    A score is a sum of changes, and a change goes through the same damped mean
    as a score. So a round sends only changes above ``tolerance`` along the edges,
    which are dealt out by sender once, where the sums of the round before lie
    already: it shuffles what is sent, summed by receiver first, and a row for
    each node reached. Hubs send from slots. What waits is at most the tolerance
    for each sender, so no score is off by more than tolerance * damping /
    (1 - damping). It ends early when nothing is above it."""
    fixed = settled(seeds.select("node", F.col("label").cast("double").alias("label")), "graph")
    near = settled(neighbours(edge), "graph")
    degree = settled(near.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "graph")
    total = near.count()
    hubs = settled(degree.where(F.col("degree") * HUB > total).select(F.col("node").alias("other"), F.lit(SLOTS).alias("slots")), "graph")
    dealt = bool(hubs.head(1))  # 2 * HUB rows at most
    rows = near.join(fixed.select("node"), "node", "left_anti").join(degree, "node").select("node", "other", (p.propagation_damping / F.col("degree")).alias("share"))
    on = ["other", "slot"] if dealt else ["other"]
    if dealt:
        rows = rows.join(F.broadcast(hubs), "other", "left").select("node", "other", "share", F.pmod(F.xxhash64("node"), F.coalesce("slots", F.lit(1))).cast("int").alias("slot"))
    own = degree.select("node", F.col("node").alias("other"), F.lit(None).cast("double").alias("share"), *[F.lit(0).alias("slot")] * dealt)
    lines = rows.unionByName(own).repartition(*on).persist(StorageLevel.DISK_ONLY)
    large, kept = F.abs("rest") > tolerance, F.col("share").isNull()
    try:
        state = settled(fixed.join(degree.select("node"), "node", "left_semi").select("node", F.col("label").alias("rest"), F.lit(0.0).alias("score")).where("rest <> 0"), "graph")
        for i in range(p.propagation_rounds):
            if i % SETTLED == 0 and not state.where(large).head(1):
                return
            sent = state.withColumnRenamed("node", "other")
            if dealt:
                sent = sent.join(F.broadcast(hubs), "other", "left").select("other", "rest", "score", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1)).alias("slot"))
            came, change = lines.join(sent, on).where(kept | large), F.col("share") * F.col("rest")
            rest, score = F.when(~kept, change).when(large, 0.0).otherwise(F.col("rest")), F.when(kept, F.col("score")).otherwise(change)
            state = came.select("node", rest.alias("rest"), score.alias("score")).groupBy("node").agg(F.sum("rest").alias("rest"), F.sum("score").alias("score"))
            if i % SETTLED == SETTLED - 1 or i == p.propagation_rounds - 1:
                state = settled(state, "graph")
                yield state
    finally:
        lines.unpersist()


def propagate(edge: DataFrame, seeds: DataFrame, p: Params = DEFAULT, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, score): rounds of the damped mean of the neighbours' scores,
    seeds (node, label) held fixed, by changes alone (``push_rounds``)."""
    last = [r.select("node", "score") for r in push_rounds(edge, seeds, p, tolerance)][-1:]
    every = neighbours(edge).select("node").distinct().select("node", F.lit(0.0).alias("score"))
    held = seeds.join(every.select("node"), "node", "left_semi").select("node", F.col("label").cast("double").alias("score"))
    rows = reduce(DataFrame.unionByName, [every, held, *last])
    return rows.groupBy("node").agg(S.clamp01(F.sum("score")).alias("score"))


def dispute_seeds(log: DataFrame) -> DataFrame:
    rows = log.where((F.col("type") == "payment.disputed") & (F.coalesce("token_id", F.lit("")) != ""))
    return rows.select(S.node_id("token", F.col("token_id")).alias("node")).distinct().withColumn("label", F.lit(1.0))


def network_risk(edge: DataFrame, seeds: DataFrame, p: Params = DEFAULT, learned: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """The figure of every keyed node (not of devices or policies): the highest
    of floor, propagated score and, where given, a learned one (node, learned).
    ``parts``: the components of the graph, where they are known."""
    rows = structural_floor(edge, p, parts).join(propagate(edge, seeds, p), "node")
    rows = rows.join(learned, "node", "left") if learned is not None else rows.withColumn("learned", F.lit(None).cast("double"))
    risk = rows.select("node", S.combine_risk(F.col("floor"), F.col("score"), F.coalesce("learned", F.lit(0.0))).alias("risk"))
    return risk.where(~S.node_type(F.col("node")).isin(*ATTRIBUTES)).select(S.bare_id(F.col("node")).alias("key"), "node", "risk")


def hop_features(edge: DataFrame, p: Params = DEFAULT, parts: DataFrame | None = None) -> DataFrame:
    """Node features with means over one and two hops, for a learned risk.
    ``parts``: the components of the graph, where they are known."""
    base = structural_floor(edge, p, parts).select("node", F.log1p("degree").alias("f0"), F.log1p("fan_out").alias("f1"), F.log1p("shared_attributes").alias("f2"), F.log1p("size").alias("f3"))
    base, near = settled(base, "graph"), settled(neighbours(edge), "graph")

    def mean(of: DataFrame, prefix: str, names: list[str]) -> DataFrame:
        return near.join(of.withColumnRenamed("node", "other"), "other").groupBy("node").agg(*[F.avg(c).alias(prefix + c) for c in names])

    names = ["f0", "f1", "f2", "f3"]
    one = mean(base, "n_", names)
    two = mean(one, "n_", ["n_" + c for c in names])
    return base.join(one, "node", "left").join(two, "node", "left")
