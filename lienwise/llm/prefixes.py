"""The prefix trie of conversations, by smallest-member ownership.

A node is a sequence of first turns; its members are the conversations that
start with it, and the smallest member owns it. A conversation that owns a node
owns all deeper nodes of its path, so it owns a suffix of it, and what a member
adds to the sums of a subtree is known from the member alone: the turns of its
path from the node on that it doesn't own are the ones that others store, and
the end of its path is a leaf of its own or it isn't. So one group-by over
prefixes gives every figure, and no subtree is walked.

A prefix is known by its length and four sums of 32-bit lanes of hashes of its
places and turns (two 64-bit hashes), which are running sums: a conversation of
very many turns is cut into ranges, as is a prefix that very many conversations
end at. Prefixes that a large share of all rows has, 4096 at most, find their
owner by a broadcast, the others by a shuffle. Owners come from a group-by, not
a window, so that no prefix is gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scan
from .storage import written

#: A prefix that more than one in COMMON of all rows has finds its owner by a broadcast.
COMMON = 4096
KEY = ["depth", "s0", "s1", "s2", "s3"]


def ordered(rows: DataFrame, **dealing) -> DataFrame:
    """``(conv_id, place, role, text)``, settled: turns numbered from 1 by turn,
    null first, ties by role and text. Null roles and texts become empty; rows
    without conv_id belong to no conversation and go; repeated rows are turns of
    their own; other columns are not read."""
    clean = rows.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = scan.numbered(clean, ["conv_id"], "turn", [F.col("role"), F.col("text")], **dealing)
    return written(out.select("conv_id", (F.col("_n") + 1).alias("place"), "role", "text"), "turns")


def rebuilt(turns: DataFrame, source: Column, share: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``share`` turns of another one
    (all if it has fewer, none if it is absent) and go on with their own after
    as many: ``(conv_id, place, role, text, length)`` and ``(conv_id, length)``
    of all, turnless ones included, both settled. ``source`` and ``share``, at
    most ``most``, are columns of conv_id."""
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("n")).select("conv_id", "n", source.alias("source"), share.cast("long").alias("share"))
    sizes = written(sizes, "sizes")
    others = sizes.select(F.col("conv_id").alias("source"), F.col("n").alias("theirs"))
    taken = F.least("share", F.coalesce("theirs", F.lit(0)))
    convs = sizes.join(others, "source", "left").select("conv_id", "source", "share", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("share"))).alias("length"))
    convs = written(convs, "convs")
    heads = turns.where(F.col("place") <= most).withColumnRenamed("conv_id", "source")
    first = convs.where("taken > 0").join(heads, "source").where("place <= taken").select("conv_id", "place", "role", "text", "length")
    own = turns.join(convs, "conv_id").where("place > share").select("conv_id", (F.col("place") - F.col("share") + F.col("taken")).alias("place"), "role", "text", "length")
    return written(first.unionByName(own), "rebuilt"), convs.select("conv_id", "length")


def _joined_to_owners(paths: DataFrame, nodes: DataFrame, common: int) -> DataFrame:
    total = paths.count()
    large = F.broadcast(written(nodes.where(F.col("n") * common > total).drop("n"), "hot"))
    small = nodes.where(F.col("n") * common <= total).drop("n")
    return paths.join(large, KEY).unionByName(paths.join(large.select(*KEY), KEY, "left_anti").join(small, KEY))


def trie(turns: DataFrame, convs: DataFrame, common: int = COMMON, **dealing) -> tuple[DataFrame, DataFrame]:
    """Nodes and the conversations that end at them.

    Nodes are ``(depth, s0..s3, conv_id, parent_conv_id, n_convs, n_children,
    n_leaves, saved)``; conv_id is the owner, saved the code points that all
    members have in the texts of the subtree less those of one copy of each
    node. The root (depth 0) has all conversations; without any there is no
    node. Ends are ``(depth, s0..s3, conv_id)``."""
    place, size = F.col("place"), F.char_length("text").cast("long")
    lanes = {}
    for i in (0, 1):
        h = F.xxhash64(F.lit(i + 1), place, "role", "text")
        lanes |= {f"s{2 * i}": h.bitwiseAND(0xFFFFFFFF), f"s{2 * i + 1}": F.shiftrightunsigned(h, 32)}
    dealt = scan.dealt(turns, ["conv_id"], "place", **dealing)
    paths = scan.running(dealt, ["conv_id"], [place], lanes | {"upto": size})
    paths = written(paths.select("conv_id", place.alias("depth"), "s0", "s1", "s2", "s3", "upto", (F.col("upto") - size).alias("before"), "length"), "paths")
    nodes = written(paths.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.max("length").alias("deepest"), F.count(F.lit(1)).alias("n")), "owners")
    marked = written(_joined_to_owners(paths, nodes, common), "marked")
    owns, last = F.col("owner") == F.col("conv_id"), F.col("depth") == F.col("length")
    own = written(
        marked.groupBy("conv_id").agg(
            (F.coalesce(F.max(F.when(~owns, F.col("depth"))), F.lit(0)) + 1).alias("since"),
            F.coalesce(F.max(F.when(~owns, F.col("upto"))), F.lit(0)).alias("others"),
            F.max_by("owner", F.when(~owns, F.col("depth"))).alias("above"),
            F.max((owns & last & (F.col("deepest") == F.col("depth"))).cast("long")).alias("leaf"),
        ),
        "owned",
    )
    member = marked.join(own, "conv_id")
    least = convs.agg(F.min("conv_id")).first()[0]
    owned, above = F.col("depth") >= F.col("since"), F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("above"))
    figures = [
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(((F.col("depth") + 1 >= F.col("since")) & ~last).cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(owned, F.lit(0)).otherwise(F.col("others") - F.col("before"))).alias("saved"),
    ]
    inner = member.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.min(F.when(owned, F.when(F.col("since") < F.col("depth"), F.col("conv_id")).otherwise(above))).alias("parent_conv_id"), *figures)
    all_convs = convs.join(own, "conv_id", "left")
    root = all_convs.agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.coalesce(F.sum((F.col("since") == 1).cast("long")), F.lit(0)).alias("n_children"),
        F.coalesce(F.sum("leaf"), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("others"), F.lit(0)).alias("saved"),
    ).where("n_convs > 0")
    root = root.select(*[F.lit(0).cast("long").alias(k) for k in KEY], "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved")
    ends = marked.where(last).select(*KEY, "conv_id").unionByName(convs.where("length = 0").select(*[F.lit(0).cast("long").alias(k) for k in KEY], "conv_id"))
    return inner.unionByName(root), ends


def end_digests(ends: DataFrame, **dealing) -> DataFrame:
    """``(depth, s0..s3, ends_sha256)``: of each node's ids in rising order,
    joined by commas. A node that very many conversations end at is written in
    ranges, whose texts then pass a hash in their order: SHA-256 is one pass by
    definition, in constant memory here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []

        def out() -> pa.RecordBatch:
            return pa.record_batch([*[pa.array([n[i] for n, _ in done], pa.int64()) for i in range(len(KEY))], pa.array([d for _, d in done], pa.string())], [*KEY, "ends_sha256"])

        for b in batches:
            for *key, text in zip(*[b.column(k).to_pylist() for k in [*KEY, "ids"]], strict=True):
                if key != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if len(done) > 1000:
                yield out()
                done.clear()
        if node is not None:
            done.append((node, state.hexdigest()))
            yield out()

    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    parts = written(scan.dealt(ends, KEY, "conv_id", **dealing).groupBy(*KEY, scan.RANGE).agg(ids.alias("ids")), "ends")
    whole = parts.where(F.col(scan.RANGE) == 0).select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    cut = parts.where(F.col(scan.RANGE) > 0).repartition(*KEY).sortWithinPartitions(*KEY, scan.RANGE).select(*KEY, "ids")
    return whole.unionByName(cut.mapInArrow(run, ", ".join(f"{k} long" for k in KEY) + ", ends_sha256 string"))
