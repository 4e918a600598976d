"""The hash-linked ledger.

A chain is sequential by definition. ``append`` keeps one global chain exactly:
one ordered pass that carries a single hash. ``append_by_token`` is the form for
scale: a chain for each token, in parallel, under one Merkle root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("evaluation_id", "request_digest", "decision", "code", "predicate_failed", "evidence_digest", "policy_version", "ts")
_SEPARATOR = "\x1f"


def record_hash(prev: Column) -> Column:
    """The hash of a record's fields after the previous hash."""
    return F.sha2(F.concat_ws(_SEPARATOR, F.coalesce(prev, F.lit("")), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS]), 256)


def _chained(records: DataFrame, key: str | None, held: DataFrame | None = None) -> DataFrame:
    names = records.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, prev = object(), ""
        for b in batches:
            before, after = [], []
            for row, k, head in zip(b["_body"], b[key] if key else [None] * len(b), b["_head"], strict=True):
                if k != group:
                    group, prev = k, head
                before.append(prev)
                prev = hashlib.sha256(f"{prev}{_SEPARATOR}{row}".encode()).hexdigest()
                after.append(prev)
            yield b.drop(columns=["_body", "_head"]).assign(prev_hash=before, hash=after)

    body = F.concat_ws(_SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS])
    rows = records.withColumn("_body", body)
    if held is None:
        rows = rows.withColumn("_head", F.lit(""))
    else:
        rows = rows.join(held.select(key, F.col("hash").alias("_head")), key, "left").select(*names, "_body", F.coalesce("_head", F.lit("")).alias("_head"))
    ordered = rows.repartition(key).sortWithinPartitions(key, "seq") if key else rows.repartition(1).sortWithinPartitions("seq")
    schema = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in names)
    return ordered.mapInPandas(run, f"{schema}, prev_hash string, hash string")


def append(records: DataFrame) -> DataFrame:
    """Records (seq and FIELDS) with prev_hash and hash of one global chain.
    One task by nature, with constant memory: for small ledgers."""
    return _chained(records, None)


def append_by_token(records: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The same for a chain per token_id, all in parallel. ``held`` (token_id,
    hash; see ``heads``) are the heads of an earlier append that these records,
    all of later seq, go on from; so a run reads no chain again."""
    return _chained(records, "token_id", held)


def moved_heads(held: DataFrame, chains: DataFrame) -> DataFrame:
    """The heads after an append: those of the tokens that got records take the
    place of the ones before, and lengths add up."""
    both = held.select("token_id", "seq", "hash", "n").unionByName(heads(chains))
    return both.groupBy("token_id").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"), F.sum("n").alias("n"))


def heads(chains: DataFrame) -> DataFrame:
    """(token_id, seq, hash, n): the last record of each chain and its length."""
    return chains.groupBy("token_id").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"), F.count(F.lit(1)).alias("n"))


def merkle_root(chains: DataFrame) -> DataFrame:
    """One row: the hash over the heads of all tokens, in 4096 buckets by the
    hash of the token, in token order within each."""
    rows = heads(chains).groupBy(F.substring(F.sha2("token_id", 256), 1, 3).alias("b")).agg(F.array_sort(F.collect_list(F.struct("token_id", "hash"))).alias("x"))
    buckets = rows.select("b", F.sha2(F.array_join(F.transform("x", lambda x: x["hash"]), ""), 256).alias("h"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("root"))


def verify(chain: DataFrame, key: str | None = None, held: DataFrame | None = None) -> DataFrame:
    """Faulty records: ``broken`` where prev_hash is not the hash before,
    ``tampered`` where the fields don't give the hash. With ``key`` a chain for
    each of its values; else one, whose lag runs in ranges of seq with their
    edges joined. ``held``: the heads (key, hash) before these records, where
    they are the later part of chains."""
    if key:
        rows, before = chain, F.lag("hash").over(Window.partitionBy(key).orderBy("seq"))
        if held is not None:
            rows = chain.join(held.select(key, F.col("hash").alias("_head")), key, "left")
            before = F.coalesce(before, F.col("_head"))
    else:
        ranges = chain.withColumn("_r", (F.col("seq") / 65536).cast("long"))
        edge = ranges.groupBy("_r").agg(F.max_by("hash", "seq").alias("_edge"))
        edge = edge.withColumn("_before", F.last("_edge", ignorenulls=True).over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))).select("_r", "_before")
        rows = ranges.join(F.broadcast(edge) if edge.count() < 100_000 else edge, "_r", "left")
        before = F.coalesce(F.lag("hash").over(Window.partitionBy("_r").orderBy("seq")), F.col("_before"))
    out = rows.withColumn("broken", F.coalesce("prev_hash", F.lit("")) != F.coalesce(before, F.lit(""))).withColumn("tampered", F.col("hash") != record_hash(F.col("prev_hash")))
    return out.where("broken or tampered").select("seq", "broken", "tampered")


def head(chain: DataFrame) -> DataFrame:
    return chain.agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"), F.count(F.lit(1)).alias("n"))
