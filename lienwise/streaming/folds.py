"""Continuous forms of the batch folds; their results equal the batch ones."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import deposit_id, label_id
from ..operators import behaviour, features, graph
from ..operators.reputation import reputation
from ..params import DEFAULT, Params
from ..sources.keyed import KeyedTable
from ..storage import settled
from .union import Union


def deduplicated(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """Each event_id once. With a watermark on column ``at`` the state is
    bounded, and a repeat is caught within it."""
    rows = stream.where(F.coalesce("event_id", F.lit("")) != "")
    if watermark:
        return rows.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["event_id"])
    return rows.dropDuplicates(["event_id"])


def label_events(stream: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Labels as they settle: the state of a token is the set of its armed
    nonces; a dispute clears it."""
    weights = {"dispute": (1.0, 1.0), "cancellation": (1.0, p.cancellation_weight), "confirmed_step_up": (0.0, 1.0)}

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        armed = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for row in rows.itertuples(index=False):
            reason = None
            if row.type == "decision.made":
                if row.decision == "STEP_UP" and row.nonce:
                    armed.add(row.nonce)
            elif row.type == "payment.captured":
                if row.nonce in armed:
                    armed.discard(row.nonce)
                    reason = "confirmed_step_up"
            elif row.type == "payment.disputed":
                armed.clear()
                reason = "dispute"
            else:
                reason = "cancellation"
            if reason:
                out.append((row.event_id, key[0], *weights[reason], reason, int(row.occurred_at), int(row.seq)))
        state.update((sorted(armed),))
        yield pd.DataFrame(out, columns=["event_id", "token_id", "value", "weight", "reason", "occurred_at", "seq"])

    kinds = F.col("type").isin("decision.made", "payment.captured", "payment.disputed", "token.cancelled")
    rows = stream.where(kinds & (F.coalesce("token_id", F.lit("")) != "")).select("token_id", "seq", "event_id", "type", "decision", "nonce", "occurred_at")
    out = rows.groupBy("token_id").applyInPandasWithState(fold, "event_id string, token_id string, value double, weight double, reason string, occurred_at long, seq long", "armed array<string>", "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("event_id", label_id(F.col("reason"), F.col("event_id")))


def behaviour_signals(stream: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The raw signals of ``behaviour.signals`` as events arrive (principal, seq,
    amount_paise, merchant_id, occurred_at); the state of a principal is its
    baseline. ``behaviour.deviations`` applies to the result as it is."""
    names = [x.split()[0] for x in behaviour.SIGNALS.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pickle.loads(state.get[0]) if state.exists else behaviour.Baseline(p)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = [(key[0], seq, *own.observe(float(amount), merchant or "", int(ts))) for seq, amount, merchant, ts in zip(rows["seq"], rows["amount_paise"], rows["merchant_id"], rows["occurred_at"], strict=True)]
        state.update((pickle.dumps(own),))
        yield pd.DataFrame(out, columns=names)

    rows = stream.where(F.coalesce("principal", F.lit("")) != "").select("principal", "seq", F.coalesce("amount_paise", F.lit(0)).alias("amount_paise"), "merchant_id", F.coalesce("occurred_at", F.lit(0)).alias("occurred_at"))
    return rows.groupBy("principal").applyInPandasWithState(fold, behaviour.SIGNALS, "baseline binary", "append", GroupStateTimeout.NoTimeout)


def behaviour_deposits(stream: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(seq, event_id, key, behaviour_deviation) of every observation."""
    rows = behaviour.deviations(behaviour_signals(stream, p), p)
    return rows.select("seq", deposit_id(F.lit("feature.behaviour.deposited"), F.col("principal"), F.col("seq")).alias("event_id"), F.col("principal").alias("key"), F.col("deviation").alias("behaviour_deviation"))


def latest_envelopes(stream: DataFrame, columns: list[str]) -> DataFrame:
    """``intent.latest_envelope`` as events arrive: each debit with what the last
    envelope of its session before it sealed, which is a session's state and is
    replaced whole."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in columns}

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else dict.fromkeys(columns)
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").to_dict("records"):
            if row["sealed"]:
                held = {c: None if pd.isna(row[c]) else row[c].item() if hasattr(row[c], "item") else row[c] for c in columns}
            else:
                out.append((key[0], int(row["seq"]), *held.values()))
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["session_id", "seq", *(f"env_{c}" for c in columns)]).astype({f"env_{c}": "Int64" if kinds[c] in ("int", "bigint") else object for c in columns})

    rows = stream.select("session_id", "seq", "sealed", *columns)
    schema = "session_id string, seq long, " + ", ".join(f"env_{c} {k}" for c, k in kinds.items())
    return rows.groupBy("session_id").applyInPandasWithState(fold, schema, "envelope string", "append", GroupStateTimeout.NoTimeout)


def graph_ticks(spark: SparkSession, table: str, every: int = 128, p: Params = DEFAULT, buckets: int = 64):
    """A ``foreachBatch`` sink that keeps under ``table`` the edges with their
    last arrival, the dispute seeds and the components of all events so far, and,
    once ``every`` new events have come, writes all figures of the graph as
    deposits of that batch. A batch writes what it touches; a repeated one writes
    the same again. Only a tick reads the whole graph."""
    edges, seeds = KeyedTable(spark, f"{table}/edges", ["a", "b"], buckets), KeyedTable(spark, f"{table}/seeds", ["node"], buckets)
    union = Union(spark, f"{table}/union", buckets)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = settled(batch, "batch")
        new_edges = settled(graph.edges(batch), "edges")
        edges.upsert(new_edges, batch_id)
        seeds.upsert(graph.dispute_seeds(batch), batch_id)
        union.add(new_edges, batch_id)
        new, last_seq, at = batch.agg(F.count(F.lit(1)), F.max("seq"), F.max("occurred_at")).first()
        before = spark.read.schema("pending long").parquet(f"{table}/pending/{batch_id - 1}").first() if batch_id else None
        pending = (before["pending"] if before else 0) + new
        if pending >= every:
            figures(edges.read(batch_id), seeds.read(batch_id), last_seq, at, p, union.components(batch_id)).write.mode("overwrite").parquet(f"{table}/deposits/batch={batch_id}")
            pending = 0
        spark.createDataFrame([(pending,)], "pending long").write.mode("overwrite").parquet(f"{table}/pending/{batch_id}")

    return sink


def figures(edges: DataFrame, seeds: DataFrame, seq: int, at: int, p: Params = DEFAULT, parts: DataFrame | None = None) -> DataFrame:
    """(seq, event_id, key, occurred_at, network_risk): a deposit for each keyed
    node of the graph as of one event."""
    risk = graph.network_risk(edges, seeds, p, parts=parts)
    return risk.select(F.lit(seq).cast("long").alias("seq"), deposit_id(F.lit("feature.network.deposited"), F.col("node"), F.lit(at)).alias("event_id"), "key", F.lit(at).cast("long").alias("occurred_at"), F.col("risk").alias("network_risk"))


def _manifest(spark: SparkSession, table: str, version: int) -> dict[int, int]:
    """Which version of each bucket is current; at most one row a bucket."""
    return {r["bucket"]: r["at"] for r in spark.read.parquet(f"{table}/manifest/{version}").collect()} if version >= 0 else {}


def merged_features(table: str, buckets: int = 64):
    """A ``foreachBatch`` sink that keeps under ``table`` the last deposit of
    each figure of each key, which is all that later batches need. Keys lie in
    buckets; a batch reads and writes only the buckets that it touches, and a
    manifest names the current file set of each. A repeated batch rewrites its
    own. The stream is deduplicated."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).persist()
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        held = _manifest(spark, table, batch_id - 1)
        new = rows
        for b in touched:
            if b in held:
                new = new.unionByName(spark.read.parquet(f"{table}/version={held[b]}/bucket={b}").withColumn("bucket", F.lit(b)))
        if touched:
            figure = F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in features.FIGURES])
            last = new.withColumn("_f", F.explode(F.array_append(F.array_compact(figure), F.lit("any")))).groupBy("bucket", "key", "_f").agg(F.max_by(F.struct(*batch.columns), "seq").alias("d"))
            last.select("bucket", "d.*").distinct().write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/version={batch_id}")
        rows.unpersist()
        held |= dict.fromkeys(touched, batch_id)
        spark.createDataFrame(sorted(held.items()), "bucket int, at int").coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/{batch_id}")

    return sink


def current_features(spark: SparkSession, table: str, version: int) -> DataFrame:
    """The feature rows as of a batch."""
    paths = [f"{table}/version={at}/bucket={b}" for b, at in sorted(_manifest(spark, table, version).items())]
    return features.merge_deposits(spark.read.parquet(*paths))


def reputations(stream: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Running reputation per agent, in update or complete mode."""
    return reputation(stream, p)


def last_rows(table: KeyedTable, order: str = "seq"):
    """A ``foreachBatch`` sink of a keyed table: the last row of each key of a
    batch, by ``order``, takes the place of the one that is held. For overlays,
    tokens and the liens of ``liens.lien_states``; rows without a key go."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in table.keys]
        rows = batch.where(" and ".join(f"`{k}` is not null" for k in table.keys))
        last = rows.groupBy(*table.keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*table.keys, "_r.*")
        table.upsert(last, batch_id)

    return sink
