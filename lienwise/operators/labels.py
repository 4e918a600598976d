"""Settled outcomes as training labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import label_id
from ..params import DEFAULT, Params


def labels(log: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(event_id, token_id, value, weight, reason, occurred_at, seq) of a
    deduplicated log. A dispute and a cancellation are misuse; a capture whose
    nonce a step-up armed since the last capture of it or dispute of the token
    is confirmed use. Two windows replace the state machine."""
    before = lambda *k: Window.partitionBy(*k).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("type")
    rows = log.where(kind.isin("decision.made", "payment.captured", "payment.disputed", "token.cancelled") & (F.coalesce("token_id", F.lit("")) != ""))
    step_up = (kind == "decision.made") & (F.col("decision") == "STEP_UP") & (F.coalesce("nonce", F.lit("")) != "")
    rows = rows.withColumn("_dispute", F.max(F.when(kind == "payment.disputed", F.col("seq"))).over(before("token_id")))
    rows = rows.withColumn("_armed", F.max(F.when(step_up, F.col("seq"))).over(before("token_id", "nonce")))
    rows = rows.withColumn("_taken", F.max(F.when(kind == "payment.captured", F.col("seq"))).over(before("token_id", "nonce")))
    confirmed = (kind == "payment.captured") & (F.coalesce("nonce", F.lit("")) != "") & (F.col("_armed") > F.greatest(F.coalesce("_taken", F.lit(-1)), F.coalesce("_dispute", F.lit(-1))))
    reason = F.when(kind == "payment.disputed", "dispute").when(kind == "token.cancelled", "cancellation").when(confirmed, "confirmed_step_up")
    out = rows.withColumn("reason", reason).where("reason is not null")
    return out.select(
        label_id(F.col("reason"), F.col("event_id")).alias("event_id"),
        "token_id",
        F.when(F.col("reason") == "confirmed_step_up", 0.0).otherwise(1.0).alias("value"),
        F.when(F.col("reason") == "cancellation", p.cancellation_weight).otherwise(1.0).alias("weight"),
        "reason",
        "occurred_at",
        "seq",
    )


def label_set(found: DataFrame) -> DataFrame:
    """One label per token: misuse beats confirmed use, then the later."""
    best = found.groupBy("token_id").agg(F.max_by(F.struct("value", "weight", "reason", "occurred_at"), F.struct("value", "occurred_at", "seq")).alias("l"))
    return best.select("token_id", "l.*")


def tally(found: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("value") >= p.misuse_threshold, 1).otherwise(0)).alias("misuse"))
