"""Feature rows: column-wise latest deposits, freshness and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import DEFAULT, Params
from ..storage import settled

FIGURES = ("behaviour_deviation", "intent_divergence", "network_risk", "reputation", "consumption_frac")


def merge_deposits(deposits: DataFrame) -> DataFrame:
    """Per key the last arrival of each figure (clamped), and computed_at of the
    last arrival of any. Columns: seq, event_id, key, occurred_at and figures,
    null where a deposit doesn't carry one. A deposit id counts once."""
    once = deposits.where(F.coalesce("key", F.lit("")) != "").groupBy("event_id").agg(F.min_by(F.struct(*[c for c in deposits.columns if c != "event_id"]), "seq").alias("d")).select("event_id", "d.*")
    figures = [F.max_by(S.clamp01(F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in FIGURES]
    return once.groupBy("key").agg(*figures, F.max_by("occurred_at", "seq").alias("computed_at"))


#: Feature rows that a broadcast may hold; beyond that, joins shuffle.
BROADCAST_ROWS = 1 << 20


def with_features(requests: DataFrame, features: DataFrame, now: int, p: Params = DEFAULT) -> DataFrame:
    """Requests with the evidence of four rows: behaviour and network of the
    customer, intent of the token, reputation of the agent; the merchant's row
    only has to be there. ``degraded`` if a wanted row is missing or stale.

    The feature rows of a kind are broadcast where their checked count is low.
    Agents and merchants are few and hot, so of theirs only the rows that the
    requests name are looked at; customers and tokens are joined by key."""
    features = settled(features.select("key", *FIGURES, "computed_at"), "features")
    few, rows, states = features.count() <= BROADCAST_ROWS, requests, []
    for kind, figures in (("customer", ("behaviour_deviation", "network_risk")), ("token", ("intent_divergence",)), ("agent", ("reputation",)), ("merchant", ())):
        column = f"{kind}_id"
        own = features
        if not few and kind in ("agent", "merchant"):
            own = settled(features.join(requests.select(F.col(column).alias("key")).distinct(), "key", "left_semi"), "features")
        side = own.select(F.col("key").alias(column), *[F.col(f).alias(f"e_{f}") for f in figures], S.freshness(F.col("computed_at"), F.lit(now), p.staleness_budget).alias(f"_{kind}"))
        rows = rows.join(F.broadcast(side) if few or own is not features and own.count() <= BROADCAST_ROWS else side, column, "left")
        states.append(F.when(F.coalesce(F.col(column), F.lit("")) != "", F.coalesce(F.col(f"_{kind}"), F.lit("missing"))))
    count = lambda state: sum((F.when(x == state, 1).otherwise(0) for x in states), F.lit(0))
    rows = rows.withColumns({"missing": count("missing"), "stale": count("stale")}).drop("_customer", "_token", "_agent", "_merchant")
    return rows.withColumn("degraded", F.col("missing") + F.col("stale") > 0)
