"""Requests to verdicts: one plan of left joins and projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import blockstate, features, predicates
from ..params import DEFAULT, Params


def resolve(requests: DataFrame, tokens: DataFrame, blocks: DataFrame, overlays: DataFrame, spent: DataFrame) -> DataFrame:
    """Requests with their token (t_), block state (b_) and overlay (o_), and
    whether the nonce is spent. All joins share the key token_id."""
    pre = lambda df, p: df.select("token_id", *[F.col(c).alias(p + c) for c in df.columns if c != "token_id"])
    used = spent.select("token_id", "nonce", F.lit(True).alias("nonce_spent"))
    return requests.join(pre(tokens, "t_"), "token_id", "left").join(pre(blocks, "b_"), "token_id", "left").join(pre(overlays, "o_"), "token_id", "left").join(used, ["token_id", "nonce"], "left")


def linear_risk(p: Params = DEFAULT) -> Column:
    """The default scorer: a sigmoid over the weighted evidence of a row."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return S.risk_score(zero("e_behaviour_deviation"), zero("e_intent_divergence"), zero("e_network_risk"), F.col("consumption_frac"), zero("e_reputation"), p)


def decided(terminal: Column, loss: Column, p: Params = DEFAULT) -> Column:
    """(answer, code) of a row with degraded and tool_risk: the predicates'
    where one holds, else that of the loss; a tool of the highest risk is never
    allowed without a step up."""
    scored = S.decide(F.col("degraded"), loss, p.interruption_cost)
    floored = F.when((F.col("tool_risk") == 4) & (scored["answer"] == "ALLOW"), F.struct(F.lit("STEP_UP").alias("answer"), F.lit("STEPUP_RISK").alias("code"))).otherwise(scored)
    return F.when(terminal.isNotNull(), F.struct(terminal["answer"].alias("answer"), terminal["code"].alias("code"))).otherwise(floored)


def evaluate(requests: DataFrame, tokens: DataFrame, log: DataFrame, overlays: DataFrame, feature_rows: DataFrame, now: int, p: Params = DEFAULT, scorer: Callable[[Params], Column] = linear_risk) -> DataFrame:
    """The verdict of each request: the predicates' where one holds, else that
    of the score, failing closed where evidence is missing or stale. ``scorer``
    gives the risk as a column over the evidence e_*, consumption_frac and the
    columns of the request."""
    rows = resolve(requests, tokens, blockstate.block_state(log), overlays, blockstate.spent_nonces(log))
    rows = features.with_features(rows.withColumn("terminal", predicates.cascade(F.lit(now), p)), feature_rows, now, p)
    rows = rows.withColumn("consumption_frac", S.consumption_frac(F.col("b_consumed_total"), F.col("t_token_ceiling_paise")))
    rows = rows.withColumn("risk", scorer(p))
    rows = rows.withColumn("loss", S.expected_loss(F.col("risk"), F.col("amount_paise")))
    out = rows.withColumn("v", decided(F.col("terminal"), F.col("loss"), p))
    return out.select("*", F.col("v.answer").alias("answer"), F.col("v.code").alias("code"), F.col("terminal.predicate").alias("predicate_failed"), (F.col("v.answer") == "STEP_UP").alias("retryable")).drop("v", "terminal")


def request_digest(p: str = "") -> Column:
    """SHA-256 over the twelve fields of a request."""
    names = ("evaluation_id", "token_id", "customer_id", "agent_id", "merchant_id", "session_id", "amount_paise", "cart_hash", "envelope_digest", "tool_risk", "nonce", "ts")
    return S.digest(*[F.col(p + n) for n in names])


PROVENANCE = ("evaluation_id", "request_digest", "decision", "code", "predicate_failed", "evidence_digest", "policy_version")


def with_provenance(events: DataFrame, records: DataFrame) -> DataFrame:
    """Decision events (evaluation_id and more) that carry the record of their
    evaluation as ``provenance``; empty optional fields are null."""
    optional = ("predicate_failed", "evidence_digest")
    fields = [F.when(F.col(c) != "", F.col(c)).alias(c) if c in optional else F.col(c) for c in PROVENANCE]
    return events.join(records.select(F.col("evaluation_id"), F.struct(*fields).alias("provenance")), "evaluation_id", "left")


def records_of(events: DataFrame) -> DataFrame:
    """Ledger records rebuilt from decision events: one per evaluation, that of
    the first arrival; fields that were left out are empty, ts is the event's."""
    made = events.where((F.col("type") == "decision.made") & F.col("provenance").isNotNull())
    first = made.groupBy("evaluation_id").agg(F.min_by(F.struct("seq", "token_id", "provenance", "occurred_at"), "seq").alias("e"))
    fields = [F.coalesce(F.col(f"e.provenance.{c}"), F.lit("")).alias(c) if c not in ("evaluation_id", "policy_version") else F.col(f"e.provenance.{c}").alias(c) for c in PROVENANCE]
    return first.select("e.seq", "e.token_id", *fields, F.col("e.occurred_at").alias("ts"))


def session_tokens(requests: DataFrame) -> DataFrame:
    """(session_id, token_id, ts) of the first debit of each session."""
    rows = requests.where(F.coalesce("session_id", F.lit("")) != "")
    return rows.groupBy("session_id").agg(F.min_by(F.struct("token_id", "ts"), F.struct("ts", "evaluation_id")).alias("d")).select("session_id", "d.token_id", "d.ts")
