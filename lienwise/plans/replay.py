"""A request log replayed: each allowed request spends its nonce and amount for
the later ones of its token.

Verdicts depend on earlier verdicts of the same token only, so the replay is a
fixed point: every round judges all requests against what the round before
allowed, until no verdict changes. A round settles at least the first open
request of every token, and in practice nearly all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import predicates
from ..params import DEFAULT, Params
from ..storage import settled
from .verdicts import decided

def replay(requests: DataFrame, tokens: DataFrame, overlays: DataFrame, now: int, p: Params = DEFAULT, max_rounds: int = 50) -> DataFrame:
    """``requests`` (with seq, risk, degraded, ts) to (evaluation_id, answer,
    code). Tokens and overlays as in verdicts.resolve."""
    pre = lambda df, x: df.select("token_id", *[F.col(c).alias(x + c) for c in df.columns if c != "token_id"])
    base = settled(requests.join(pre(tokens, "t_"), "token_id", "left").join(pre(overlays, "o_"), "token_id", "left"), "replay")
    allowed = base.select("evaluation_id", F.lit(False).alias("allowed"))
    earlier = Window.partitionBy("token_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    same_day = Window.partitionBy("token_id", "_day").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    same_nonce = Window.partitionBy("token_id", "nonce").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.when(F.col("allowed"), F.col("amount_paise")).otherwise(0)
    for _ in range(max_rounds):
        rows = base.join(allowed, "evaluation_id").withColumn("_day", (F.col("ts") / p.day_seconds).cast("long"))
        rows = rows.withColumn("b_consumed_total", F.coalesce(F.sum(spent).over(earlier), F.lit(0))).withColumn("b_consumed_today", F.coalesce(F.sum(spent).over(same_day), F.lit(0)))
        rows = rows.withColumn("nonce_spent", F.coalesce(F.max("allowed").over(same_nonce), F.lit(False)))
        verdict = decided(predicates.cascade(F.lit(now), p), S.expected_loss(F.col("risk"), F.col("amount_paise")), p)
        out = settled(rows.withColumn("v", verdict).select("evaluation_id", "v.answer", "v.code", F.col("allowed").alias("_was")), "replay")
        if not out.where("(answer = 'ALLOW') <> _was").head(1):
            return out.drop("_was")
        allowed = out.select("evaluation_id", (F.col("answer") == "ALLOW").alias("allowed"))
    raise RuntimeError("the replay did not settle")
