"""Lien state per token: spent amounts and nonces, folded in arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import day_of


def captures(log: DataFrame) -> DataFrame:
    """Captures that count: of a positive amount, with a token."""
    return log.where((F.col("type") == "payment.captured") & (F.col("amount_paise") > 0) & (F.coalesce("token_id", F.lit("")) != ""))


def running_consumption(log: DataFrame) -> DataFrame:
    """After each capture (deduplicated log): consumed_today, which starts anew
    whenever the day differs from that of the capture before, and consumed_total."""
    order = Window.partitionBy("token_id").orderBy("seq")
    rows = captures(log).withColumn("_day", day_of(F.col("occurred_at")))
    reset = F.coalesce(F.col("_day") != F.lag("_day").over(order), F.lit(True)) | (F.lag("occurred_at").over(order) == 0)
    rows = rows.withColumn("_island", F.sum(F.when(reset, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("consumed_total", F.sum("amount_paise").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    today = Window.partitionBy("token_id", "_island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("consumed_today", F.sum("amount_paise").over(today)).drop("_day", "_island")


def spent_nonces(log: DataFrame) -> DataFrame:
    """Distinct (token_id, nonce) of captures and allowed decisions, with the
    arrival of the first."""
    allowed = log.where((F.col("type") == "decision.made") & (F.col("decision") == "ALLOW"))
    both = captures(log).select("token_id", "nonce", "seq").unionByName(allowed.select("token_id", "nonce", "seq"))
    return both.where((F.coalesce("nonce", F.lit("")) != "") & (F.coalesce("token_id", F.lit("")) != "")).groupBy("token_id", "nonce").agg(F.min("seq").alias("first_seq"))


def nonce_set(log: DataFrame) -> DataFrame:
    """Per token the nonces in the order of their first use."""
    rows = spent_nonces(log).groupBy("token_id").agg(F.array_sort(F.collect_list(F.struct("first_seq", "nonce"))).alias("n"))
    return rows.select("token_id", F.transform("n", lambda x: x["nonce"]).alias("seen_nonces"))


def block_state(log: DataFrame) -> DataFrame:
    """The latest state per token with a capture."""
    last = running_consumption(log).groupBy("token_id").agg(F.max_by(F.struct("consumed_today", "consumed_total", "occurred_at"), "seq").alias("s"))
    return last.select("token_id", "s.consumed_today", "s.consumed_total", F.col("s.occurred_at").alias("last_computed_at"))
