"""Agent reputation: a Beta-Bernoulli rate with a prior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp01
from ..params import DEFAULT, Params


def reputation(log: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per agent of a deduplicated log: captures are successes, failures count
    once and disputes several times as failures."""
    rows = log.where((F.coalesce("agent_id", F.lit("")) != "") & F.col("type").isin("payment.captured", "payment.failed", "payment.disputed"))
    good, bad = F.col("successes"), F.col("failures")
    sums = rows.groupBy("agent_id").agg(
        F.sum(F.when(F.col("type") == "payment.captured", 1.0).otherwise(0.0)).alias("successes"),
        F.sum(F.when(F.col("type") == "payment.failed", 1.0).when(F.col("type") == "payment.disputed", p.dispute_weight).otherwise(0.0)).alias("failures"),
    )
    return sums.withColumn("reputation", clamp01((good + p.prior_strength * p.prior_reputation) / (good + bad + p.prior_strength)))
