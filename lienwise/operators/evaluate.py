"""Evaluation of verdicts against what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISIONS = ["ALLOW", "STEP_UP", "BLOCK"]


def per_debit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected rows with the actual verdict; those without are unevaluated."""
    rows = expected.join(actual, "evaluation_id", "left").withColumn("evaluated", F.col("actual_decision").isNotNull())
    match = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return rows.withColumn("decision_match", match("expected_decision", "actual_decision")).withColumn("code_match", match("expected_code", "actual_code"))


def confusion(rows: DataFrame) -> DataFrame:
    out = rows.where("evaluated").groupBy("expected_decision").pivot("actual_decision", DECISIONS).agg(F.count(F.lit(1)))
    return out.select("expected_decision", *[F.coalesce(d, F.lit(0)).alias(d) for d in DECISIONS])


def accuracy(rows: DataFrame) -> DataFrame:
    """Per family and, as family null, over all; unevaluated rows count."""
    n = F.count(F.lit(1))
    hit = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    return rows.rollup("family").agg(n.alias("n"), hit("evaluated").alias("evaluated"), F.round(hit("decision_match") / n, 4).alias("decision_accuracy"), F.round(hit("code_match") / n, 4).alias("code_accuracy"), F.bool_or("is_misuse").alias("is_misuse"))


def expected_loss(rows: DataFrame) -> DataFrame:
    """Gated, leaked and friction counts and sums over evaluated rows."""
    gate, held = F.col("expected_decision") != "ALLOW", F.col("actual_decision") != "ALLOW"
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    paise = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount_paise")).otherwise(0)), F.lit(0))
    return (
        rows.where("evaluated")
        .agg(count(gate).alias("gate_expected"), count(gate & held).alias("gated"), count(gate & ~held).alias("leaked"), paise(gate).alias("at_risk_paise"), paise(gate & held).alias("gated_paise"), paise(gate & ~held).alias("leaked_paise"), count(~gate & held).alias("false_friction"), count(~gate).alias("allow_expected"))
        .withColumn("recall", F.when(F.col("gate_expected") > 0, F.round(F.col("gated") / F.col("gate_expected"), 4)).otherwise(0.0))
    )


def label_breakdown(observed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Counts by reason on both sides, 0 where one has none."""
    a = observed.groupBy("reason").agg(F.count(F.lit(1)).alias("observed"))
    b = wanted.groupBy("reason").agg(F.count(F.lit(1)).alias("expected"))
    return a.join(b, "reason", "full_outer").select("reason", F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("expected", F.lit(0)).alias("expected"))


def percentiles(rows: DataFrame, column: str, points: list[float]) -> DataFrame:
    """Nearest-rank percentiles."""
    return rows.agg(*[F.expr(f"percentile_disc({p}) within group (order by `{column}`)").cast(rows.schema[column].dataType).alias(f"p{round(p * 100)}") for p in points])


def headline(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(n.alias("requests"), F.sum(F.when(F.col("evaluated"), 1).otherwise(0)).alias("evaluated"), F.round(F.sum(F.when(F.col("decision_match"), 1).otherwise(0)) / n, 4).alias("decision_accuracy"), F.round(F.sum(F.when(F.col("code_match"), 1).otherwise(0)) / n, 4).alias("code_accuracy"))
