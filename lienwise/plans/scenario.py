"""A deterministic synthetic world: families of requests whose right verdicts
are known, for end-to-end evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_700_000_000
#: family: (right code, misuse, risk, amount in paise)
FAMILIES = {
    "legit": ("OK_ALLOW", False, 0.05, 60_000),
    "cautious": ("STEPUP_RISK", False, 0.95, 180_000),
    "intent_drift": ("STEPUP_RISK", True, 0.90, 150_000),
    "scope_denied": ("STEPUP_SCOPE", True, 0.05, 50_000),
    "scope_over_cap": ("STEPUP_SCOPE", True, 0.05, 190_000),
    "velocity_bustout": ("STEPUP_RISK", True, 0.92, 170_000),
    "replay": ("BLOCKED_DUPLICATE", True, 0.05, 40_000),
    "revoked": ("BLOCKED_AUTHORITY", True, 0.05, 50_000),
    "expired": ("BLOCKED_AUTHORITY", True, 0.05, 50_000),
    "fan_in": ("STEPUP_RISK", True, 0.93, 160_000),
    "device_ring": ("STEPUP_RISK", True, 0.94, 165_000),
    "fleet": ("STEPUP_RISK", True, 0.91, 155_000),
}
COST = 100_000


def world(spark: SparkSession, each: int = 6) -> dict[str, DataFrame]:
    """tokens, overlays, requests and expected verdicts; ``each`` sessions a
    family. A replayed request comes after an allowed one of its nonce."""
    kinds = spark.createDataFrame([(i, f, *v) for i, (f, v) in enumerate(FAMILIES.items())], "fid int, family string, code string, is_misuse boolean, risk double, amount_paise long")
    rows = kinds.crossJoin(F.broadcast(spark.range(each).withColumnRenamed("id", "n"))).withColumn("uid", F.col("fid") * each + F.col("n"))
    token = F.concat(F.lit("tok-"), "uid")
    tokens = rows.select(
        token.alias("token_id"),
        F.concat(F.lit("cus-"), "uid").alias("customer_id"),
        F.lit(200_000).cast("long").alias("max_amount_paise"),
        F.lit(500_000).cast("long").alias("max_per_day_paise"),
        F.lit(2_000_000).cast("long").alias("token_ceiling_paise"),
        F.when(F.col("family") == "expired", NOW - 1).otherwise(NOW + 3600).cast("long").alias("expire_at"),
        F.when(F.col("family") == "revoked", "cancelled").otherwise("confirmed").alias("status"),
    )
    overlays = rows.where("family like 'scope%'").select(token.alias("token_id"), F.when(F.col("family") == "scope_over_cap", 100_000).cast("long").alias("per_debit"), F.lit(None).cast("long").alias("per_day"), F.when(F.col("family") == "scope_denied", "mer-denied").alias("denied_merchant"))
    steps = rows.withColumn("step", F.explode(F.when(F.col("family") == "replay", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    first = (F.col("family") == "replay") & (F.col("step") == 0)
    requests = steps.select(
        F.concat(F.lit("evl-"), "uid", F.lit("-"), "step").alias("evaluation_id"),
        (F.col("uid") * 2 + F.col("step")).cast("long").alias("seq"),
        token.alias("token_id"),
        F.concat(F.lit("cus-"), "uid").alias("customer_id"),
        F.when(F.col("family") == "scope_denied", "mer-denied").otherwise("mer-1").alias("merchant_id"),
        "amount_paise",
        F.lit("cart").alias("cart_hash"),
        F.lit("env").alias("envelope_digest"),
        F.lit(1).alias("tool_risk"),
        F.concat(F.lit("non-"), "uid").alias("nonce"),
        F.lit("caller").alias("caller_id"),
        F.lit(None).cast("long").alias("envelope_max_paise"),
        F.lit(None).cast("long").alias("bound_amount_paise"),
        F.lit(NOW).cast("long").alias("ts"),
        "risk",
        F.lit(False).alias("degraded"),
        "family",
    )
    code = F.when(first, "OK_ALLOW").otherwise(F.col("code"))
    expected = steps.select(F.concat(F.lit("evl-"), "uid", F.lit("-"), "step").alias("evaluation_id"), "family", "is_misuse", "amount_paise", F.when(code == "OK_ALLOW", "ALLOW").when(code.startswith("BLOCKED"), "BLOCK").otherwise("STEP_UP").alias("expected_decision"), code.alias("expected_code"))
    return {"tokens": tokens, "overlays": overlays, "requests": requests, "expected": expected}
