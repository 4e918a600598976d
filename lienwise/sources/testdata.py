"""Domain tables as fixed projections of the general test tables.

``PRELUDE`` is the same in DuckDB SQL, for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_735_689_600
DUPLICATE_SHIFT = 100_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log; seq is the order of arrival."""
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind = F.col("event_type")
    k = F.col("k")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("e"), F.col("event_id")).alias("event_id"),
        F.when(kind.isin("click", "view"), "decision.made")
        .when(kind == "purchase", "payment.captured")
        .when(kind == "error", F.when(k % 4 == 0, "payment.disputed").otherwise("payment.failed"))
        .otherwise(F.when(k % 10 == 0, "token.cancelled").otherwise("token.confirmed"))
        .alias("type"),
        F.when(kind == "view", "STEP_UP").when(kind == "click", F.when(k % 3 == 0, "ALLOW").when(k % 3 == 1, "STEP_UP").otherwise("BLOCK")).alias("decision"),
        F.concat(F.lit("tok_"), "user_id").alias("token_id"),
        F.concat(F.lit("cust_"), "user_id").alias("customer_id"),
        F.concat(F.lit("agent_"), F.col("user_id") % 20).alias("agent_id"),
        F.concat(F.lit("m_"), k % 25).alias("merchant_id"),
        F.concat(F.lit("d_"), k).alias("device_id"),
        F.concat(F.lit("n"), k % 10).alias("nonce"),
        F.round(F.col("value") * 100).cast("long").alias("amount_paise"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("long").alias("occurred_at"),
        "k",
    )


def bus_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with redelivered events at a later seq, from one scan."""
    twice = F.when(F.col("k") % 7 == 0, F.array(F.col("seq"), F.col("seq") + DUPLICATE_SHIFT)).otherwise(F.array("seq"))
    return bus(spark, sf_dir).withColumn("seq", F.explode(twice))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    cap = F.lit(10_000_000) + F.abs(F.round(F.col("c_acctbal") * 100)).cast("long")
    key = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("tok_"), key).alias("token_id"),
        F.concat(F.lit("cust_"), key).alias("customer_id"),
        cap.alias("max_amount_paise"),
        (cap * 3).alias("max_per_day_paise"),
        (cap * 20).alias("token_ceiling_paise"),
        F.when(key % 13 == 0, NOW - 1000).otherwise(NOW + 1_000_000).cast("long").alias("expire_at"),
        F.when(key % 17 == 0, "cancelled").when(key % 17 == 1, "pending").otherwise("confirmed").alias("status"),
    )


def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").where("c_custkey % 5 = 0")
    cap = F.lit(10_000_000) + F.abs(F.round(F.col("c_acctbal") * 100)).cast("long")
    return c.select(F.concat(F.lit("tok_"), "c_custkey").alias("token_id"), (cap / 2).cast("long").alias("per_debit"), F.lit(None).cast("long").alias("per_day"), F.concat(F.lit("m_"), F.col("c_custkey") % 25).alias("denied_merchant"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders as requests."""
    o = read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    n = F.col("o_orderkey")
    customer = F.when(n % 31 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    return o.select(
        F.concat(F.lit("ev_"), n).alias("evaluation_id"),
        F.concat(F.lit("tok_"), "o_custkey").alias("token_id"),
        F.concat(F.lit("cust_"), customer).alias("customer_id"),
        F.concat(F.lit("agent_"), F.col("o_custkey") % 20).alias("agent_id"),
        F.concat(F.lit("m_"), n % 25).alias("merchant_id"),
        F.concat(F.lit("s_"), n).alias("session_id"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_paise"),
        F.when(n % 41 == 0, "").otherwise(F.concat(F.lit("cart"), n)).alias("cart_hash"),
        F.when(n % 19 == 0, "").otherwise(F.concat(F.lit("env"), n)).alias("envelope_digest"),
        (n % 5).cast("int").alias("tool_risk"),
        F.concat(F.lit("n"), n % 10).alias("nonce"),
        F.lit("caller").alias("caller_id"),
        F.when(n % 23 == 0, 50_000_000).cast("long").alias("envelope_max_paise"),
        F.when(n % 37 == 0, 1).cast("long").alias("bound_amount_paise"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)").cast("long").alias("ts"),
    )


def lien_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled orders as captures."""
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    n = F.col("o_orderkey")
    return o.select(
        n.alias("seq"),
        F.concat(F.lit("c"), n).alias("event_id"),
        F.lit("payment.captured").alias("type"),
        F.lit(None).cast("string").alias("decision"),
        F.concat(F.lit("tok_"), "o_custkey").alias("token_id"),
        F.concat(F.lit("n"), n % 10).alias("nonce"),
        F.round(F.col("o_totalprice") * 10).cast("long").alias("amount_paise"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)").cast("long").alias("occurred_at"),
    )


def deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures deposited per customer, token, agent and merchant by the log's
    latest events, from one scan; dated so that some are stale."""
    k, unit = F.col("k"), (F.col("amount_paise") % 1000) / 1000.0
    names = ("behaviour_deviation", "intent_divergence", "network_risk", "reputation", "consumption_frac")

    def one(kind: str, key: str, only, figure: str, value):
        figures = [(value if c == figure else F.lit(None)).cast("double").alias(c) for c in names]
        return F.when(only, F.struct(F.concat(F.lit(kind + ":"), "event_id").alias("event_id"), F.col(key).alias("key"), *figures))

    each = F.array(
        one("b", "customer_id", k % 2 == 0, "behaviour_deviation", unit * 1.25 - 0.1),
        one("n", "customer_id", k % 3 == 0, "network_risk", unit),
        one("i", "token_id", k % 2 == 1, "intent_divergence", unit),
        one("r", "agent_id", k % 5 == 0, "reputation", unit),
        one("m", "merchant_id", (k % 5).isin(1, 4), "consumption_frac", unit),
    )
    rows = bus_dup(spark, sf_dir).select("seq", (F.lit(NOW) - k * 3).cast("long").alias("occurred_at"), F.explode(F.array_compact(each)).alias("d"))
    return rows.select("seq", "d.event_id", "d.key", "occurred_at", *[f"d.{c}" for c in names])


PRELUDE = f"""
bus AS (
  SELECT event_id AS seq, 'e' || event_id AS event_id,
    CASE WHEN event_type IN ('click', 'view') THEN 'decision.made' WHEN event_type = 'purchase' THEN 'payment.captured'
      WHEN event_type = 'error' THEN CASE WHEN k % 4 = 0 THEN 'payment.disputed' ELSE 'payment.failed' END
      ELSE CASE WHEN k % 10 = 0 THEN 'token.cancelled' ELSE 'token.confirmed' END END AS type,
    CASE WHEN event_type = 'view' THEN 'STEP_UP' WHEN event_type = 'click' THEN CASE k % 3 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'STEP_UP' ELSE 'BLOCK' END END AS decision,
    'tok_' || user_id AS token_id, 'cust_' || user_id AS customer_id, 'agent_' || (user_id % 20) AS agent_id,
    'm_' || (k % 25) AS merchant_id, 'd_' || k AS device_id, 'n' || (k % 10) AS nonce,
    CAST(round(value * 100) AS BIGINT) AS amount_paise, CAST(floor(epoch(ts)) AS BIGINT) AS occurred_at, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
bus_dup AS (SELECT * FROM bus UNION ALL SELECT * REPLACE (seq + {DUPLICATE_SHIFT} AS seq) FROM bus WHERE k % 7 = 0),
caps AS (SELECT c_custkey AS n, 10000000 + CAST(abs(round(c_acctbal * 100)) AS BIGINT) AS cap FROM customer),
tokens AS (SELECT 'tok_' || n AS token_id, 'cust_' || n AS customer_id, cap AS max_amount_paise, cap * 3 AS max_per_day_paise, cap * 20 AS token_ceiling_paise,
  CASE WHEN n % 13 = 0 THEN {NOW - 1000} ELSE {NOW + 1_000_000} END AS expire_at, CASE n % 17 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'pending' ELSE 'confirmed' END AS status FROM caps),
overlays AS (SELECT 'tok_' || n AS token_id, cap // 2 AS per_debit, 'm_' || (n % 25) AS denied_merchant FROM caps WHERE n % 5 = 0),
requests AS (SELECT 'ev_' || o_orderkey AS evaluation_id, 'tok_' || o_custkey AS token_id,
    'cust_' || (o_custkey + CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END) AS customer_id, 'agent_' || (o_custkey % 20) AS agent_id,
    'm_' || (o_orderkey % 25) AS merchant_id, 's_' || o_orderkey AS session_id, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_paise,
    CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'cart' || o_orderkey END AS cart_hash, CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'env' || o_orderkey END AS envelope_digest,
    o_orderkey % 5 AS tool_risk, 'n' || (o_orderkey % 10) AS nonce, 'caller' AS caller_id,
    CASE WHEN o_orderkey % 23 = 0 THEN 50000000 END AS envelope_max_paise, CASE WHEN o_orderkey % 37 = 0 THEN 1 END AS bound_amount_paise,
    CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts
  FROM orders WHERE o_orderstatus <> 'F'),
lien AS (SELECT o_orderkey AS seq, 'tok_' || o_custkey AS token_id, 'n' || (o_orderkey % 10) AS nonce, CAST(round(o_totalprice * 10) AS BIGINT) AS amount_paise,
    CAST(floor(epoch(o_orderdate)) AS BIGINT) AS occurred_at FROM orders WHERE o_orderstatus = 'F'),
lien_days AS (SELECT *, occurred_at // 86400 AS d, lag(occurred_at // 86400) OVER (PARTITION BY token_id ORDER BY seq) AS pd FROM lien WHERE amount_paise > 0),
lien_isl AS (SELECT *, sum(CASE WHEN pd IS NULL OR pd <> d THEN 1 ELSE 0 END) OVER (PARTITION BY token_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS isl FROM lien_days),
lien_run AS (SELECT seq, token_id, occurred_at, CAST(sum(amount_paise) OVER (PARTITION BY token_id, isl ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consumed_today,
    CAST(sum(amount_paise) OVER (PARTITION BY token_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consumed_total FROM lien_isl),
blocks AS (SELECT token_id, arg_max(consumed_today, seq) AS consumed_today, arg_max(consumed_total, seq) AS consumed_total, arg_max(occurred_at, seq) AS last_computed_at FROM lien_run GROUP BY token_id),
spent AS (SELECT DISTINCT token_id, nonce FROM lien WHERE amount_paise > 0),
deposits AS (
  SELECT seq, 'b:' || event_id AS event_id, customer_id AS key, {NOW} - k * 3 AS occurred_at, (amount_paise % 1000) / 1000.0 * 1.25 - 0.1 AS behaviour_deviation, NULL::DOUBLE AS intent_divergence, NULL::DOUBLE AS network_risk, NULL::DOUBLE AS reputation, NULL::DOUBLE AS consumption_frac FROM bus_dup WHERE k % 2 = 0
  UNION ALL SELECT seq, 'n:' || event_id, customer_id, {NOW} - k * 3, NULL, NULL, (amount_paise % 1000) / 1000.0, NULL, NULL FROM bus_dup WHERE k % 3 = 0
  UNION ALL SELECT seq, 'i:' || event_id, token_id, {NOW} - k * 3, NULL, (amount_paise % 1000) / 1000.0, NULL, NULL, NULL FROM bus_dup WHERE k % 2 = 1
  UNION ALL SELECT seq, 'r:' || event_id, agent_id, {NOW} - k * 3, NULL, NULL, NULL, (amount_paise % 1000) / 1000.0, NULL FROM bus_dup WHERE k % 5 = 0
  UNION ALL SELECT seq, 'm:' || event_id, merchant_id, {NOW} - k * 3, NULL, NULL, NULL, NULL, (amount_paise % 1000) / 1000.0 FROM bus_dup WHERE k % 5 IN (1, 4)),
dep1 AS (SELECT * FROM deposits QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1),
features AS (SELECT key, CASE WHEN count(behaviour_deviation) > 0 THEN greatest(0.0, least(1.0, arg_max(behaviour_deviation, seq) FILTER (behaviour_deviation IS NOT NULL))) END AS behaviour_deviation,
    CASE WHEN count(intent_divergence) > 0 THEN greatest(0.0, least(1.0, arg_max(intent_divergence, seq) FILTER (intent_divergence IS NOT NULL))) END AS intent_divergence,
    CASE WHEN count(network_risk) > 0 THEN greatest(0.0, least(1.0, arg_max(network_risk, seq) FILTER (network_risk IS NOT NULL))) END AS network_risk,
    CASE WHEN count(reputation) > 0 THEN greatest(0.0, least(1.0, arg_max(reputation, seq) FILTER (reputation IS NOT NULL))) END AS reputation,
    CASE WHEN count(consumption_frac) > 0 THEN greatest(0.0, least(1.0, arg_max(consumption_frac, seq) FILTER (consumption_frac IS NOT NULL))) END AS consumption_frac,
    arg_max(occurred_at, seq) AS computed_at FROM dep1 GROUP BY key),
resolved AS (SELECT r.*, t.customer_id AS t_customer, t.max_amount_paise, t.max_per_day_paise, t.token_ceiling_paise, t.expire_at, t.status, b.consumed_today, b.consumed_total, o.per_debit, o.denied_merchant, s.nonce IS NOT NULL AS nonce_spent
  FROM requests r LEFT JOIN tokens t USING (token_id) LEFT JOIN blocks b USING (token_id) LEFT JOIN overlays o USING (token_id) LEFT JOIN spent s ON s.token_id = r.token_id AND s.nonce = r.nonce),
flags AS (SELECT *, nonce_spent AND nonce <> '' AS p1, caller_id = '' OR t_customer IS NULL OR t_customer <> customer_id AS p5,
    coalesce(status <> 'confirmed', false) OR coalesce(expire_at > 0 AND {NOW} > expire_at, false) OR coalesce(coalesce(consumed_total, 0) + amount_paise > token_ceiling_paise, false) AS p4,
    cart_hash = '' OR (coalesce(bound_amount_paise, 0) > 0 AND bound_amount_paise <> amount_paise) AS p6,
    coalesce(denied_merchant = merchant_id, false) OR coalesce(amount_paise > least(max_amount_paise, coalesce(per_debit, max_amount_paise)), false) OR coalesce(coalesce(consumed_today, 0) + amount_paise > max_per_day_paise, false) AS p2,
    (envelope_digest = '' AND amount_paise > 100000) OR (coalesce(envelope_max_paise, 0) > 0 AND amount_paise > envelope_max_paise AND amount_paise > 100000) AS p3 FROM resolved),
casc AS (SELECT *, CASE WHEN p1 THEN 'P1' WHEN p5 THEN 'P5' WHEN p4 THEN 'P4' WHEN p6 THEN 'P6' WHEN p2 THEN 'P2' WHEN p3 THEN 'P3' END AS predicate FROM flags),
evid AS (SELECT c.*, fc.behaviour_deviation AS e_b, ft.intent_divergence AS e_i, fc.network_risk AS e_n, fa.reputation AS e_r,
    fc.key IS NULL OR ft.key IS NULL OR fa.key IS NULL OR fm.key IS NULL OR {NOW} - fc.computed_at > 300 OR {NOW} - ft.computed_at > 300 OR {NOW} - fa.computed_at > 300 OR {NOW} - fm.computed_at > 300 AS degraded,
    CASE WHEN consumed_total IS NULL OR token_ceiling_paise IS NULL OR token_ceiling_paise <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, consumed_total / token_ceiling_paise)) END AS frac
  FROM casc c LEFT JOIN features fc ON fc.key = c.customer_id LEFT JOIN features ft ON ft.key = c.token_id LEFT JOIN features fa ON fa.key = c.agent_id LEFT JOIN features fm ON fm.key = c.merchant_id),
scored AS (SELECT *, 1 / (1 + exp(-(-2.2 + 1.5 * coalesce(e_b, 0) + 1.5 * coalesce(e_i, 0) + 1.2 * coalesce(e_n, 0) + 0.8 * frac - 1.0 * coalesce(e_r, 0)))) AS p FROM evid),
decided AS (SELECT *, CASE WHEN degraded THEN 'STEPUP_FAILCLOSED' WHEN trunc(p * amount_paise) > 5000000 THEN 'STEPUP_RISK' ELSE 'OK_ALLOW' END AS risk_code FROM scored),
verdicts AS (SELECT *, CASE predicate WHEN 'P1' THEN 'BLOCKED_DUPLICATE' WHEN 'P5' THEN 'BLOCKED_IDENTITY' WHEN 'P4' THEN 'BLOCKED_AUTHORITY' WHEN 'P6' THEN 'BLOCKED_BINDING' WHEN 'P2' THEN 'STEPUP_SCOPE' WHEN 'P3' THEN 'STEPUP_UNBOUND'
    ELSE CASE WHEN risk_code = 'OK_ALLOW' AND tool_risk = 4 THEN 'STEPUP_RISK' ELSE risk_code END END AS code FROM decided),
verdict AS (SELECT *, CASE WHEN code LIKE 'BLOCKED%' THEN 'BLOCK' WHEN code = 'OK_ALLOW' THEN 'ALLOW' ELSE 'STEP_UP' END AS answer FROM verdicts)
"""
