"""Every operator as a named query over the test tables, with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import behaviour, blockstate, evaluate, features, graph, intent, ledger, log, predicates, quantiles, reputation, sketches, training, vault
from .operators import labels as labelling
from .params import Params
from .plans import replay, scenario, verdicts
from .sources import connectors
from .sources import testdata as T
from .storage import settled
from .streaming import liens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LIVE = Params(interruption_cost=5_000_000)


def query(sql: str | None = None, more: str = "", recursive: bool = False):
    """Registers a function as the query of its name; ``sql`` follows the
    prelude of domain tables and the tables ``more``."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{T.PRELUDE.strip()}{',' + more if more else ''}\n{sql}"
        return f

    return register


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


# --- the log


@query("SELECT seq, event_id FROM bus_dup QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1")
def win_dedupe_event(spark, d):
    return log.dedupe(T.bus_dup(spark, d)).select("seq", "event_id")


@query("SELECT type, count(*) AS n FROM bus WHERE type IN ('payment.captured', 'payment.failed', 'payment.disputed') GROUP BY type")
def filt_event_type(spark, d):
    return log.of_types(T.bus(spark, d), "payment.captured", "payment.failed", "payment.disputed").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM bus WHERE k % 6 <> 0")
def filt_drop_keyless(spark, d):
    rows = T.bus(spark, d).withColumn("agent_id", F.when(F.col("k") % 6 == 0, "").otherwise(F.col("agent_id")))
    return log.keyed(rows, "event_id", "agent_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN type = 'decision.made' THEN 'evaluations.v1' WHEN type LIKE 'payment%' THEN 'payments.v1' ELSE 'tokens.v1' END AS topic, count(*) AS n FROM bus GROUP BY 1")
def proj_topic_for(spark, d):
    return log.routed(T.bus(spark, d)).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def proj_payload_read(spark, d):
    raw = T.read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("props").alias("payload"))
    return log.decode(raw, "k long").select("seq", "payload.k")


@query("SELECT sha1(concat_ws(':', 'feature.behaviour.deposited', customer_id, occurred_at)) AS id, count(*) AS n FROM bus GROUP BY 1")
def fn_deposit_id(spark, d):
    b = T.bus(spark, d)
    return b.groupBy(S.deposit_id(F.lit("feature.behaviour.deposited"), F.col("customer_id"), F.col("occurred_at")).alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN k % 3 = 0 THEN customer_id ELSE agent_id END AS principal, CASE WHEN k % 2 = 0 THEN token_id ELSE 's' || k END AS intent_key FROM bus")
def fn_principal_of(spark, d):
    b = T.bus(spark, d)
    agent = F.when(F.col("k") % 3 == 0, "").otherwise(F.col("agent_id"))
    session = F.when(F.col("k") % 2 == 0, "").otherwise(F.concat(F.lit("s"), "k"))
    return b.select("event_id", S.principal_of(agent, F.col("customer_id"), F.col("token_id")).alias("principal"), S.intent_key(session, F.col("token_id")).alias("intent_key"))


@query("SELECT 'token:' || token_id AS node, 'token' AS kind, token_id AS bare, count(*) AS n FROM bus GROUP BY ALL")
def fn_node_id(spark, d):
    node = S.node_id("token", F.col("token_id"))
    return T.bus(spark, d).select(node.alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).select("node", S.node_type(F.col("node")).alias("kind"), S.bare_id(F.col("node")).alias("bare"), "n")


@query("SELECT event_id, '₹' || format('{:,.2f}', amount_paise / 100.0) AS rupees FROM bus")
def fn_rupees(spark, d):
    return T.bus(spark, d).select("event_id", S.rupees(F.col("amount_paise")).alias("rupees"))


@query()
def fn_hmac(spark, d):
    b = T.bus(spark, d)
    return b.select("event_id", S.hmac_sha256(F.encode("token_id", "UTF-8"), F.col("event_id")).alias("mac"))


@query("SELECT CASE WHEN event_type = 'click' THEN 'ALLOW' ELSE upper(event_type) END AS decision, count(*) AS n FROM events GROUP BY 1")
def proj_normalise_decision(spark, d):
    raw = F.when(F.col("event_type") == "click", "ANSWER_ALLOW").otherwise(F.upper("event_type"))
    return T.read(spark, d, "events").groupBy(S.normalise_decision(raw).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


# --- lien state

_RUN = """
caps_days AS (SELECT *, occurred_at // 86400 AS d, lag(occurred_at // 86400) OVER (PARTITION BY token_id ORDER BY seq) AS pd FROM bus WHERE type = 'payment.captured' AND amount_paise > 0),
caps_isl AS (SELECT *, sum(CASE WHEN pd IS NULL OR pd <> d THEN 1 ELSE 0 END) OVER (PARTITION BY token_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS isl FROM caps_days),
run AS (SELECT seq, token_id, occurred_at, CAST(sum(amount_paise) OVER (PARTITION BY token_id, isl ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consumed_today, CAST(sum(amount_paise) OVER (PARTITION BY token_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consumed_total FROM caps_isl)"""


@query("SELECT seq, token_id, consumed_today, consumed_total FROM run", _RUN)
def win_consumed_running(spark, d):
    return blockstate.running_consumption(log.dedupe(T.bus_dup(spark, d))).select("seq", "token_id", "consumed_today", "consumed_total")


@query("SELECT * FROM blocks")
def agg_consumption(spark, d):
    return blockstate.block_state(T.lien_log(spark, d))


_NONCES = """
uses AS (SELECT token_id, nonce, min(seq) AS s FROM bus WHERE (type = 'payment.captured' AND amount_paise > 0) OR (type = 'decision.made' AND decision = 'ALLOW') GROUP BY ALL)"""


@query("SELECT token_id, string_agg(nonce, ',' ORDER BY s, nonce) AS nonces FROM uses GROUP BY token_id", _NONCES)
def agg_nonce_set(spark, d):
    return blockstate.nonce_set(log.dedupe(T.bus_dup(spark, d))).select("token_id", F.array_join("seen_nonces", ",").alias("nonces"))


@query("SELECT token_id, nonce FROM bus WHERE type = 'payment.captured' AND amount_paise > 0 UNION SELECT token_id, nonce FROM bus WHERE type = 'decision.made' AND decision = 'ALLOW'")
def set_union_nonces(spark, d):
    return blockstate.spent_nonces(T.bus(spark, d)).select("token_id", "nonce")


@query("SELECT r.token_id, arg_max(consumed_today, r.seq) AS consumed_today, arg_max(consumed_total, r.seq) AS consumed_total, arg_max(occurred_at, r.seq) AS last_computed_at, any_value(n) AS nonces FROM run r LEFT JOIN (SELECT token_id, count(*) AS n FROM uses GROUP BY token_id) u ON u.token_id = r.token_id GROUP BY r.token_id", _RUN + ", " + _NONCES)
def st_block_fold(spark, d):
    """The first half of the log as a batch, the rest folded from its snapshot."""
    b = T.bus(spark, d)
    half = b.agg(F.max("seq")).first()[0] // 2
    start = settled(liens.snapshot(b.where(F.col("seq") <= half)), "liens")
    state = liens.current(start, settled(liens.lien_states(b.where(F.col("seq") > half), start), "liens"))
    sums = state.where("nonce = ''").select("token_id", "consumed_today", "consumed_total", "last_computed_at")
    return sums.join(state.where("nonce <> ''").groupBy("token_id").agg(F.count(F.lit(1)).alias("nonces")), "token_id", "left")


@query("SELECT t.token_id, round(CASE WHEN b.token_id IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, consumed_total / token_ceiling_paise)) END, 6) AS frac FROM tokens t LEFT JOIN blocks b USING (token_id)")
def join_consumption(spark, d):
    rows = T.tokens(spark, d).join(blockstate.block_state(T.lien_log(spark, d)), "token_id", "left")
    return rows.select("token_id", F.round(S.consumption_frac(F.col("consumed_total"), F.col("token_ceiling_paise")), 6).alias("frac"))


@query("SELECT token_id, max_amount_paise % 7 <> 0 AS valid FROM tokens")
def chk_containment(spark, d):
    t = T.tokens(spark, d).withColumn("max_per_day_paise", F.when(F.col("max_amount_paise") % 7 == 0, F.col("max_amount_paise") - 1).otherwise(F.col("max_per_day_paise")))
    good, bad = connectors.contained(t)
    return good.select("token_id", F.lit(True).alias("valid")).unionByName(bad.select("token_id", F.lit(False).alias("valid")))


@query("SELECT token_id, CASE WHEN max_amount_paise % 3 = 0 THEN 'cancelled' ELSE status END AS status FROM tokens")
def sink_token_upsert(spark, d):
    t = T.tokens(spark, d).withColumn("version", F.lit(1))
    new = t.where("max_amount_paise % 3 = 0").withColumn("status", F.lit("cancelled")).withColumn("version", F.lit(2))
    return connectors.upsert(t, new, "token_id", "version").select("token_id", "status")


# --- verdicts


def _inputs(spark, d):
    return T.requests(spark, d), T.tokens(spark, d), T.lien_log(spark, d), T.overlays(spark, d), features.merge_deposits(T.deposits(spark, d))


def evaluated(spark, d) -> DataFrame:
    return verdicts.evaluate(*_inputs(spark, d), T.NOW, LIVE)


def _resolved(spark, d):
    r, t, lien, o, _ = _inputs(spark, d)
    return verdicts.resolve(r, t, blockstate.block_state(lien), o, blockstate.spent_nonces(lien))


@query("SELECT evaluation_id, status, consumed_total, per_debit, nonce_spent FROM resolved")
def join_resolve(spark, d):
    return _resolved(spark, d).select("evaluation_id", F.col("t_status").alias("status"), F.col("b_consumed_total").alias("consumed_total"), F.col("o_per_debit").alias("per_debit"), F.coalesce("nonce_spent", F.lit(False)).alias("nonce_spent"))


for _name, _flag, _make in (
    ("pred_p1_replay", "p1", predicates.replayed),
    ("pred_p2_scope", "p2", predicates.out_of_scope),
    ("pred_p3_unbound", "p3", predicates.no_intent),
    ("pred_p4_authority", "p4", lambda: predicates.no_authority(F.lit(T.NOW))),
    ("pred_p5_identity", "p5", predicates.wrong_identity),
    ("pred_p6_binding", "p6", predicates.unbound_cart),
):

    def _one(spark, d, make=_make):
        return _resolved(spark, d).where(make()).select("evaluation_id")

    _one.__name__ = _name
    query(f"SELECT evaluation_id FROM flags WHERE {_flag}")(_one)


@query("SELECT evaluation_id, predicate FROM casc")
def pred_cascade(spark, d):
    return _resolved(spark, d).select("evaluation_id", predicates.cascade(F.lit(T.NOW))["predicate"].alias("predicate"))


@query("SELECT evaluation_id, answer, code, answer = 'STEP_UP' AS retryable FROM verdict")
def proj_verdict(spark, d):
    return evaluated(spark, d).select("evaluation_id", "answer", "code", "retryable")


@query("SELECT answer, code, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS amount_paise FROM verdict GROUP BY ALL")
def verdict_summary(spark, d):
    return evaluated(spark, d).groupBy("answer", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_paise").alias("amount_paise"))


@query("SELECT evaluation_id, 'STEPUP_RISK' AS code FROM scored WHERE predicate IS NULL AND NOT degraded AND trunc(p * amount_paise) <= 50000000 AND tool_risk = 4")
def proj_tool_floor(spark, d):
    lenient = Params(interruption_cost=50_000_000)
    v = verdicts.evaluate(*_inputs(spark, d), T.NOW, lenient)
    return v.where((F.col("answer") == "STEP_UP") & F.col("predicate_failed").isNull() & ~F.col("degraded") & (F.col("tool_risk") == 4) & (F.col("loss") <= lenient.interruption_cost)).select("evaluation_id", "code")


@query("SELECT evaluation_id, sha256(evaluation_id || chr(31) || token_id || chr(31) || customer_id || chr(31) || agent_id || chr(31) || merchant_id || chr(31) || session_id || chr(31) || amount_paise || chr(31) || cart_hash || chr(31) || envelope_digest || chr(31) || tool_risk || chr(31) || nonce || chr(31) || ts) AS digest FROM requests")
def proj_request_digest(spark, d):
    return T.requests(spark, d).select("evaluation_id", verdicts.request_digest().alias("digest"))


@query("SELECT key, round(behaviour_deviation, 6) AS behaviour_deviation, round(intent_divergence, 6) AS intent_divergence, round(network_risk, 6) AS network_risk, round(reputation, 6) AS reputation, computed_at FROM features")
def agg_feature_merge(spark, d):
    return features.merge_deposits(T.deposits(spark, d)).select("key", r6("behaviour_deviation"), r6("intent_divergence"), r6("network_risk"), r6("reputation"), "computed_at")


@query(f"SELECT key, CASE WHEN {T.NOW} - computed_at > 200 THEN 'stale' ELSE 'fresh' END AS state FROM features")
def fn_freshness(spark, d):
    return features.merge_deposits(T.deposits(spark, d)).select("key", S.freshness(F.col("computed_at"), F.lit(T.NOW), 200).alias("state"))


@query("SELECT evaluation_id, round(e_b, 6) AS b, round(e_i, 6) AS i, round(e_n, 6) AS n, round(e_r, 6) AS r, degraded FROM evid")
def join_evidence(spark, d):
    r, *_, f = _inputs(spark, d)
    return features.with_features(r, f, T.NOW).select("evaluation_id", r6("e_behaviour_deviation", "b"), r6("e_intent_divergence", "i"), r6("e_network_risk", "n"), r6("e_reputation", "r"), "degraded")


@query("SELECT evaluation_id, round(p, 6) AS risk FROM scored")
def fn_sigmoid_score(spark, d):
    return evaluated(spark, d).select("evaluation_id", r6("risk"))


@query("SELECT evaluation_id, CAST(floor(trunc(p * amount_paise) / 1000) AS BIGINT) AS loss, CASE WHEN trunc(p * amount_paise) > 5000000 THEN 1 ELSE 0 END AS over FROM scored")
def fn_expected_loss(spark, d):
    return evaluated(spark, d).select("evaluation_id", F.floor(F.col("loss") / 1000).cast("long").alias("loss"), (F.col("loss") > LIVE.interruption_cost).cast("int").alias("over"))


@query("SELECT evaluation_id, len(list_distinct([customer_id, token_id, agent_id, merchant_id])) AS n FROM requests")
def proj_key_dedup(spark, d):
    return T.requests(spark, d).select("evaluation_id", F.size(S.distinct_keys(F.col("customer_id"), F.col("token_id"), F.col("agent_id"), F.col("merchant_id"), F.lit(""), F.col("token_id"))).cast("long").alias("n"))


@query("SELECT DISTINCT unnest([customer_id, token_id, agent_id, merchant_id]) AS key FROM requests")
def set_distinct_keys(spark, d):
    return T.requests(spark, d).select(F.explode(F.array("customer_id", "token_id", "agent_id", "merchant_id")).alias("key")).distinct()


@query("SELECT DISTINCT token_id FROM requests EXCEPT SELECT token_id FROM blocks")
def set_except(spark, d):
    return T.requests(spark, d).select("token_id").distinct().join(blockstate.block_state(T.lien_log(spark, d)), "token_id", "left_anti").select("token_id")


# --- reputation and labels

_REP = """
rep AS (SELECT agent_id, CAST(sum(CASE WHEN type = 'payment.captured' THEN 1 ELSE 0 END) AS DOUBLE) AS s, CAST(sum(CASE type WHEN 'payment.failed' THEN 1 WHEN 'payment.disputed' THEN 5 ELSE 0 END) AS DOUBLE) AS f FROM bus WHERE type LIKE 'payment%' GROUP BY agent_id)"""


@query("SELECT agent_id, s AS successes, f AS failures, round((s + 10) / (s + f + 20), 6) AS reputation FROM rep", _REP)
def agg_reputation(spark, d):
    return reputation.reputation(log.dedupe(T.bus_dup(spark, d))).select("agent_id", "successes", "failures", r6("reputation"))


_LAB = """
marks AS (SELECT *, max(CASE WHEN type = 'payment.disputed' THEN seq END) OVER (PARTITION BY token_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS disp,
  max(CASE WHEN decision = 'STEP_UP' THEN seq END) OVER (PARTITION BY token_id, nonce ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS arm,
  max(CASE WHEN type = 'payment.captured' THEN seq END) OVER (PARTITION BY token_id, nonce ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS took FROM bus),
lab AS (SELECT *, CASE WHEN type = 'payment.disputed' THEN 'dispute' WHEN type = 'token.cancelled' THEN 'cancellation' WHEN type = 'payment.captured' AND arm > greatest(coalesce(took, -1), coalesce(disp, -1)) THEN 'confirmed_step_up' END AS reason FROM marks),
labs AS (SELECT 'label:' || reason || ':' || event_id AS label_id, token_id, CASE reason WHEN 'confirmed_step_up' THEN 0.0 ELSE 1.0 END AS value, CASE reason WHEN 'cancellation' THEN 0.5 ELSE 1.0 END AS weight, reason, occurred_at, seq FROM lab WHERE reason IS NOT NULL)"""


def _labels(spark, d):
    return labelling.labels(log.dedupe(T.bus_dup(spark, d)))


@query("SELECT label_id, token_id, value::DOUBLE AS value, weight::DOUBLE AS weight, reason FROM labs", _LAB)
def join_stepup_capture(spark, d):
    return _labels(spark, d).select(F.col("event_id").alias("label_id"), "token_id", "value", "weight", "reason")


@query("SELECT token_id, value::DOUBLE AS value, weight::DOUBLE AS weight, reason, occurred_at FROM labs QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY value DESC, occurred_at DESC, seq DESC) = 1", _LAB)
def agg_label_dedupe(spark, d):
    return labelling.label_set(_labels(spark, d))


@query("SELECT reason, count(*) AS n, CAST(sum(CASE WHEN value >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS misuse FROM labs GROUP BY reason", _LAB)
def agg_label_tally(spark, d):
    return labelling.tally(_labels(spark, d))


# --- behaviour


def _observed(spark, d):
    b = T.bus(spark, d).where("type in ('decision.made', 'payment.captured')")
    return b.withColumn("principal", F.col("token_id"))


_EWMA = """
obs AS (SELECT token_id AS principal, seq, merchant_id, occurred_at, CAST(amount_paise AS DOUBLE) AS x, row_number() OVER (PARTITION BY token_id ORDER BY seq) AS rn FROM bus WHERE type IN ('decision.made', 'payment.captured')),
pos AS (SELECT principal, seq, x, row_number() OVER (PARTITION BY principal ORDER BY seq) AS rn FROM obs WHERE x > 0),
fold AS (SELECT principal, rn, seq, x AS mean, CAST(0 AS DOUBLE) AS mad, CAST(0 AS DOUBLE) AS z FROM pos WHERE rn = 1
  UNION ALL SELECT p.principal, p.rn, p.seq, f.mean + 0.1 * (p.x - f.mean), f.mad + 0.1 * (abs(p.x - f.mean) - f.mad), abs(p.x - f.mean) / (1.2533 * f.mad + 1e-9) FROM fold f JOIN pos p ON p.principal = f.principal AND p.rn = f.rn + 1),
gaps AS (SELECT principal, seq, CAST(greatest(0, occurred_at - lag(occurred_at) OVER (PARTITION BY principal ORDER BY seq)) AS DOUBLE) AS gap, rn FROM obs),
vel AS (SELECT principal, rn, seq, gap AS e, CAST(0 AS DOUBLE) AS speed FROM gaps WHERE rn = 2
  UNION ALL SELECT g.principal, g.rn, g.seq, v.e + 0.1 * (g.gap - v.e), CASE WHEN v.e > 0 THEN greatest(0, (v.e - g.gap) / (v.e + 1e-9)) ELSE 0 END FROM vel v JOIN gaps g ON g.principal = v.principal AND g.rn = v.rn + 1)"""


@query("SELECT principal, round(mean, 3) AS ewma_mean, round(mad, 3) AS ewma_mad FROM fold QUALIFY row_number() OVER (PARTITION BY principal ORDER BY rn DESC) = 1", _EWMA, True)
def win_ewma(spark, d):
    return behaviour.ewma(_observed(spark, d)).select("principal", F.round("ewma_mean", 3).alias("ewma_mean"), F.round("ewma_mad", 3).alias("ewma_mad"))


@query("SELECT principal, seq, CASE WHEN z > 1000 THEN 1000.0 ELSE round(z, 4) END AS z FROM fold", _EWMA, True)
def win_amount_z(spark, d):
    z = F.when(F.col("z") > 1000, 1000.0).otherwise(F.round("z", 4))
    return behaviour.amounts(_observed(spark, d)).select("principal", "seq", z.alias("z"))


@query("SELECT principal, seq, round(CASE WHEN speed > 0 THEN 1 - exp(-speed / 0.5) ELSE 0 END, 6) AS velocity FROM vel", _EWMA, True)
def win_velocity(spark, d):
    return behaviour.gaps(_observed(spark, d)).select("principal", "seq", r6("d_velocity", "velocity"))


_NOV = """
nov AS (SELECT token_id AS principal, seq, greatest(0.0, 1 - (count(*) OVER (PARTITION BY token_id, merchant_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / ((count(*) OVER (PARTITION BY token_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) + 1.0)) AS novelty FROM bus WHERE type IN ('decision.made', 'payment.captured'))"""


@query("SELECT principal, seq, round(novelty, 6) AS novelty FROM nov", _NOV)
def win_novelty(spark, d):
    return behaviour.novelty(_observed(spark, d)).select("principal", "seq", r6("novelty"))


@query("SELECT principal, seq, round(novelty, 6) AS novelty FROM nov", _NOV)
def win_novelty_fold(spark, d):
    return behaviour.signals(_observed(spark, d)).select("principal", "seq", r6("novelty"))


@query()
def win_feature_vector(spark, d):
    rows = behaviour.deviations(behaviour.signals(_observed(spark, d)))
    return rows.select("principal", "seq", F.round("deviation", 6).alias("deviation"), F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query()
def agg_p2_quantile(spark, d):
    return behaviour.signals(_observed(spark, d)).groupBy("principal").agg(F.round(F.max_by("p95", "seq"), 4).alias("p95"))


@query(
    "SELECT principal, seq, n_amount, round(usual, 4) AS usual, round(CASE WHEN x <= usual THEN 0 ELSE 1 - exp(-(x - usual) / (usual + 1e-9)) END, 6) AS d_p95 FROM near",
    """
own AS (SELECT token_id AS principal, seq, CAST(amount_paise AS DOUBLE) AS x FROM bus WHERE type IN ('decision.made', 'payment.captured') AND amount_paise > 0),
past AS (SELECT *, row_number() OVER w - 1 AS n_amount, list_sort(list(x) OVER (PARTITION BY principal ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS xs FROM own WINDOW w AS (PARTITION BY principal ORDER BY seq)),
exact AS (SELECT *, xs[1 + CAST(least(n_amount - 1, floor(CAST(0.95 AS DOUBLE) * n_amount)) AS BIGINT)] AS e FROM past),
near AS (SELECT *, CASE WHEN n_amount = 0 THEN 0 ELSE 2 * pow(CAST(1.005 AS DOUBLE) / CAST(0.995 AS DOUBLE), ceil(ln(e) / ln(CAST(1.005 AS DOUBLE) / CAST(0.995 AS DOUBLE)))) / (CAST(1.005 AS DOUBLE) / CAST(0.995 AS DOUBLE) + 1) END AS usual FROM exact)""",
)
def win_p95_excess(spark, d):
    return quantiles.running(_observed(spark, d)).select("principal", "seq", "n_amount", F.round("usual", 4).alias("usual"), F.round("d_over", 6).alias("d_p95"))


@query("SELECT round(1 - (1 - d1) * (1 - d2) * (1 - d3), 6) AS risk, count(*) AS n FROM (SELECT (k % 10) / 20.0 AS d1, (k % 7) / 14.0 AS d2, (k % 3) / 6.0 AS d3 FROM bus) GROUP BY 1")
def agg_noisy_or(spark, d):
    k = F.col("k")
    parts = F.array(k % 10 / 20.0, k % 7 / 14.0, k % 3 / 6.0)
    return T.bus(spark, d).groupBy(F.round(S.noisy_or_array(parts), 6).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT token_id AS principal, count(DISTINCT merchant_id) AS merchants FROM bus GROUP BY 1")
def agg_distinct_exact(spark, d):
    return T.bus(spark, d).groupBy(F.col("token_id").alias("principal")).agg(F.countDistinct("merchant_id").alias("merchants"))


@query()
def fn_hash64(spark, d):
    m = T.bus(spark, d).select("merchant_id").distinct()
    return m.select("merchant_id", *[sketches.hash64(F.col("merchant_id"), i).alias(f"h{i}") for i in (0, 1)])


@query()
def agg_hll(spark, d):
    found = sketches.distinct(T.bus(spark, d), "token_id", "merchant_id")
    return found.select("token_id", F.round(sketches.cardinality(F.col("registers")), 6).alias("estimate"))


@query()
def agg_cms(spark, d):
    b = T.bus(spark, d)
    counts = sketches.frequencies(b, "token_id", "merchant_id")
    pairs = b.where("merchant_id is not null").select("token_id", "merchant_id").distinct().join(counts, "token_id")
    return pairs.select("token_id", "merchant_id", sketches.estimated(F.col("counts"), F.col("merchant_id")).alias("estimate"))


@query("SELECT token_id, merchant_id, count(*) AS n, false AS too_low FROM bus WHERE merchant_id IS NOT NULL GROUP BY token_id, merchant_id")
def agg_cms_bound(spark, d):
    """The exact count of each pair beside what halves of the log, merged, say."""
    b = T.bus(spark, d)
    halves = sketches.frequencies(b.where("seq % 2 = 0"), "token_id", "merchant_id").unionByName(sketches.frequencies(b.where("seq % 2 = 1"), "token_id", "merchant_id"))
    counts = sketches.merged_frequencies(halves, "token_id")
    exact = b.where("merchant_id is not null").groupBy("token_id", "merchant_id").agg(F.count(F.lit(1)).alias("n"))
    rows = exact.join(counts, "token_id")
    return rows.select("token_id", "merchant_id", "n", (sketches.estimated(F.col("counts"), F.col("merchant_id")) < F.col("n")).alias("too_low"))


# --- graph

_GRAPH = """
raw AS (SELECT DISTINCT 'token:' || token_id AS t, unnest(['agent:' || agent_id, 'customer:' || customer_id, 'merchant:' || merchant_id, 'device:' || device_id]) AS o FROM bus),
nb AS (SELECT t AS node, o AS other FROM raw UNION SELECT o, t FROM raw),
deg AS (SELECT node, count(*) AS degree FROM nb GROUP BY node),
fan AS (SELECT node, max(n) AS fan_out FROM (SELECT node, split_part(other, ':', 1) AS kind, count(*) AS n FROM nb GROUP BY ALL) GROUP BY node),
shr AS (SELECT nb.node, CAST(sum(degree - 1) AS BIGINT) AS shared FROM nb JOIN deg ON deg.node = nb.other WHERE other LIKE 'device:%' GROUP BY nb.node)"""
_COMP = """,
reach AS (SELECT 0 AS i, node, node AS label FROM deg UNION ALL SELECT i + 1, node, min(label) FROM (SELECT r.i, nb.node, least(r.label, nb.node) AS label FROM reach r JOIN nb ON nb.other = r.node WHERE r.i < 12) GROUP BY i, node),
comp AS (SELECT node, label AS component, count(*) OVER (PARTITION BY label) AS size FROM reach WHERE i = 12)"""


@query("SELECT least(t, o) AS a, greatest(t, o) AS b, arg_max(occurred_at, seq) AS ts FROM (SELECT 'token:' || token_id AS t, unnest(['agent:' || agent_id, 'customer:' || customer_id, 'merchant:' || merchant_id, 'device:' || device_id]) AS o, seq, occurred_at FROM bus) GROUP BY 1, 2")
def graph_edges(spark, d):
    return graph.edges(T.bus(spark, d))


@query("SELECT * FROM deg", _GRAPH)
def graph_degree(spark, d):
    return graph.degrees(graph.edges(T.bus(spark, d)))


@query("SELECT * FROM fan", _GRAPH)
def graph_fan_out(spark, d):
    return graph.fan_out(graph.edges(T.bus(spark, d)))


@query("SELECT node, shared AS shared_attributes FROM shr", _GRAPH)
def graph_shared_attrs(spark, d):
    return graph.shared_attributes(graph.edges(T.bus(spark, d)))


@query("SELECT * FROM comp", _GRAPH + _COMP, True)
def graph_components(spark, d):
    return graph.components(graph.edges(T.bus(spark, d)))


@query("SELECT node, round(1 - exp(-degree / 30.0) * exp(-fan_out / 15.0) * exp(-coalesce(shared, 0) / 8.0) * exp(-size / 40.0), 6) AS floor FROM deg JOIN fan USING (node) LEFT JOIN shr USING (node) JOIN comp USING (node)", _GRAPH + _COMP, True)
def graph_floor(spark, d):
    return graph.structural_floor(graph.edges(T.bus(spark, d))).select("node", r6("floor"))


_PROP = """,
seed AS (SELECT DISTINCT 'token:' || token_id AS node FROM bus WHERE type = 'payment.disputed'),
prop AS (SELECT 0 AS i, node, CASE WHEN node IN (SELECT node FROM seed) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM deg
  UNION ALL SELECT i + 1, node, s FROM (SELECT p.i, nb.node, CASE WHEN nb.node IN (SELECT node FROM seed) THEN 1.0::DOUBLE ELSE 0.85 * avg(p.score) END AS s FROM prop p JOIN nb ON nb.other = p.node WHERE p.i < 30 GROUP BY p.i, nb.node))"""


@query("SELECT node, round(score, 6) AS score FROM prop WHERE i = 30", _GRAPH + _PROP, True)
def graph_propagate(spark, d):
    return graph.propagate(graph.edges(T.bus(spark, d)), graph.dispute_seeds(T.bus(spark, d))).select("node", r6("score"))


_FLOOR = """,
flo AS (SELECT node, degree, fan_out, coalesce(shared, 0) AS shared, size, 1 - exp(-degree / 30.0) * exp(-fan_out / 15.0) * exp(-coalesce(shared, 0) / 8.0) * exp(-size / 40.0) AS floor FROM deg JOIN fan USING (node) LEFT JOIN shr USING (node) JOIN comp USING (node))"""


@query("SELECT substr(node, strpos(node, ':') + 1) AS key, node, round(greatest(floor, score), 6) AS risk FROM flo JOIN (SELECT node, score FROM prop WHERE i = 30) USING (node) WHERE node NOT LIKE 'device:%'", _GRAPH + _COMP + _FLOOR + _PROP, True)
def graph_network_risk(spark, d):
    edges = settled(graph.edges(T.bus(spark, d)), "graph")
    return graph.network_risk(edges, graph.dispute_seeds(T.bus(spark, d))).select("key", "node", r6("risk"))


@query()
def graph_learned_risk(spark, d):
    edges, seeds = settled(graph.edges(T.bus(spark, d)), "graph"), labelling.label_set(_labels(spark, d))
    seeds = training.graph_examples(seeds, graph.neighbours(edges))
    parts = settled(graph.components(edges), "graph")
    learned = training.learned_network_risk(graph.hop_features(edges, parts=parts), seeds)
    return graph.network_risk(edges, graph.dispute_seeds(T.bus(spark, d)), learned=learned, parts=parts).select("key", "node", r6("risk"))


@query("SELECT DISTINCT 'token:' || token_id AS node, 1.0::DOUBLE AS label FROM bus WHERE type = 'payment.disputed'")
def graph_seeds(spark, d):
    return graph.dispute_seeds(T.bus(spark, d))


_HOPS = """,
h0 AS (SELECT node, ln(1 + degree) AS f0, ln(1 + fan_out) AS f1, ln(1 + shared) AS f2, ln(1 + size) AS f3 FROM flo),
h1 AS (SELECT nb.node, avg(f0) AS n_f0, avg(f1) AS n_f1, avg(f2) AS n_f2, avg(f3) AS n_f3 FROM nb JOIN h0 ON h0.node = nb.other GROUP BY nb.node),
h2 AS (SELECT nb.node, avg(n_f0) AS n_n_f0, avg(n_f1) AS n_n_f1, avg(n_f2) AS n_n_f2, avg(n_f3) AS n_n_f3 FROM nb JOIN h1 ON h1.node = nb.other GROUP BY nb.node)"""
_HOP_NAMES = [p + f"f{i}" for p in ("", "n_", "n_n_") for i in range(4)]


@query(f"SELECT node, {', '.join(f'round({c}, 6) AS {c}' for c in _HOP_NAMES)} FROM h0 JOIN h1 USING (node) JOIN h2 USING (node)", _GRAPH + _COMP + _FLOOR + _HOPS, True)
def graph_hop_features(spark, d):
    return graph.hop_features(graph.edges(T.bus(spark, d))).select("node", *map(r6, _HOP_NAMES))


@query("SELECT 'token:' || token_id AS node, arg_min(occurred_at, seq) AS first_seen, max(occurred_at) AS last_seen FROM bus GROUP BY token_id")
def win_first_last_seen(spark, d):
    return T.bus(spark, d).groupBy(S.node_id("token", F.col("token_id")).alias("node")).agg(F.min_by("occurred_at", "seq").alias("first_seen"), F.max("occurred_at").alias("last_seen"))


# --- intent


def _pairs(spark, d):
    e = T.read(spark, d, "embeddings").select("vec_id", "label", "embedding")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("sealed"))
    return e.join(first, "label")


_COS = """
fst AS (SELECT label, arg_min(embedding, vec_id) AS sealed FROM embeddings GROUP BY label),
cosn AS (SELECT vec_id, greatest(-1, least(1, list_dot_product(embedding::DOUBLE[], sealed::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(sealed::DOUBLE[], sealed::DOUBLE[]))))) AS cos, label FROM embeddings JOIN fst USING (label))"""


@query("SELECT vec_id, round(cos, 5) AS cos FROM cosn", _COS)
def fn_cosine(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("sealed")), 5).alias("cos"))


@query("SELECT vec_id, round(greatest(0, least(1, (1 - cos) / 2)), 5) AS distance FROM cosn", _COS)
def fn_semantic_distance(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(S.semantic_distance(S.cosine(F.col("embedding"), F.col("sealed"))), 5).alias("distance"))


@query("SELECT vec_id, round(1 - (1 - (1 - cos) / 2) * CASE WHEN vec_id % 3 <> label % 3 THEN 0.5 ELSE 1 END, 5) AS divergence FROM cosn", _COS)
def fn_divergence(spark, d):
    kinds = F.array(F.lit("purchase"), F.lit("subscription"), F.lit("top-up"))
    a, b = kinds[(F.col("vec_id") % 3).cast("int")], kinds[(F.col("label") % 3).cast("int")]
    rows = _pairs(spark, d).withColumn("cos", S.cosine(F.col("embedding"), F.col("sealed")))
    return rows.select("vec_id", F.round(intent.debit_divergence(F.col("cos"), a, b, F.lit(True)), 5).alias("divergence"))


@query("SELECT CASE type WHEN 'buy' THEN 'purchase' WHEN 'rec' THEN 'subscription' WHEN 'top' THEN 'top-up' ELSE '' END AS purpose, count(*) AS n FROM (SELECT CASE k % 4 WHEN 0 THEN 'buy' WHEN 1 THEN 'rec' WHEN 2 THEN 'top' ELSE '?' END AS type FROM bus) GROUP BY 1")
def fn_normalise_purpose(spark, d):
    raw = F.array(F.lit(" Buy "), F.lit("Recurring"), F.lit("top_up"), F.lit("gift"))[(F.col("k") % 4).cast("int")]
    return T.bus(spark, d).groupBy(S.normalise_purpose(raw).alias("purpose")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS words FROM documents")
def fn_tokenise(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.size(S.tokenise(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(S.tokenise(F.col("text")), " ")).alias("words"))


@query("SELECT doc_id, concat_ws(' · ', nullif(trim(lang), ''), nullif(trim(source), '')) AS text FROM documents")
def fn_semantic_text(spark, d):
    return T.read(spark, d, "documents").select("doc_id", S.joined_text(F.col("lang"), F.lit("  "), F.col("source")).alias("text"))


@query()
def fn_hash_embed(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", "text")
    return intent.hashed_embedding(docs, "text").select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("""SELECT k, sha256('{"category":"m_' || (k % 25) || '","constraints":{"a\\u00e9":{"k":' || k || ',"none":null},"sizes":[' || k || ',"\\ud83d\\ude00"]},"max_amount_paise":' || k || ',"merchant_preference":"\\u00fc d_' || k || '","purpose":"purchase"}') AS digest FROM (SELECT DISTINCT k FROM bus)""")
def fn_envelope_digest(spark, d):
    b = T.bus(spark, d).select("k", "merchant_id", "device_id").distinct()
    more = F.parse_json(F.format_string('{"sizes": [%d, "😀"], "aé": {"none": null, "k": %d}}', F.col("k"), F.col("k")))
    return b.select("k", intent.envelope_digest(F.lit("Buy"), F.col("merchant_id"), F.col("k"), F.concat(F.lit("Ü "), F.upper("device_id")), more).alias("digest"))


@query("SELECT seq, env.k AS env_k, env.d AS env_device FROM (SELECT seq, type, last_value(CASE WHEN type LIKE 'token%' THEN {'k': k, 'd': CASE WHEN k % 3 <> 0 THEN device_id END} END IGNORE NULLS) OVER (PARTITION BY token_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS env FROM bus) WHERE type NOT LIKE 'token%'")
def join_envelope_debit(spark, d):
    b = T.bus(spark, d).withColumn("sealed", F.col("type").startswith("token")).withColumn("session_id", F.col("token_id"))
    b = b.withColumn("device", F.when(F.col("k") % 3 != 0, F.col("device_id")))
    return intent.latest_envelope(b, ["k", "device"]).select("seq", "env_k", "env_device")


# --- ledger and vault

_LED = """
recs AS (SELECT row_number() OVER (PARTITION BY token_id ORDER BY seq) AS rn, seq, token_id, 'ev' || seq AS evaluation_id, sha256(event_id) AS request_digest, decision, 'C' || (k % 4) AS code, CASE WHEN k % 4 = 0 THEN 'P1' ELSE '' END AS predicate_failed, occurred_at AS ts FROM bus WHERE type = 'decision.made')"""
_CHAIN = """,
body AS (SELECT token_id, rn, seq, concat_ws(chr(31), evaluation_id, request_digest, decision, code, predicate_failed, '', '1', ts) AS b FROM recs),
chain AS (SELECT token_id, rn, seq, '' AS prev_hash, sha256(chr(31) || b) AS hash FROM body WHERE rn = 1 UNION ALL SELECT body.token_id, body.rn, body.seq, chain.hash, sha256(chain.hash || chr(31) || b) FROM chain JOIN body ON body.token_id = chain.token_id AND body.rn = chain.rn + 1)"""


def _records(spark, d):
    b = T.bus(spark, d).where("type = 'decision.made'")
    return b.select(
        "seq",
        "token_id",
        F.concat(F.lit("ev"), "seq").alias("evaluation_id"),
        F.sha2("event_id", 256).alias("request_digest"),
        "decision",
        F.concat(F.lit("C"), F.col("k") % 4).alias("code"),
        F.when(F.col("k") % 4 == 0, "P1").otherwise("").alias("predicate_failed"),
        F.lit("").alias("evidence_digest"),
        F.lit(1).alias("policy_version"),
        F.col("occurred_at").alias("ts"),
    )


@query("SELECT seq, prev_hash, hash FROM chain", _LED + _CHAIN, True)
def led_append(spark, d):
    return ledger.append_by_token(_records(spark, d)).select("seq", "prev_hash", "hash")


@query("SELECT token_id, max(seq) AS seq, arg_max(hash, seq) AS hash, count(*) AS n, 0 AS faults FROM chain GROUP BY token_id", _LED + _CHAIN, True)
def led_append_again(spark, d):
    """Two appends, the second from the heads of the first, which alone verify it."""
    rows = _records(spark, d)
    half = rows.agg(F.max("seq")).first()[0] // 2
    first = settled(ledger.heads(ledger.append_by_token(rows.where(F.col("seq") <= half))), "heads")
    more = settled(ledger.append_by_token(rows.where(F.col("seq") > half), first), "chain")
    faults = ledger.verify(more, "token_id", first).join(more.select("seq", "token_id"), "seq").groupBy("token_id").agg(F.count(F.lit(1)).alias("faults"))
    return ledger.moved_heads(first, more).join(faults, "token_id", "left").withColumn("faults", F.coalesce("faults", F.lit(0)))


@query("SELECT token_id, max(seq) AS seq, arg_max(hash, seq) AS hash, count(*) AS n FROM chain GROUP BY token_id", _LED + _CHAIN, True)
def top1_chain_head(spark, d):
    return ledger.heads(ledger.append_by_token(_records(spark, d)))


@query("SELECT seq, seq % 50 = 11 AS broken, true AS tampered FROM recs WHERE seq % 50 IN (7, 11)", _LED)
def led_verify(spark, d):
    chain, at = ledger.append_by_token(_records(spark, d)), F.col("seq") % 50
    bad = chain.withColumn("code", F.when(at == 7, "forged").otherwise(F.col("code"))).withColumn("prev_hash", F.when(at == 11, "x").otherwise(F.col("prev_hash")))
    return ledger.verify(bad, "token_id")


@query("SELECT sha256(string_agg(h, '' ORDER BY b)) AS root FROM (SELECT substr(sha256(token_id), 1, 3) AS b, sha256(string_agg(hash, '' ORDER BY token_id)) AS h FROM (SELECT token_id, arg_max(hash, seq) AS hash FROM chain GROUP BY token_id) GROUP BY 1)", _LED + _CHAIN, True)
def led_per_token(spark, d):
    return ledger.merkle_root(ledger.append_by_token(_records(spark, d)))


@query("SELECT 'ev' || seq AS evaluation_id, seq, sha256(event_id) AS request_digest, CASE WHEN k % 4 = 0 THEN 'P1' ELSE '' END AS predicate_failed, occurred_at AS ts FROM bus WHERE type = 'decision.made'")
def led_from_event(spark, d):
    events = T.bus_dup(spark, d).withColumn("evaluation_id", F.concat(F.lit("ev"), F.substring("event_id", 2, 20)))
    told = verdicts.with_provenance(events, _records(spark, d))
    return verdicts.records_of(told).select("evaluation_id", "seq", "request_digest", "predicate_failed", "ts")


@query("SELECT 's' || user_id % 50 AS session_id, arg_min('tok_' || user_id, e) AS token_id, min(e) AS ts FROM (SELECT CAST(substr(token_id, 5) AS BIGINT) AS user_id, occurred_at * 100000000 + seq AS e FROM bus) GROUP BY 1")
def join_session_token(spark, d):
    b = T.bus(spark, d).select(F.concat(F.lit("s"), F.substring("token_id", 5, 20).cast("long") % 50).alias("session_id"), "token_id", (F.col("occurred_at") * 100_000_000 + F.col("seq")).alias("ts"), F.col("event_id").alias("evaluation_id"))
    return verdicts.session_tokens(b)


def _plain(spark, d):
    c = T.read(spark, d, "customer")
    return c.select(F.concat(F.lit("s_"), "c_custkey").alias("session_id"), F.lit("contact").alias("field"), F.when(F.col("c_custkey") % 10 == 3, "").otherwise(F.col("c_name")).alias("plaintext"))


@query("""SELECT 's_' || c_custkey AS session_id, 'contact' AS field,
  CASE WHEN c_custkey % 10 = 3 THEN 'not_found' WHEN c_custkey % 7 = 0 THEN 'not_found' WHEN c_custkey % 7 = 1 THEN 'erased' ELSE 'ok' END AS status,
  CASE WHEN c_custkey % 10 = 3 OR c_custkey % 7 IN (0, 1) THEN NULL ELSE c_name END AS plaintext FROM customer""")
def vlt_reveal(spark, d):
    plain = _plain(spark, d)
    keys = vault.keyring(plain)
    sealed = vault.seal(plain, keys)
    n = F.substring("session_id", 3, 20).cast("long")
    rows, kept = vault.erase(sealed, keys, plain.where(n % 7 == 0))
    _, kept = vault.erase(rows, kept, plain.where(n % 7 == 1))  # a surviving backup row without its key
    return vault.reveal(plain.select("session_id", "field"), rows, kept)


# --- training and evaluation

_PIT = _LAB + _NOV.replace("nov AS", ", nov0 AS").replace("seq, greatest", "seq, occurred_at, greatest", 1)


def _vectors(spark, d):
    rows = behaviour.novelty(_observed(spark, d))
    return rows.select("token_id", "occurred_at", "seq", F.array("novelty").alias("vector"))


@query("SELECT token_id, round(v, 6) AS novelty, y, w FROM (SELECT l.token_id, l.label_id, arg_max(n.novelty, n.occurred_at * 1000000000 + n.seq) AS v, any_value(l.value)::DOUBLE AS y, any_value(l.weight)::DOUBLE AS w FROM labs l JOIN nov0 n ON n.principal = l.token_id AND n.occurred_at <= l.occurred_at GROUP BY l.token_id, l.label_id)", _PIT)
def join_label_pit(spark, d):
    return training.examples(_labels(spark, d), _vectors(spark, d)).select("token_id", F.round(F.col("vector")[0], 6).alias("novelty"), "y", "w")


@query("SELECT count(*) AS n FROM bus WHERE type IN ('decision.made', 'payment.captured')")
def ml_dataset_population(spark, d):
    return _vectors(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'token:' || token_id AS node, value::DOUBLE AS label FROM labs QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY value DESC, occurred_at DESC, seq DESC) = 1", _LAB)
def join_graph_seeds(spark, d):
    return training.graph_examples(labelling.label_set(_labels(spark, d)), graph.neighbours(graph.edges(T.bus(spark, d))))


@query()
def ml_behaviour_scorer(spark, d):
    vectors = behaviour.deviations(behaviour.signals(_observed(spark, d))).select(F.col("principal").alias("token_id"), "seq", "vector").join(T.bus(spark, d).select("seq", "occurred_at"), "seq")
    rows = training.examples(_labels(spark, d), vectors)
    model = training.fit_scorer(rows)
    return training.calibrated(model, rows).select("token_id", "y", r6("calibrated")) if model else rows.select("token_id", "y", F.lit(None).cast("double").alias("calibrated"))


@query()
def ml_isolation_floor(spark, d):
    rows = behaviour.deviations(behaviour.signals(_observed(spark, d))).select("principal", "seq", "vector")
    return training.isolation_floor(rows).select("principal", "seq", r6("iso_floor"))


@query()
def ml_retrain(spark, d):
    edges = settled(graph.edges(T.bus(spark, d)), "graph")
    hops = graph.hop_features(edges)
    seeds = training.graph_examples(labelling.label_set(_labels(spark, d)), graph.neighbours(edges))
    vectors = hops.select("node", F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in hops.columns if c != "node"]).alias("vector"))
    layers = {"behaviour": training.examples(_labels(spark, d), _vectors(spark, d)), "graph": seeds.join(vectors, "node").select("vector", F.round("label").alias("y"))}
    return training.retrain(layers)[1].select("layer", "n", "trained", "reason", r6("mean_misuse"), r6("mean_legit"))


def _debits(spark, d):
    v = evaluated(spark, d)
    n = F.substring("evaluation_id", 4, 20).cast("long")
    expected = v.select(
        "evaluation_id",
        F.concat(F.lit("f"), F.col("tool_risk")).alias("family"),
        (n % 3 == 0).alias("is_misuse"),
        "amount_paise",
        F.when(n % 4 == 0, "ALLOW").when(n % 4 == 1, "BLOCK").otherwise("STEP_UP").alias("expected_decision"),
        F.when(n % 2 == 0, F.col("code")).otherwise("X").alias("expected_code"),
    )
    actual = v.where(n % 9 != 0).select("evaluation_id", F.col("answer").alias("actual_decision"), F.col("code").alias("actual_code"))
    return evaluate.per_debit(expected, actual)


_DEB = """
deb AS (SELECT evaluation_id, 'f' || tool_risk AS family, n % 3 = 0 AS is_misuse, amount_paise, CASE n % 4 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'BLOCK' ELSE 'STEP_UP' END AS ed, CASE WHEN n % 2 = 0 THEN code ELSE 'X' END AS ec, CASE WHEN n % 9 <> 0 THEN answer END AS ad, CASE WHEN n % 9 <> 0 THEN code END AS ac FROM (SELECT *, CAST(substr(evaluation_id, 4) AS BIGINT) AS n FROM verdict))"""


@query("SELECT evaluation_id, ad IS NOT NULL AS evaluated, coalesce(ed = ad, false) AS decision_match, coalesce(ec = ac, false) AS code_match FROM deb", _DEB)
def join_oracle(spark, d):
    return _debits(spark, d).select("evaluation_id", "evaluated", "decision_match", "code_match")


@query("SELECT ed AS expected_decision, count(*) FILTER (ad = 'ALLOW') AS ALLOW, count(*) FILTER (ad = 'STEP_UP') AS STEP_UP, count(*) FILTER (ad = 'BLOCK') AS BLOCK FROM deb WHERE ad IS NOT NULL GROUP BY ed", _DEB)
def agg_confusion(spark, d):
    return evaluate.confusion(_debits(spark, d))


@query("SELECT family, count(*) AS n, count(ad) AS evaluated, round(count(*) FILTER (ed = ad) / count(*), 4) AS decision_accuracy, round(count(*) FILTER (ec = ac) / count(*), 4) AS code_accuracy, bool_or(is_misuse) AS is_misuse FROM deb GROUP BY ROLLUP (family)", _DEB)
def agg_family_accuracy(spark, d):
    return evaluate.accuracy(_debits(spark, d))


@query("SELECT count(*) FILTER (ed <> 'ALLOW') AS gate_expected, count(*) FILTER (ed <> 'ALLOW' AND ad <> 'ALLOW') AS gated, count(*) FILTER (ed <> 'ALLOW' AND ad = 'ALLOW') AS leaked, CAST(sum(amount_paise) FILTER (ed <> 'ALLOW') AS BIGINT) AS at_risk_paise, CAST(coalesce(sum(amount_paise) FILTER (ed <> 'ALLOW' AND ad <> 'ALLOW'), 0) AS BIGINT) AS gated_paise, CAST(coalesce(sum(amount_paise) FILTER (ed <> 'ALLOW' AND ad = 'ALLOW'), 0) AS BIGINT) AS leaked_paise, count(*) FILTER (ed = 'ALLOW' AND ad <> 'ALLOW') AS false_friction, count(*) FILTER (ed = 'ALLOW') AS allow_expected, round(count(*) FILTER (ed <> 'ALLOW' AND ad <> 'ALLOW') / count(*) FILTER (ed <> 'ALLOW'), 4) AS recall FROM deb WHERE ad IS NOT NULL", _DEB)
def agg_expected_loss(spark, d):
    return evaluate.expected_loss(_debits(spark, d))


@query("SELECT count(*) AS requests, count(ad) AS evaluated, round(count(*) FILTER (ed = ad) / count(*), 4) AS decision_accuracy, round(count(*) FILTER (ec = ac) / count(*), 4) AS code_accuracy FROM deb", _DEB)
def agg_headline(spark, d):
    return evaluate.headline(_debits(spark, d))


@query("SELECT reason, coalesce(a.n, 0) AS observed, coalesce(b.n, 0) AS expected FROM (SELECT reason, count(*) AS n FROM labs GROUP BY reason) a FULL JOIN (SELECT CASE WHEN k % 2 = 0 THEN 'dispute' ELSE 'refund' END AS reason, count(*) AS n FROM bus GROUP BY 1) b USING (reason)", _LAB)
def agg_label_breakdown(spark, d):
    wanted = T.bus(spark, d).select(F.when(F.col("k") % 2 == 0, "dispute").otherwise("refund").alias("reason"))
    return evaluate.label_breakdown(_labels(spark, d), wanted)


@query("SELECT quantile_disc(amount_paise, 0.5) AS p50, quantile_disc(amount_paise, 0.9) AS p90, quantile_disc(amount_paise, 0.99) AS p99 FROM bus")
def agg_percentile(spark, d):
    return evaluate.percentiles(T.bus(spark, d), "amount_paise", [0.5, 0.9, 0.99])


@query("SELECT key, arg_max(occurred_at, seq) AS computed_at, round(arg_max(network_risk, seq) FILTER (network_risk IS NOT NULL), 6) AS network_risk FROM dep1 GROUP BY key")
def win_feature_lastwrite(spark, d):
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.dedupe(T.deposits(spark, d)).withColumn("n", F.last("network_risk", ignorenulls=True).over(w))
    return rows.groupBy("key").agg(F.max_by("occurred_at", "seq").alias("computed_at"), F.round(F.max_by("n", "seq"), 6).alias("network_risk"))


# --- replay of a synthetic world


@query("SELECT NULL AS family, 78 AS n, 1.0 AS decision_accuracy, 1.0 AS code_accuracy")
def scenario_replay(spark, d):
    w = scenario.world(spark)
    verdict = replay.replay(w["requests"].drop("family"), w["tokens"], w["overlays"], scenario.NOW, Params(interruption_cost=scenario.COST))
    rows = evaluate.per_debit(w["expected"], verdict.select("evaluation_id", F.col("answer").alias("actual_decision"), F.col("code").alias("actual_code")))
    return evaluate.accuracy(rows).where("family is null").select("family", "n", "decision_accuracy", "code_accuracy")
