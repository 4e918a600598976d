"""The fixtures of the domain: one small table per rule."""

import hashlib
import hmac
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lienwise.functions import scalars as S
from lienwise.operators import behaviour, blockstate, features, graph, intent, labels, ledger, predicates, reputation, training, vault
from lienwise.operators import evaluate as ev
from lienwise.operators import log as L
from lienwise.params import Params
from lienwise.plans import replay, scenario, verdicts
from lienwise.sources import connectors

NOW = 1_700_000_000
RESOLVED = "nonce string, nonce_spent boolean, caller_id string, t_customer_id string, customer_id string, t_status string, t_expire_at long, b_consumed_total long, b_consumed_today long, amount_paise long, t_token_ceiling_paise long, cart_hash string, bound_amount_paise long, t_max_amount_paise long, t_max_per_day_paise long, o_per_debit long, o_per_day long, o_denied_merchant string, merchant_id string, envelope_digest string, envelope_max_paise long"
BASE = dict(nonce="n", nonce_spent=False, caller_id="c", t_customer_id="u", customer_id="u", t_status="confirmed", t_expire_at=NOW + 3600, b_consumed_total=0, b_consumed_today=0, amount_paise=50_000, t_token_ceiling_paise=2_000_000, cart_hash="h", bound_amount_paise=None, t_max_amount_paise=200_000, t_max_per_day_paise=500_000, o_per_debit=None, o_per_day=None, o_denied_merchant=None, merchant_id="m", envelope_digest="d", envelope_max_paise=None)
CASES = [
    ({}, None),
    ({"nonce_spent": True}, "P1"),
    ({"nonce_spent": True, "nonce": ""}, None),
    ({"caller_id": ""}, "P5"),
    ({"t_customer_id": None, "t_status": None, "t_expire_at": None, "t_token_ceiling_paise": None, "t_max_amount_paise": None, "t_max_per_day_paise": None}, "P5"),
    ({"t_customer_id": "other"}, "P5"),
    ({"t_status": "pending"}, "P4"),
    ({"t_status": "cancelled"}, "P4"),
    ({"t_expire_at": NOW - 1}, "P4"),
    ({"t_expire_at": NOW}, None),
    ({"t_expire_at": 0}, None),
    ({"b_consumed_total": 1_950_001}, "P4"),
    ({"b_consumed_total": 1_950_000}, None),
    ({"cart_hash": ""}, "P6"),
    ({"bound_amount_paise": 50_001}, "P6"),
    ({"amount_paise": 250_000}, "P2"),
    ({"amount_paise": 200_000}, None),
    ({"b_consumed_today": 450_001}, "P2"),
    ({"o_per_debit": 49_999}, "P2"),
    ({"o_per_day": 49_999}, "P2"),
    ({"o_denied_merchant": "m"}, "P2"),
    ({"envelope_digest": "", "amount_paise": 100_001}, "P3"),
    ({"envelope_digest": "", "amount_paise": 100_000}, None),
    ({"envelope_max_paise": 100_000, "amount_paise": 100_001}, "P3"),
    ({"amount_paise": 250_000, "t_status": "pending"}, "P4"),
]


def test_predicates(spark):
    names = [x.split()[0] for x in RESOLVED.split(", ")]
    rows = [(i, *(({**BASE, **c})[n] for n in names)) for i, (c, _) in enumerate(CASES)]
    got = spark.createDataFrame(rows, f"i int, {RESOLVED}").select("i", predicates.cascade(F.lit(NOW))["predicate"].alias("p")).collect()
    assert {r["i"]: r["p"] for r in got} == {i: p for i, (_, p) in enumerate(CASES)}


LOG = "seq long, event_id string, type string, decision string, token_id string, nonce string, amount_paise long, occurred_at long, agent_id string"


def log_of(spark, *rows):
    return spark.createDataFrame([(i + 1, r[0], r[1], r[2], "t", r[3], r[4], r[5], r[6] if len(r) > 6 else "ag") for i, r in enumerate(rows)], LOG)


def test_block_fold(spark):
    day = 1_000_000
    rows = log_of(
        spark,
        ("a", "payment.captured", None, "n1", 30_000, day),
        ("b", "payment.captured", None, "n2", 20_000, day + 10),
        ("b", "payment.captured", None, "n2", 20_000, day + 10),
        ("c", "payment.captured", None, "n3", 15_000, day + 86_400),
        ("d", "payment.captured", None, "n4", 1_000, day),
        ("e", "payment.captured", None, "n5", 1_000, day + 86_400),
        ("f", "decision.made", "ALLOW", "n6", 9, day),
        ("g", "decision.made", "STEP_UP", "n7", 9, day),
        ("h", "payment.captured", None, "n8", 0, day),
    )
    once = L.dedupe(rows)
    got = [(r["consumed_today"], r["consumed_total"]) for r in blockstate.running_consumption(once).orderBy("seq").collect()]
    assert got == [(30_000, 30_000), (50_000, 50_000), (15_000, 65_000), (1_000, 66_000), (1_000, 67_000)]
    assert blockstate.nonce_set(once).first()["seen_nonces"] == ["n1", "n2", "n3", "n4", "n5", "n6"]
    assert blockstate.block_state(once).first().asDict() == {"token_id": "t", "consumed_today": 1_000, "consumed_total": 67_000, "last_computed_at": day + 86_400}


@pytest.mark.parametrize(
    "events, reasons",
    [
        ("D", ["dispute"]),
        ("X", ["cancellation"]),
        ("SC", ["confirmed_step_up"]),
        ("C", []),
        ("AC", []),
        ("SDC", ["dispute"]),
        ("CS", []),
        ("SCC", ["confirmed_step_up"]),
        ("SXC", ["cancellation", "confirmed_step_up"]),
        ("SCSC", ["confirmed_step_up", "confirmed_step_up"]),
    ],
)
def test_labels(spark, events, reasons):
    kinds = {"D": ("payment.disputed", None), "X": ("token.cancelled", None), "S": ("decision.made", "STEP_UP"), "A": ("decision.made", "ALLOW"), "C": ("payment.captured", None)}
    rows = log_of(spark, *[(f"e{i}", *kinds[e], "n1", 5, 100 + i) for i, e in enumerate(events)])
    got = labels.labels(rows).orderBy("seq").collect()
    assert [r["reason"] for r in got] == reasons
    assert all(r["event_id"].startswith(f"label:{r['reason']}:e") for r in got)


def test_label_set_prefers_misuse(spark):
    rows = spark.createDataFrame([("t", 1.0, 0.5, "cancellation", 5, 1), ("t", 0.0, 1.0, "confirmed_step_up", 9, 2), ("t", 1.0, 1.0, "dispute", 5, 3)], "token_id string, value double, weight double, reason string, occurred_at long, seq long")
    assert labels.label_set(rows).first()["reason"] == "dispute"


@pytest.mark.parametrize("kind, n, want", [("captured", 1, 11 / 21), ("captured", 100, 110 / 120), ("failed", 1, 10 / 21), ("disputed", 1, 10 / 25)])
def test_reputation(spark, kind, n, want):
    rows = log_of(spark, *[(f"e{i}", f"payment.{kind}", None, "n", 5, 1) for i in range(n)], ("x", "payment.captured", None, "n", 5, 1, ""))
    got = reputation.reputation(rows).collect()
    assert len(got) == 1 and got[0]["reputation"] == pytest.approx(want)


def test_feature_merge_and_freshness(spark):
    cols = "seq long, event_id string, key string, occurred_at long, behaviour_deviation double, intent_divergence double, network_risk double, reputation double, consumption_frac double"
    rows = [(1, "a", "k", 50, 0.4, None, None, None, None), (2, "b", "k", 40, None, None, None, 9.0, None), (3, "a", "k", 99, 0.9, None, None, None, None), (4, "c", "", 1, 0.1, None, None, None, None), (5, "d", "k", 30, None, -2.0, None, None, None)]
    r = features.merge_deposits(spark.createDataFrame(rows, cols)).collect()
    assert len(r) == 1 and (r[0]["behaviour_deviation"], r[0]["reputation"], r[0]["intent_divergence"], r[0]["network_risk"], r[0]["computed_at"]) == (0.4, 1.0, 0.0, None, 30)
    ages = spark.createDataFrame([(NOW,), (NOW - 300,), (NOW - 301,), (None,), (NOW + 9,)], "c long")
    state = lambda b: [x[0] for x in ages.select(S.freshness(F.col("c"), F.lit(NOW), b)).collect()]
    assert state(300) == ["fresh", "fresh", "stale", "missing", "fresh"] and state(0) == ["fresh", "fresh", "fresh", "missing", "fresh"]


def test_decide(spark):
    rows = spark.createDataFrame([(False, 10_000), (False, 10_001), (True, 0)], "d boolean, l long")
    got = [r[0]["code"] for r in rows.select(S.decide(F.col("d"), F.col("l"), 10_000)).collect()]
    assert got == ["OK_ALLOW", "STEPUP_RISK", "STEPUP_FAILCLOSED"]


def test_quantile_estimate():
    import random

    rng = random.Random(3)
    for q, true, near in ((0.5, 100, 2), (0.95, 100 + 15 * 1.645, 4)):
        m = behaviour.MarkerQuantile(q)
        assert m.estimate() == 0.0
        xs = [rng.gauss(100, 15) for _ in range(4000)]
        for i, x in enumerate(xs):
            m.push(x)
            if i < 4:
                assert m.estimate() == sorted(xs[: i + 1])[min(i, int(q * (i + 1)))]
            if i == 4:
                assert m.estimate() == sorted(xs[:5])[2]
        assert abs(m.estimate() - true) < near
    same = behaviour.MarkerQuantile(0.95)
    for _ in range(50):
        same.push(7.0)
    assert same.estimate() == 7.0


def test_behaviour(spark):
    rows = [("p", i, 10_000, "m", 1000 + 3600 * i) for i in range(60)] + [("p", 60, 500_000, "new", 1000 + 3600 * 60), ("q", 0, 10_000, "m", 5), ("q", 1, 999_999, "m", 6), ("", 3, 5, "m", 9)]
    df = spark.createDataFrame(rows, "principal string, seq long, amount_paise long, merchant_id string, occurred_at long").repartition(3)
    got = {(r["principal"], r["seq"]): r for r in behaviour.deviations(behaviour.signals(df)).collect()}
    assert got["p", 59]["deviation"] < 0.1 and got["p", 60]["deviation"] > 0.7 and got["q", 1]["deviation"] < 0.3
    assert got["p", 0]["z"] == 0 and len(got["p", 9]["vector"]) == 6 and len(got) == 63
    x = spark.createDataFrame([("k", i, v) for i, v in enumerate((1.0, 2.0, 4.0))], "principal string, seq long, amount_paise double")
    r = behaviour.ewma(x).first()
    assert (round(r["ewma_mean"], 2), round(r["ewma_mad"], 2)) == (1.39, 0.38)


def test_graph(spark):
    e = lambda *p: spark.createDataFrame([(min(a, b), max(a, b), 0) for a, b in p], "a string, b string, ts long")
    star = e(*[("agent:a", f"token:{i}") for i in range(5)])
    assert {r["node"]: r["fan_out"] for r in graph.fan_out(star).collect()}["agent:a"] == 5
    ring = e(*[("device:d", f"token:{i}") for i in range(3)])
    assert all(r["shared_attributes"] == 2 for r in graph.shared_attributes(ring).collect())
    path = e(("token:1", "device:d"), ("device:d", "token:2"), ("token:8", "device:e"))
    seeds = spark.createDataFrame([("token:1", 1.0)], "node string, label double")
    s = {r["node"]: r["score"] for r in graph.propagate(path, seeds).collect()}
    assert s["token:1"] == 1 and 0 < s["token:2"] < 1 and s["token:8"] == 0
    assert all(r["score"] == 0 for r in graph.propagate(path, seeds.limit(0)).collect())
    assert {r["node"]: r["size"] for r in graph.components(path).collect()}["token:8"] == 2
    log = spark.createDataFrame([("t", "t2", 1, 5), ("t", "", 2, 6)], "token_id string, agent_id string, seq long, occurred_at long")
    assert graph.edges(log).count() == 1
    risk = {r["node"] for r in graph.network_risk(path, seeds).collect()}
    assert risk == {"token:1", "token:2", "token:8"}


def test_intent(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first()["v"]
    vec = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert val(S.semantic_distance(S.cosine(vec(1, 0), vec(2, 0)))) == 0
    assert val(S.semantic_distance(S.cosine(vec(1, 0), vec(0, 3)))) == 0.5
    assert val(S.semantic_distance(S.cosine(vec(1, 0), vec(-1, 0)))) == 1
    assert val(S.cosine(vec(1), vec(1, 2))) == 0 and val(S.cosine(vec(0, 0), vec(1, 2))) == 0
    assert [val(S.normalise_purpose(F.lit(x))) for x in (" Buy ", "top_up", "Recurring", "gift")] == ["purchase", "top-up", "subscription", ""]
    assert val(intent.debit_divergence(F.lit(1.0), F.lit("purchase"), F.lit("top-up"), F.lit(True))) == 0.5
    assert val(intent.debit_divergence(F.lit(1.0), F.lit(""), F.lit("top-up"), F.lit(True))) == 0
    assert val(intent.debit_divergence(F.lit(1.0), F.lit(""), F.lit(""), F.lit(False))) == 0.85
    blob = '{"category":"shoes","constraints":{},"max_amount_paise":5,"merchant_preference":"a \\"b\\"","purpose":"purchase"}'
    assert val(intent.envelope_digest(F.lit("buy"), F.lit(" Shoes "), F.lit(5), F.lit('A "b"'))) == hashlib.sha256(blob.encode()).hexdigest()
    v = intent.hashed_embedding(spark.createDataFrame([("red shoe",), (None,)], "text string"), "text").collect()
    assert math.isclose(sum(x * x for x in v[0]["vector"]), 1) and not any(v[1]["vector"])
    key, text = b"secret", "message"
    assert val(S.hmac_sha256(F.lit(key), F.lit(text))) == hmac.new(key, text.encode(), hashlib.sha256).hexdigest()


RECORD = "seq long, token_id string, evaluation_id string, request_digest string, decision string, code string, predicate_failed string, evidence_digest string, policy_version int, ts long"


def test_ledger(spark):
    rows = spark.createDataFrame([(i, f"t{i % 2}", f"e{i}", "r", "ALLOW", "OK", None, "", 1, i) for i in range(6)], RECORD)
    chain = ledger.append(rows)
    got = chain.orderBy("seq").collect()
    assert got[0]["prev_hash"] == "" and all(a["hash"] == b["prev_hash"] for a, b in zip(got, got[1:]))
    assert ledger.verify(chain).count() == 0 and ledger.verify(chain.limit(0)).count() == 0
    bad = chain.withColumn("code", F.when(F.col("seq") == 1, "X").otherwise(F.col("code"))).withColumn("prev_hash", F.when(F.col("seq") == 3, "x").otherwise(F.col("prev_hash")))
    assert {(r["seq"], r["broken"], r["tampered"]) for r in ledger.verify(bad).collect()} == {(1, False, True), (3, True, True)}
    per = ledger.append_by_token(rows).collect()
    assert sum(r["prev_hash"] == "" for r in per) == 2
    assert ledger.merkle_root(ledger.append_by_token(rows)).first()["root"] == ledger.merkle_root(ledger.append_by_token(rows.repartition(5))).first()["root"]


def test_vault(spark):
    plain = spark.createDataFrame([("s1", "contact", "a", 1), ("s1", "contact", "b", 2), ("s2", "contact", "c", 1), ("s3", "contact", "", 1)], "session_id string, field string, plaintext string, seq long")
    keys = vault.keyring(plain)
    sealed = vault.seal(plain, keys)
    asked = plain.select("session_id", "field").distinct()
    status = lambda s, k: {r["session_id"]: (r["status"], r["plaintext"]) for r in vault.reveal(asked, s, k).collect()}
    assert status(sealed, keys) == {"s1": ("ok", "b"), "s2": ("ok", "c"), "s3": ("not_found", None)}
    rows, ring = vault.erase(sealed, keys, spark.createDataFrame([("s1",)], "session_id string"))
    assert status(rows, ring)["s1"][0] == "not_found" and status(sealed, ring)["s1"] == ("erased", None)
    moved = sealed.withColumn("session_id", F.when(F.col("session_id") == "s1", "s2").otherwise("s1"))
    assert {v[0] for k, v in status(moved, keys).items() if k != "s3"} == {"corrupt"}


def test_training(spark):
    v = spark.createDataFrame([("t1", 100, 1, [1.0]), ("t1", 300, 2, [2.0]), ("t2", 50, 3, [3.0])], "token_id string, occurred_at long, seq long, vector array<double>")
    lab = spark.createDataFrame([("t1", 200, 1.0, 1.0), ("t2", 40, 0.0, 1.0), ("t1", 300, 0.0, 0.5)], "token_id string, occurred_at long, value double, weight double")
    got = sorted((r["token_id"], r["vector"][0], r["y"], r["w"]) for r in training.examples(lab, v).collect())
    assert got == [("t1", 1.0, 1.0, 1.0), ("t1", 2.0, 0.0, 0.5)]
    rows = spark.createDataFrame([([float(i % 7), float(i)], float(i > 20), 1.0) for i in range(40)], "vector array<double>, y double, w double")
    model = training.fit_scorer(rows, trees=3)
    out = training.calibrated(model, rows).collect()
    assert all(0 <= r["calibrated"] <= 1 for r in out) and training.fit_scorer(rows.where("y = 0")) is None
    odd = rows.unionByName(spark.createDataFrame([([500.0, -500.0], 0.0, 1.0)], rows.schema))
    floor = {tuple(r["vector"]): r["iso_floor"] for r in training.isolation_floor(odd, trees=20).collect()}
    assert max(floor, key=floor.get) == (500.0, -500.0)


def test_evaluation(spark):
    rows = [("1", "legit", False, 100, "ALLOW", "ALLOW"), ("2", "legit", False, 200, "ALLOW", "STEP_UP"), ("3", "scope", True, 500, "STEP_UP", "STEP_UP"), ("4", "replay", True, 700, "BLOCK", "BLOCK"), ("5", "bust", True, 1000, "STEP_UP", "ALLOW"), ("6", "legit", False, 300, "ALLOW", None)]
    exp = spark.createDataFrame([(*r[:5], "x") for r in rows], "evaluation_id string, family string, is_misuse boolean, amount_paise long, expected_decision string, expected_code string")
    act = spark.createDataFrame([(r[0], r[5], "x") for r in rows if r[5]], "evaluation_id string, actual_decision string, actual_code string")
    d = ev.per_debit(exp, act)
    loss = ev.expected_loss(d).first()
    assert [loss[c] for c in ("gate_expected", "gated", "leaked", "at_risk_paise", "gated_paise", "leaked_paise", "false_friction", "allow_expected")] == [3, 2, 1, 2200, 1200, 1000, 1, 2]
    acc = {r["family"]: (r["n"], r["decision_accuracy"]) for r in ev.accuracy(d).collect()}
    assert acc["legit"] == (3, round(1 / 3, 4)) and acc[None] == (6, 0.5)
    assert ev.headline(d).first()["evaluated"] == 5
    assert {r["expected_decision"]: r["STEP_UP"] for r in ev.confusion(d).collect()} == {"ALLOW": 1, "STEP_UP": 1, "BLOCK": 0}


def test_world_is_judged_right(spark):
    w = scenario.world(spark, 3)
    got = replay.replay(w["requests"].drop("family"), w["tokens"], w["overlays"], scenario.NOW, Params(interruption_cost=scenario.COST))
    both = w["expected"].join(got, "evaluation_id")
    assert both.count() == w["expected"].count() == 39
    assert both.where("expected_code <> code or expected_decision <> answer").count() == 0


def test_connectors(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"event_id":"a","type":"payment.captured","seq":1}\n\nnot json\n{"event_id":"b","type":"token.confirmed","seq":2}\n')
    log = connectors.read_jsonl(spark, str(path))
    assert sorted(r["event_id"] for r in log.collect()) == ["a", "b"]
    connectors.write_log(log, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        connectors.write_log(log.withColumn("type", F.lit("odd")), str(tmp_path / "out"))
    good, bad = connectors.contained(spark.createDataFrame([(1, 2, 3), (0, 2, 3), (3, 2, 5), (None, 1, 1)], "max_amount_paise long, max_per_day_paise long, token_ceiling_paise long"))
    assert (good.count(), bad.count()) == (1, 3)
    raw = spark.createDataFrame([('{"k": 5}',), ("broken",), (None,)], "payload string")
    assert [r[0] for r in L.decode(raw, "k long").select("payload.k").collect()] == [5]


def test_components_of_a_long_falling_path(spark):
    at = ["token:000", *(f"token:{i:03d}" for i in range(120, 0, -1))]
    path = spark.createDataFrame([(min(x), max(x), 0) for x in zip(at, at[1:])], "a string, b string, ts long")
    assert {(r["component"], r["size"]) for r in graph.components(path).collect()} == {("token:000", 121)}
    with pytest.raises(RuntimeError):
        graph.components(path, max_rounds=2)


def test_components_of_shuffled_paths_and_grids(spark):
    rng = np.random.default_rng(0)
    order = rng.permutation(1000)
    rows = [(f"token:{order[i]:04}", f"token:{order[i + 1]:04}") for i in range(999)]
    rows += [(f"token:g{min(a, b):03}", f"token:g{max(a, b):03}") for x in range(12) for y in range(12) for a, b in ((x * 12 + y, x * 12 + y + 1), (x * 12 + y, x * 12 + y + 12)) if b < 144 and (b - a == 12 or y < 11)]
    path = spark.createDataFrame([(min(a, b), max(a, b), 0) for a, b in rows], "a string, b string, ts long").repartition(4)
    assert {(r["component"], r["size"]) for r in graph.components(path).collect()} == {("token:0000", 1000), ("token:g000", 144)}


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 200])
def test_hmac_of_keys_of_any_length(spark, size):
    key, text = bytes(range(256))[:size], "message"
    mac = hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    got = spark.range(1).select(S.hmac_sha256(F.lit(key), F.lit(text)), S.hmac_verify(F.lit(key), F.lit(text), F.lit(mac.upper())), S.hmac_verify(F.lit(key), F.lit("other"), F.lit(mac))).first()
    assert tuple(got) == (mac, True, False)


def test_hmac_query_over_its_whole_table(spark):
    from lienwise import catalog

    sf = "/root/testdata/sf0.001"
    tokens = {r["event_id"]: r["token_id"] for r in catalog.T.bus(spark, sf).select("event_id", "token_id").collect()}
    got = {r["event_id"]: r["mac"] for r in catalog.fn_hmac(spark, sf).collect()}
    assert got == {e: hmac.new(t.encode(), e.encode(), hashlib.sha256).hexdigest() for e, t in tokens.items()}


def test_vault_keys_are_random(spark):
    sessions = spark.createDataFrame([("s1",), ("s2",), (None,)], "session_id string")
    a, b = ({r["session_id"]: bytes(r["key"]) for r in vault.keyring(sessions).collect()} for _ in range(2))
    assert set(a) == {"s1", "s2"} and all(len(k) == 32 for k in a.values()) and len({*a.values(), *b.values()}) == 4
    ring = vault.keyring(sessions)
    assert sorted(map(tuple, ring.collect())) == sorted(map(tuple, ring.collect()))


def test_chains_by_token_are_verified_on_their_own(spark):
    rows = spark.createDataFrame([(i, f"t{i % 2}", f"e{i}", "r", "ALLOW", "OK", None, "", 1, i) for i in range(8)], RECORD)
    chain = ledger.append_by_token(rows)
    assert ledger.verify(chain, "token_id").count() == 0
    bad = chain.withColumn("code", F.when(F.col("seq") == 2, "X").otherwise(F.col("code")))
    assert [tuple(r) for r in ledger.verify(bad, "token_id").collect()] == [(2, False, True)]
    assert {(r["token_id"], r["seq"], r["n"]) for r in ledger.heads(chain).collect()} == {("t0", 6, 4), ("t1", 7, 4)}


def test_provenance_round_trip(spark):
    records = spark.createDataFrame([(1, "t1", "e1", "r", "ALLOW", "OK", "", "", 1, 5)], RECORD)
    events = spark.createDataFrame([(1, "e1", "decision.made", "t1", 5), (9, "e1", "decision.made", "t1", 6), (2, "e2", "payment.captured", "t1", 7)], "seq long, evaluation_id string, type string, token_id string, occurred_at long")
    told = verdicts.with_provenance(events, records)
    assert told.where("seq = 1").first()["provenance"]["predicate_failed"] is None
    assert [r.asDict() for r in verdicts.records_of(told).select(records.columns).collect()] == [records.first().asDict()]


def test_a_scorer_can_be_put_in(spark):
    from lienwise import catalog

    sf = "/root/testdata/sf0.001"
    none = verdicts.evaluate(*catalog._inputs(spark, sf), catalog.T.NOW, catalog.LIVE, scorer=lambda p: F.lit(0.0))
    sure = verdicts.evaluate(*catalog._inputs(spark, sf), catalog.T.NOW, catalog.LIVE, scorer=lambda p: F.lit(1.0))
    assert none.count() > 100 and none.where("loss <> 0").count() == 0 and sure.where("loss <> amount_paise").count() == 0
    allowed = [df.where("answer = 'ALLOW'").count() for df in (none, sure)]
    assert allowed[0] >= allowed[1]


def test_features_give_the_same_evidence_however_they_are_joined(spark, monkeypatch):
    from lienwise import catalog

    sf = "/root/testdata/sf0.001"
    r, *_, f = catalog._inputs(spark, sf)
    cols = ("evaluation_id", "e_behaviour_deviation", "e_network_risk", "e_intent_divergence", "e_reputation", "missing", "stale", "degraded")
    rows = lambda: sorted(map(repr, features.with_features(r, f, catalog.T.NOW).select(*cols).collect()))
    few = rows()
    monkeypatch.setattr(features, "BROADCAST_ROWS", 0)
    assert rows() == few


def test_retraining_trains_where_it_can(spark):
    rows = spark.createDataFrame([([float(i % 7), float(i)], float(i > 20)) for i in range(60)], "vector array<double>, y double")
    models, report = training.retrain({"one": rows, "two": rows.where("y = 0"), "three": rows.limit(0)}, trees=3)
    got = {r["layer"]: r for r in report.collect()}
    assert set(models) == {"one"} and got["one"]["trained"] and got["one"]["mean_misuse"] > got["one"]["mean_legit"]
    assert (got["two"]["reason"], got["three"]["reason"], got["three"]["n"]) == ("one class", "no examples", 0)
    hops = rows.selectExpr("concat('token:', cast(vector[1] as int)) node", "vector[0] f0", "vector[1] f1")
    seeds = hops.where("f1 % 2 = 0").select("node", (F.col("f1") > 20).cast("double").alias("label"))
    learned = {r["node"]: r["learned"] for r in training.learned_network_risk(hops, seeds, trees=5).collect()}
    assert len(learned) == 60 and learned["token:51"] > learned["token:3"]


def test_two_appends_are_one(spark):
    rows = spark.createDataFrame([(i, f"t{i * i % 3}", f"e{i}", "d", "ALLOW", "C", "", "", 1, i) for i in range(40)], "seq long, token_id string, evaluation_id string, request_digest string, decision string, code string, predicate_failed string, evidence_digest string, policy_version int, ts long")
    whole = ledger.append_by_token(rows)
    first = ledger.append_by_token(rows.where("seq < 17"))
    held = ledger.heads(first)
    rest = ledger.append_by_token(rows.where("seq >= 17 and token_id <> 't0' or seq > 30"), held)
    skipped = rows.where("seq >= 17 and token_id = 't0' and seq <= 30").count()
    assert skipped  # a token can miss an append
    same = lambda df: sorted((r["seq"], r["prev_hash"], r["hash"]) for r in df.where("token_id <> 't0'").collect())
    assert same(first.unionByName(rest)) == same(whole)
    assert sorted(map(tuple, ledger.moved_heads(held, rest).where("token_id <> 't0'").collect())) == sorted(map(tuple, ledger.heads(whole).where("token_id <> 't0'").collect()))
    assert ledger.verify(rest, "token_id", held).count() == 0
    assert {r["seq"] for r in ledger.verify(rest.withColumn("code", F.when(F.col("seq") == 20, "X").otherwise(F.col("code"))), "token_id", held).collect()} == {20} - {r["seq"] for r in rows.where("seq = 20 and token_id = 't0'").collect()}
    assert ledger.verify(rest, "token_id").count() > 0  # without the heads its first links are broken


def test_hmac_of_many_rows_takes_little_time(spark):
    rows = spark.range(400_000).select(F.col("id").cast("string").alias("m"))
    spark.range(10).select(S.hmac_sha256(F.lit(b"k"), F.lit(None).cast("string"))).collect()
    start = time.perf_counter()
    assert rows.select(S.hmac_sha256(F.concat(F.lit("key"), "m"), F.col("m")).alias("h")).agg(F.count_distinct("h")).first()[0] == 400_000
    assert time.perf_counter() - start < 20


def test_embedding_in_pieces_of_bounded_size(spark, monkeypatch):
    texts = [" ".join(f"w{i * 40 + j}" for j in range(40)) for i in range(500)] + [None, "", "w1 w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {r["doc_id"]: list(r["vector"]) for r in intent.hashed_embedding(df, "text").collect()}
    monkeypatch.setattr(intent, "PIECE_TOKENS", 100)
    assert {r["doc_id"]: list(r["vector"]) for r in intent.hashed_embedding(df, "text").collect()} == want
    for i, t in enumerate(texts):
        v = np.zeros(len(want[i]))
        for w in (t or "").split():
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "big") % len(v)] += 1 if h[4] & 1 else -1
        assert np.allclose(want[i], v / max(np.linalg.norm(v), 1e-300) if v.any() else v)


def test_the_learned_risk_finds_components_once(spark, monkeypatch):
    from lienwise import catalog

    calls, whole = [], graph.components
    monkeypatch.setattr(graph, "components", lambda *a, **k: calls.append(1) or whole(*a, **k))
    monkeypatch.setattr(training, "fit_scorer", lambda *a, **k: None)
    assert catalog.graph_learned_risk(spark, "/root/testdata/sf0.001").columns == ["key", "node", "risk"]
    assert len(calls) == 1
