import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lienwise.operators import behaviour, intent, scan, training

SMALL = {"hot": 8, "cuts": 7, "least": 20}  # cuts keys of small tables


@pytest.fixture(scope="module")
def log(spark):
    """One principal has nine tenths of all events; some of one and two, a
    constant amount, nulls, zeros and equal times."""
    rng, rows = random.Random(3), []
    for seq in range(900):
        who = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", "c", None])
        amount = rng.choice([rng.randrange(1, 10**6), 500, 0, None])
        rows.append((who, seq, amount, rng.choice(["m1", "m2", f"m{seq}", None]), rng.choice([0, seq * 10, seq * 10 + rng.randrange(300), 5])))
    rows += [("one", 2000, 7, "m1", 9), ("two", 2001, 7, "m1", 9), ("two", 2002, 9, "m1", 10)]
    rows += [("same", 3000 + i, 123457, "m1", 100 + i) for i in range(60)]
    return spark.createDataFrame(rows, "principal string, seq long, amount_paise long, merchant_id string, occurred_at long").repartition(6).cache()


def fold(log):
    """Row by row, one state a principal."""
    out = {}
    for who, rows in log.toPandas().sort_values("seq").groupby("principal", dropna=False):
        state = behaviour.Baseline(behaviour.DEFAULT)
        for r in rows.itertuples():
            amount, ts = 0 if pd.isna(r.amount_paise) else r.amount_paise, r.occurred_at
            z, _, speed, novelty, n_amount, n_gap, _, mean, mad, *_ = state.observe(float(amount), "", int(ts))
            out[r.seq] = (amount, ts, z, speed, n_amount, n_gap, mean, mad)
    return out


def close(a, b):
    return a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_the_hot_key_is_cut_and_no_other(log):
    ranges = {r["principal"]: (r["n"], r["least"]) for r in scan.dealt(log, ["principal"], "seq", **SMALL).groupBy("principal").agg(F.countDistinct("_range").alias("n"), F.min("_range").alias("least")).collect()}
    assert ranges.pop("hot") == (8, 1)
    assert set(ranges.values()) == {(1, 0)}


@pytest.mark.parametrize(("dealing", "block"), [({}, None), (SMALL, 7)])
def test_scans_equal_the_fold(log, dealing, block):
    want = fold(log)
    got = {r["seq"]: r for r in behaviour.amounts(log, block=block, **dealing).collect()}
    assert set(got) == {k for k, v in want.items() if v[0] > 0}
    for k, r in got.items():
        assert r["n_amount"] == want[k][4] and close(r["ewma_mean"], want[k][6]) and close(r["ewma_mad"], want[k][7])
        assert r["z"] == pytest.approx(want[k][2], rel=1e-6, abs=1e-9)
    got = {r["seq"]: r for r in behaviour.gaps(log, block=block, **dealing).collect()}
    assert got
    for k, r in got.items():
        assert close(r["speed"], want[k][3]) and r["n_gap"] == want[k][5]
    if block is None:
        last = {r["principal"]: r for r in behaviour.ewma(log, **dealing).collect()}
        assert last["one"]["ewma_mean"] == 7 and last["same"]["ewma_mad"] == 0


def test_a_constant_amount_never_deviates(log):
    assert {r["z"] for r in behaviour.amounts(log).where("principal = 'same'").collect()} == {0.0}


@pytest.mark.parametrize("dealing", [{}, SMALL])
def test_novelty_counts_what_came_before(log, dealing):
    seen, visits = {}, {}
    want = {}
    for r in log.toPandas().sort_values("seq").itertuples():
        k = (r.principal, r.merchant_id)
        want[r.seq] = max(0.0, 1 - seen.get(k, 0) / (visits.get(r.principal, 0) + 1))
        seen[k], visits[r.principal] = seen.get(k, 0) + 1, visits.get(r.principal, 0) + 1
    got = {r["seq"]: r["novelty"] for r in behaviour.novelty(log, **dealing).collect()}
    assert got.keys() == want.keys() and all(close(got[k], want[k]) for k in got)


@pytest.mark.parametrize("dealing", [{}, SMALL])
def test_running_sums_and_the_row_before(log, dealing):
    rows = scan.dealt(log, ["principal"], "seq", **dealing)
    got = {r["seq"]: (r["n"], r["total"]) for r in scan.running(rows, ["principal"], [F.col("seq")], {"n": F.lit(1), "total": F.coalesce("amount_paise", F.lit(0))}).collect()}
    before = {r["seq"]: r["last"] for r in scan.previous(scan.numbered(log, ["principal"], "seq", **dealing), ["principal"], {"last": "seq"}, block=5).collect()}
    n, total, last = {}, {}, {}
    for r in log.toPandas().sort_values("seq").itertuples():
        k = r.principal
        n[k], total[k] = n.get(k, 0) + 1, total.get(k, 0) + (0 if pd.isna(r.amount_paise) else int(r.amount_paise))
        assert got[r.seq] == (n[k], total[k]) and before[r.seq] == last.get(k)
        last[k] = r.seq


@pytest.mark.parametrize("dealing", [{}, SMALL])
def test_envelopes_are_replaced_whole(spark, dealing):
    rng, rows, held, want = random.Random(9), [], {}, {}
    for seq in range(400):
        who = "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None])
        sealed = rng.random() < 0.1
        fields = (rng.choice(["m1", "m2", None]), rng.choice([100, 200, None])) if sealed else (None, None)
        rows.append((who, seq, sealed, *fields))
        if sealed:
            held[who] = fields
        else:
            want[seq] = held.get(who, (None, None))
    log = spark.createDataFrame(rows, "session_id string, seq long, sealed boolean, merchant string, cap long").repartition(5)
    got = {r["seq"]: (r["env_merchant"], r["env_cap"]) for r in intent.latest_envelope(log, ["merchant", "cap"], **dealing).collect()}
    assert got == want


@pytest.mark.parametrize("dealing", [{}, SMALL])
def test_labels_see_the_last_vector_before_them(spark, dealing):
    rng = random.Random(4)
    token = lambda: "hot" if rng.random() < 0.8 else rng.choice(["a", "b"])
    vectors = [(token(), rng.randrange(300), seq, [float(seq)]) for seq in range(400)]
    labels = [(token(), rng.randrange(-5, 300), rng.choice([0.0, 1.0]), float(i)) for i in range(200)]
    want = []
    for t, at, value, weight in labels:
        past = [(when, seq, v) for u, when, seq, v in vectors if u == t and when <= at]
        if past:
            want.append((weight, max(past)[2][0], value))
    got = training.examples(spark.createDataFrame(labels, "token_id string, occurred_at long, value double, weight double"), spark.createDataFrame(vectors, "token_id string, occurred_at long, seq long, vector array<double>"), **dealing)
    assert sorted((r["w"], r["vector"][0], r["y"]) for r in got.collect()) == sorted(want)


def test_empty_table(spark, log):
    none = log.limit(0)
    assert behaviour.amounts(none).count() == behaviour.gaps(none).count() == behaviour.novelty(none).count() == 0
