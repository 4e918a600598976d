import random

import pytest

from lienwise.operators import quantiles


def rows(n=3000):
    rng = random.Random(4)
    out = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, int(rng.lognormvariate(8, 2)) + 1, "x") for i in range(n)]
    out += [("same", n + i, 700, "x") for i in range(40)]
    return out + [("none", -1, 0, "x"), ("none", -2, None, "x"), (None, -3, 5, "x"), ("", -4, 5, "x"), ("one", -5, 5, "x")]


def brute(log, q):
    seen, out = {}, {}
    for who, seq, x, _ in sorted(log, key=lambda r: r[1]):
        if who and x:
            old = sorted(seen.setdefault(who, []))
            out[who, seq] = (x, len(old), old[min(len(old) - 1, int(q * len(old)))] if old else 0.0)
            seen[who].append(x)
    return out


@pytest.mark.parametrize(("q", "block", "dealing"), [(0.95, 4096, {}), (0.95, 64, {"hot": 4, "cuts": 7, "least": 20}), (0.5, 1, {}), (1.0, 100, {})])
def test_running_quantiles_are_within_the_error(spark, q, block, dealing):
    log = rows(3000 if block > 1 else 300)
    df = spark.createDataFrame(log, "principal string, seq long, amount_paise long, usual string").repartition(5)
    got = {(r["principal"], r["seq"]): r for r in quantiles.running(df, q, block=block, **dealing).collect()}
    want = brute(log, q)
    assert got.keys() == want.keys()
    for k, (x, n, exact) in want.items():
        r = got[k]
        assert (r["amount_paise"], r["n_amount"]) == (x, n)
        assert abs(r["usual"] - exact) <= quantiles.ERROR * exact * (1 + 1e-9), k
        assert r["over"] == pytest.approx(max(0, (x - r["usual"]) / (r["usual"] + 1e-9)))


def test_blocks_and_cuts_give_one_result(spark, monkeypatch):
    df = spark.createDataFrame(rows(600), "principal string, seq long, amount_paise long, usual string")
    found = [sorted(map(tuple, quantiles.running(df, block=b, **d).collect())) for b, d in ((4096, {}), (7, {}), (32, {"hot": 4, "cuts": 7, "least": 20}))]
    assert found[0] == found[1] == found[2]
    assert quantiles.running(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        quantiles.running(df, q=2)
    with pytest.raises(ValueError):
        quantiles.running(df, error=0)
