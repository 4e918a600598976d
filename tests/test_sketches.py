import hashlib
import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lienwise.functions import scalars as S
from lienwise.operators import intent, sketches


def digest(value, salt=0):
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8, salt=salt.to_bytes(2, "little")).digest(), "big")


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), f"m{int(rng.paretovariate(0.6)) % 700}", i) for i in range(4000)]
    return spark.createDataFrame([*rows, ("a", None, 5000), ("only null", None, 5001), ("a", "", 5002)], "who string, what string, seq long").repartition(5).cache()


def test_hash(spark):
    values = ["", "a", "é😀", None, "a"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r["i"]: r["h"] for r in rows.select("i", sketches.hash64(F.col("v"), 3).alias("h")).collect()}
    assert got == {i: None if v is None else (digest(v, 3) + 2**63) % 2**64 - 2**63 for i, v in enumerate(values)}


def test_counts_are_never_too_low_and_halves_merge(log):
    whole = sketches.frequencies(log, "who", "what")
    exact = Counter((r["who"], r["what"]) for r in log.collect() if r["what"] is not None)
    total = Counter(who for who, _ in exact.elements())
    pairs = log.where("what is not null").select("who", "what").distinct()
    near = pairs.join(whole, pairs["who"].eqNullSafe(whole["who"])).select(pairs["who"], "what", sketches.estimated(F.col("counts"), F.col("what")).alias("n"))
    found = {(r["who"], r["what"]): r["n"] for r in near.collect()}
    assert found.keys() == exact.keys() and all(found[k] >= exact[k] for k in exact)
    over = sum(found[k] - exact[k] > 2.72 / 256 * total[k[0]] for k in exact)
    assert over <= 0.02 * len(exact)
    halves = sketches.frequencies(log.where("seq % 2 = 0"), "who", "what").unionByName(sketches.frequencies(log.where("seq % 2 = 1"), "who", "what"))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(sketches.merged_frequencies(halves, "who")) == rows(whole)


def test_distinct_counts_equal_the_registers_and_halves_merge(log):
    whole = sketches.distinct(log, "who", "what")
    seen = {}
    for r in log.collect():
        if r["what"] is not None:
            h = digest(r["what"])
            own = seen.setdefault(r["who"], ([0] * 256, set()))
            rest = h << 8 & 2**64 - 1
            own[0][h >> 56] = max(own[0][h >> 56], 65 - rest.bit_length() if rest else 1)
            own[1].add(r["what"])
    got = {r["who"]: r for r in whole.select("who", "registers", sketches.cardinality(F.col("registers")).alias("n")).collect()}
    assert {k: r["registers"] for k, r in got.items()} == {k: v[0] for k, v in seen.items()}
    assert all(abs(got[k]["n"] - len(v[1])) <= 4 * 0.065 * len(v[1]) + 1 for k, v in seen.items())
    halves = sketches.distinct(log.where("seq % 2 = 0"), "who", "what").unionByName(sketches.distinct(log.where("seq % 2 = 1"), "who", "what"))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(sketches.merged_distinct(halves, "who")) == rows(whole)


def test_empty_table(log):
    none = log.limit(0)
    assert sketches.frequencies(none, "who", "what").count() == sketches.distinct(none, "who", "what").count() == 0
    assert sketches.merged_frequencies(sketches.frequencies(none, "who", "what"), "who").count() == 0


# --- canonical JSON


def values(rng, depth=0):
    kind = rng.choice(["int", "text", "bool", "none", "decimal"] + ["list", "dict"] * 2 * (depth < 3))
    text = lambda: "".join(rng.choice('aZ é漢😀"\\/\n\t\x01\x1f\x7f<') for _ in range(rng.randrange(6)))
    if kind == "list":
        return [values(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == "dict":
        return {text() + str(i): values(rng, depth + 1) for i in range(rng.randrange(4))}
    return {"int": rng.randrange(-(10**12), 10**12), "text": text(), "bool": rng.random() < 0.5, "none": None, "decimal": rng.randrange(-999, 999) + rng.choice([0.25, 0.5, 0.01])}[kind]


def test_canonical_json_equals_sorted_dumps(spark):
    rng = random.Random(8)
    given = [values(rng) for _ in range(400)] + [{}, [], "", {"b": 1, "a": {"d": [1, 0.5, {}], "c": None}}]
    rows = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))) for i, v in enumerate(given)], "i int, v string")
    got = {r["i"]: r["c"] for r in rows.select("i", S.canonical_json(F.parse_json("v")).alias("c")).collect()}
    assert got == {i: json.dumps(v, sort_keys=True, separators=(",", ":")) for i, v in enumerate(given)}


def test_digest_of_envelopes_with_constraints(spark):
    cases = [("Buy", " Électronique ", 5000, "Müller & Söhne", {"color": "rouge", "sizes": [3, 1], "ok": True}), ("recurring", "", 0, "", {}), (None, None, None, None, None), ("gift", "漢字", 7, "😀", {"z": {"y": None, "x": "é"}, "a": []})]
    known = {"Buy": "purchase", "recurring": "subscription"}
    rows = spark.createDataFrame([(i, *c[:4], json.dumps(c[4]) if c[4] is not None else None) for i, c in enumerate(cases)], "i int, purpose string, category string, cap long, merchant string, more string")
    got = {r["i"]: r["d"] for r in rows.select("i", intent.envelope_digest(F.col("purpose"), F.col("category"), F.col("cap"), F.col("merchant"), F.parse_json("more")).alias("d")).collect()}
    for i, (purpose, category, cap, merchant, more) in enumerate(cases):
        whole = {"purpose": known.get(purpose, ""), "category": (category or "").strip().lower(), "max_amount_paise": cap or 0, "merchant_preference": (merchant or "").strip().lower(), "constraints": more or {}}
        assert got[i] == hashlib.sha256(json.dumps(whole, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_arrays_of_many_cells_take_little_time(spark):
    """A cell is put in its place, not looked up among all others."""
    rows = spark.range(800_000).selectExpr("concat('t', id % 4000) token_id", "concat('v', id div 4000) value")
    start = time.perf_counter()
    got = sketches.frequencies(rows, "token_id", "value").agg(F.count(F.lit(1)), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), F.min(F.size("counts"))).first()
    assert tuple(got) == (4000, 4 * 800_000, 1024)
    assert time.perf_counter() - start < 25
