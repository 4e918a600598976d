import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lienwise.llm import prefixes as X

SMALL = {"hot": 8, "cuts": 5, "least": 10}  # cuts keys of small tables
SCHEMA = "conv_id long, turn long, role string, text string, place string, owner int"


def rows(seed=1):
    """Copies, shared openings, a very long conversation, nulls, ties, negative
    and turnless ones, repeated rows."""
    rng, out = random.Random(seed), []
    openings = [("user", "hi"), ("user", "hi there"), ("assistant", "hi"), ("user", ""), (None, None)]
    for c in [*range(100, 400, 3), -205, -200, 200, 100, 7]:
        for turn in range(rng.choice([1, 1, 2, 4, 8])):
            role, text = rng.choice(openings) if rng.random() < 0.8 else ("user", f"é{rng.randrange(10**6)}")
            out.append((c, rng.choice([turn, turn, None, 3]), role, text, "x", 1))
    for c in range(500, 560):
        out += [(c, t, "user", "same", "x", 1) for t in range(6)]
    out += [(600, t, "user", f"t{t % 9}", "x", 1) for t in range(150)]
    return out + out[:5] + [(None, 1, "user", "lost", "x", 1)]


def brute(table):
    own = {}
    for c, turn, role, text, *_ in table:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(rs)] for c, rs in own.items()}
    built = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c > 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in below) if len(below) < 200 else None
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        children = sum(len(p) == len(path) + 1 for p in below)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(path))))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0], r[7]))


def result(df, dealing, hot):
    c = F.col("conv_id")
    turns, convs = X.rebuilt(X.ordered(df, **dealing), c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5)
    nodes, ends = X.trie(turns, convs, hot, **dealing)
    out = nodes.join(X.end_digests(ends, **dealing), X.KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in out.collect()), key=lambda r: (r[1], r[0], r[7]))


@pytest.mark.parametrize(("dealing", "hot"), [({}, X.COMMON), (SMALL, 10)])
def test_equals_brute_force(spark, dealing, hot):
    table = rows()
    want = brute(table)
    got = result(spark.createDataFrame(table, SCHEMA).repartition(5), dealing, hot)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] + g[6:] == w[:5] + w[6:]
        assert w[5] is None or g[5] == w[5]


def test_only_turnless_conversations(spark):
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 1)  # its one turn goes, conversation 0 is absent
    got = result(spark.createDataFrame([(c, 0, "user", "x", "", 0)], SCHEMA), {}, X.COMMON)
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA), {}, X.COMMON) == []
