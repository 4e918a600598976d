import random

import pytest
from pyspark.sql import functions as F

from lienwise.operators import graph
from lienwise.sources.keyed import KeyedTable
from lienwise.streaming.union import Union


class Crash(Exception):
    pass


def batches(seed, n=12, keys=40):
    rng = random.Random(seed)
    return [{f"k{rng.randrange(keys)}": rng.randrange(1000) for _ in range(rng.randrange(1, 25))} for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "key string, v long")


def held(df):
    return {} if df is None else {r["key"]: r["v"] for r in df.collect()}


def test_last_write_counts_and_old_versions_stay(spark, tmp_path):
    table, want, past = KeyedTable(spark, str(tmp_path / "t"), ["key"], buckets=4, runs=3), {}, []
    assert table.read() is None and table.lookup(frame(spark, {"k1": 0})) is None
    for version, rows in enumerate(batches(1, n=9)):
        gone = [k for k in sorted(want) if k not in rows][:2] if version % 3 == 2 else []
        table.upsert(frame(spark, rows), version, spark.createDataFrame([(k,) for k in gone], "key string") if gone else None)
        want = {k: v for k, v in (want | rows).items() if k not in gone}
        past.append(want)
        assert max(len(runs) for runs in table.manifest(version).values()) <= 3
    assert held(table.read()) == want
    assert held(table.read(version=4)) == past[4]
    some = dict.fromkeys([*list(want)[:5], "none"], 0)
    assert held(table.lookup(frame(spark, some))) == {k: v for k, v in want.items() if k in some}
    assert table.vacuum(keep=len(past) - 1) > 0
    assert held(table.read()) == want and len(table.versions()) == 1
    named = {r for runs in table.manifest(len(past) - 1).values() for r in runs}
    assert set(table._names("runs")) == named


@pytest.mark.parametrize("step", ["data", "merge", "manifest", "marker"])
def test_a_crash_at_any_step_and_a_repeat_give_one_result(spark, tmp_path, monkeypatch, step):
    table, want = KeyedTable(spark, str(tmp_path / "t"), ["key"], buckets=2, runs=2), {}
    for version, rows in enumerate(batches(2, n=5)):
        want |= rows
        if version in (2, 3):
            write, manifest = KeyedTable._write, KeyedTable.manifest

            def broken(self, rows, run):
                if step == "data" or step == "merge" and run.endswith("-merged"):
                    raise Crash
                write(self, rows, run)
                if step == "manifest" and not run.endswith("-merged"):
                    raise Crash

            with monkeypatch.context() as m:
                m.setattr(KeyedTable, "_write", broken)
                if step == "marker":  # the manifest's files are there, its marker isn't
                    table.upsert(frame(spark, rows), version)
                    table._fs.delete(table._place(f"{table.path}/manifest/{version}/_SUCCESS"), False)
                else:
                    with pytest.raises(Crash):
                        table.upsert(frame(spark, rows), version)
                        raise Crash  # no bucket was merged in this batch
            assert held(table.read(version - 1)) == {k: v for b in batches(2, n=5)[:version] for k, v in b.items()}
            if step not in ("merge",):
                assert version not in table.versions()
        table.upsert(frame(spark, rows), version)
        table.upsert(frame(spark, {"k0": -1}), version)  # a repeat of a committed batch
    assert held(table.read()) == want
    table.vacuum(keep=4)
    assert held(table.read()) == want


def graph_batches(seed):
    rng, out = random.Random(seed), []
    for _ in range(3):
        out.append([tuple(sorted((f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}"))) for _ in range(rng.randrange(4, 12))])
    out.append([(f"n{i:02}", f"n{i + 1:02}") for i in range(0, 58, 2)])
    out.append([("a", "n59"), ("b", "c")])
    return [[(a, b) for a, b in rows if a != b] for rows in out]


def test_components_after_each_batch_equal_those_of_the_whole_graph(spark, tmp_path):
    union, seen = Union(spark, str(tmp_path / "u"), buckets=2), []
    for version, rows in enumerate(graph_batches(5)):
        seen += rows
        union.add(spark.createDataFrame(rows, "a string, b string"), version)
        if version in (2, 4):
            want = graph.components(spark.createDataFrame(seen, "a string, b string").distinct())
            assert sorted(map(tuple, union.components().collect())) == sorted(map(tuple, want.collect()))
    union.add(spark.createDataFrame([("a", "b")], "a string, b string"), 4)  # a repeat of a batch that is done
    assert sorted(map(tuple, union.components().collect())) == sorted(map(tuple, want.collect()))


def test_a_batch_writes_only_what_it_touches(spark, tmp_path):
    union = Union(spark, str(tmp_path / "u"), buckets=2)
    union.add(spark.createDataFrame([(f"x{i}", f"x{i + 1}") for i in range(40)], "a string, b string"), 0)
    union.add(spark.createDataFrame([("p", "q")], "a string, b string"), 1)
    union.add(spark.createDataFrame([("a", "x7"), ("q", "x7")], "a string, b string"), 2)
    changed = {name: sum(spark.read.parquet(f"{t.path}/runs/{r}").count() for r in t._names("runs") if r.startswith("2-")) for name, t in (("nodes", union.nodes), ("pointers", union.pointers), ("sizes", union.sizes))}
    assert changed == {"nodes": 1, "pointers": 2, "sizes": 3}  # a; p and x0 point at a; a has a size, p and x0 no more
    assert {(r["component"], r["size"]) for r in union.components().collect()} == {("a", 44)}
