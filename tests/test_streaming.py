import pandas as pd
import pytest
from pyspark.sql import functions as F

from lienwise.operators import behaviour, blockstate, features, graph, intent, labels, reputation
from lienwise.operators import log as L
from lienwise.sources import connectors
from lienwise.sources.keyed import KeyedTable
from lienwise.streaming import folds, liens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The log in three files, in order of arrival."""
    from lienwise.sources import testdata as T

    base = tmp_path_factory.mktemp("stream")
    log = T.bus(spark, SF).cache()
    for i in range(3):
        log.where(F.floor(F.col("seq") / 334) == i).coalesce(1).write.mode("append").parquet(str(base / "log"))
    return log, str(base)


def run(spark, stream, name, base, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{base}/c-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_folds_equal_batch(spark, parts):
    log, base = parts
    stream = connectors.read_stream(spark, f"{base}/log", log.schema)
    rows = lambda df, c: sorted(tuple(r[x] for x in c) for r in df.select(*c).collect())
    cols = ("event_id", "token_id", "value", "weight", "reason")
    assert rows(run(spark, folds.label_events(stream), "labels", base), cols) == rows(labels.labels(log), cols)
    cols = ("agent_id", "reputation")
    assert rows(run(spark, folds.reputations(stream), "reps", base, "complete"), cols) == rows(reputation.reputation(log), cols)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, liens.PROVIDER)
    yield
    spark.conf.set(name, before)


def lien_rows(df):
    """Sums after each capture, and each nonce with its first use."""
    got = df.collect()
    sums = sorted((r["token_id"], r["seq"], r["consumed_today"], r["consumed_total"]) for r in got if r["captured"])
    return sums, sorted((r["token_id"], r["nonce"], r["seq"]) for r in got if r["nonce"])


def test_liens_equal_batch_and_go_on_from_a_snapshot(spark, parts, rocks):
    log, base = parts
    sums = sorted(map(tuple, blockstate.running_consumption(log).select("token_id", "seq", "consumed_today", "consumed_total").collect()))
    spent = sorted(map(tuple, blockstate.spent_nonces(log).select("token_id", "nonce", "first_seq").collect()))
    allowed = log.where("type = 'decision.made' and decision = 'ALLOW'").select("token_id", "nonce").distinct()
    assert spent and allowed.count()
    assert lien_rows(run(spark, liens.lien_states(connectors.read_stream(spark, f"{base}/log", log.schema)), "liens", base)) == (sums, spent)
    # the first half as a batch, the second as a stream
    half = 500
    log.where(F.col("seq") >= half).coalesce(1).write.parquet(f"{base}/rest")
    start = liens.snapshot(log.where(F.col("seq") < half))
    got = lien_rows(run(spark, liens.lien_states(connectors.read_stream(spark, f"{base}/rest", log.schema), start), "liens_rest", base))
    assert got == ([r for r in sums if r[1] >= half], [r for r in spent if r[2] >= half])


def test_a_replayed_nonce_and_a_new_day(spark, tmp_path, rocks):
    day, schema = 86_400, "seq long, type string, token_id string, decision string, nonce string, amount_paise long, occurred_at long"
    events = [
        (1, "decision.made", "t", "ALLOW", "n1", None, 10),
        (2, "decision.made", "t", "STEP_UP", "n2", None, 11),
        (3, "payment.captured", "t", None, "n1", 5, 12),
        (4, "payment.captured", "t", None, "n2", 7, day - 1),
        (5, "payment.captured", "t", None, "n2", 1, day),
        (6, "payment.captured", "t", None, None, -4, day),
        (7, "payment.captured", None, None, "n9", 4, day),
        (8, "decision.made", "u", "ALLOW", "", None, 10),
    ]
    for i, part in enumerate((events[:3], events[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    got = run(spark, liens.lien_states(connectors.read_stream(spark, str(tmp_path / "log"), spark.createDataFrame([], schema).schema)), "liens_few", str(tmp_path))
    assert sorted((r["seq"], r["consumed_today"], r["consumed_total"], r["nonce"]) for r in got.collect()) == [(1, 0, 0, "n1"), (3, 5, 5, None), (4, 12, 12, "n2"), (5, 1, 13, None), (8, 0, 0, None)]


def test_dedupe_and_feature_sink(spark, parts):
    log, base = parts
    dup = log.unionByName(log.where("k % 7 = 0").withColumn("seq", F.col("seq") + 1_000_000))
    dup.coalesce(1).write.parquet(f"{base}/dup")
    stream = folds.deduplicated(connectors.read_stream(spark, f"{base}/dup", dup.schema))
    assert run(spark, stream, "once", base).count() == L.dedupe(dup).count() == log.count()

    dep = log.select("seq", "event_id", F.col("token_id").alias("key"), "occurred_at", *[F.when(F.col("k") % 5 == i, F.col("k") / 100).alias(c) for i, c in enumerate(features.FIGURES)])
    for i in range(3):
        dep.where(F.floor(F.col("seq") / 334) == i).coalesce(1).write.mode("append").parquet(f"{base}/dep")
    q = connectors.read_stream(spark, f"{base}/dep", dep.schema).writeStream.foreachBatch(folds.merged_features(f"{base}/table")).option("checkpointLocation", f"{base}/c-dep").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in folds.current_features(spark, f"{base}/table", q.lastProgress["batchId"]).collect()}
    assert got == {tuple(r) for r in features.merge_deposits(dep).collect()}


def test_engines_equal_batch(spark, parts):
    log, base = parts
    stream = connectors.read_stream(spark, f"{base}/log", log.schema)
    who = lambda df: df.where("type in ('decision.made', 'payment.captured')").withColumn("principal", F.col("token_id"))
    got = run(spark, folds.behaviour_deposits(who(stream)), "behaviour", base)
    want = behaviour.deviations(behaviour.signals(who(log)))
    rows = lambda df, *c: sorted((r[0], r[1], round(r[2], 9)) for r in df.select(*c).collect())
    assert rows(got, "seq", "key", "behaviour_deviation") == rows(want, "seq", "principal", "deviation")
    sealed = lambda df: df.withColumn("sealed", F.col("type").startswith("token")).withColumn("session_id", F.col("token_id")).withColumn("device", F.when(F.col("k") % 3 != 0, F.col("device_id")))
    got = run(spark, folds.latest_envelopes(sealed(stream), ["k", "device"]), "intent", base)
    want = intent.latest_envelope(sealed(log), ["k", "device"])
    rows = lambda df: sorted(map(repr, df.select("seq", "env_k", "env_device").collect()))
    assert rows(got) == rows(want)


def test_graph_ticks_equal_batch(spark, parts):
    log, base = parts
    late = log.withColumn("occurred_at", F.when(F.col("seq") % 5 == 0, F.col("occurred_at") - 10**6).otherwise(F.col("occurred_at")))  # the last arrival is not the latest time
    for i in range(2):
        late.where(F.floor(F.col("seq") / 334) == i).coalesce(1).write.mode("append").parquet(f"{base}/late")
    q = connectors.read_stream(spark, f"{base}/late", late.schema).writeStream.foreachBatch(folds.graph_ticks(spark, f"{base}/graph", every=500, buckets=2)).option("checkpointLocation", f"{base}/c-graph").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.parquet(f"{base}/graph/deposits")
    assert {r["batch"] for r in found.select("batch").distinct().collect()} == {1}  # 334 events a batch: the second one ticks
    seen = late.where("seq < 668")
    want = graph.network_risk(graph.edges(seen), graph.dispute_seeds(seen))
    rows = lambda df, c: {r["key"]: round(r[c], 7) for r in df.collect()}
    assert rows(found, "network_risk") == rows(want, "risk")
    held = KeyedTable(spark, f"{base}/graph/edges", ["a", "b"], 2).read()
    assert sorted(map(tuple, held.select("a", "b", "ts").collect())) == sorted(map(tuple, graph.edges(seen).collect()))


def test_keyed_sinks_hold_the_last_row(spark, parts):
    log, base = parts
    rows = log.select("seq", F.col("token_id").alias("token"), "type", "k")
    table = KeyedTable(spark, f"{base}/overlay", ["token"], 2)
    for i in range(2):
        rows.where(F.col("seq") % 2 == i).coalesce(1).write.mode("append").parquet(f"{base}/overlays")
    q = connectors.read_stream(spark, f"{base}/overlays", rows.schema).writeStream.foreachBatch(folds.last_rows(table)).option("checkpointLocation", f"{base}/c-overlay").trigger(availableNow=True).start()
    q.awaitTermination()
    second = rows.where("seq % 2 = 1").unionByName(rows.join(rows.where("seq % 2 = 1").select("token"), "token", "left_anti"))
    want = second.groupBy("token").agg(F.max_by(F.struct("seq", "type", "k"), "seq").alias("r")).select("token", "r.*")
    assert sorted(map(tuple, table.read().select("token", "seq", "type", "k").collect())) == sorted(map(tuple, want.collect()))


def test_a_fold_asks_its_state_once_for_each_different_nonce():
    calls = []

    class Held(dict):
        def exists(self):
            return bool(self)

        def get(self):
            return self[0]

        def update(self, value):
            self[0] = value

        def containsKey(self, key):  # noqa: N802
            calls.append(key)
            return key in self

        def updateValue(self, key, value):  # noqa: N802
            calls.append(key)
            self[key] = value

    fold = liens._Lien(86_400)
    fold.spent, fold.nonces = Held(), Held()
    rows = pd.DataFrame({"seq": range(60, 0, -1), "captured": True, "amount_paise": 5, "occurred_at": 1_000_000, "nonce": ["a", "b", ""] * 20})
    first = pd.concat(fold.handleInputRows(("t",), iter([rows]), None))
    assert [(r.seq, r.nonce) for r in first.itertuples() if r.nonce] == [(2, "b"), (3, "a")] and len(calls) == 2
    assert fold.nonces == {("a",): (3,), ("b",): (2,)} and first["consumed_total"].iloc[-1] == 300
    second = pd.concat(fold.handleInputRows(("t",), iter([rows.assign(seq=rows["seq"] + 60, nonce=["a", "c", "c"] * 20)]), None))
    assert [(r.seq, r.nonce) for r in second.itertuples() if r.nonce] == [(61, "c")] and len(calls) == 5
