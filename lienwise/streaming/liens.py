"""The lien of each token as events arrive: spent amounts and spent nonces.

The state store must be the RocksDB one (``spark.sql.streaming.stateStore.
providerClass``): a token's spent nonces are entries of a map state, which are
looked up one by one and never loaded or written back whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import blockstate
from ..params import DEFAULT, Params

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "token_id string, seq long, consumed_today long, consumed_total long, last_computed_at long, captured boolean, nonce string"


class _Lien(StatefulProcessor):
    def __init__(self, day_seconds: int) -> None:
        self.day = day_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "today long, total long, last long")
        self.nonces = handle.getMapState("nonces", "nonce string", "seq long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            if not pd.isna(row.consumed_total):
                self.spent.update((int(row.consumed_today), int(row.consumed_total), int(row.last_computed_at)))
            if row.nonce:
                self.nonces.updateValue((row.nonce,), (int(row.first_seq),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values("seq", kind="stable")
        today, total, last = self.spent.get() if self.spent.exists() else (0, 0, 0)
        amount = np.where(rows["captured"], rows["amount_paise"], 0).astype(np.int64)
        at = np.where(rows["captured"], rows["occurred_at"], 0).astype(np.int64)
        # the last capture before each row, and the sums since its day began
        place = np.maximum.accumulate(np.where(rows["captured"], np.arange(len(rows)), -1))
        when = np.where(place >= 0, at[place], last)
        before = np.concatenate([[last], when[:-1]])
        fresh = rows["captured"].to_numpy() & ((before == 0) | (before // self.day != at // self.day))
        sums = np.concatenate([[0], np.cumsum(amount)])
        began = np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), -1))
        out = pd.DataFrame({"token_id": key[0], "seq": rows["seq"].to_numpy(), "consumed_today": np.where(began >= 0, sums[1:] - sums[began], sums[1:] + today), "consumed_total": sums[1:] + total, "last_computed_at": when, "captured": rows["captured"].to_numpy()})
        if place[-1] >= 0:
            self.spent.update((int(out["consumed_today"].iloc[-1]), int(out["consumed_total"].iloc[-1]), int(when[-1])))
        # each call of the state is a trip to the JVM: one for each different nonce, none to ask an empty map
        new, some = np.full(len(rows), None, object), self.nonces.exists()
        for i in np.flatnonzero((rows["nonce"] != "") & ~rows["nonce"].duplicated()):
            nonce = rows["nonce"].iloc[i]
            if not (some and self.nonces.containsKey((nonce,))):
                self.nonces.updateValue((nonce,), (int(rows["seq"].iloc[i]),))
                new[i] = nonce
        yield out.assign(nonce=new)

    def close(self) -> None:
        pass


def lien_states(stream: DataFrame, snapshot: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """``(token_id, seq, consumed_today, consumed_total, last_computed_at,
    captured, nonce)`` after each capture and each allowed decision of a
    deduplicated log: captures of a positive amount move the sums, which start
    anew on another day than the capture before; both spend their nonce, which
    stands in the row of its first use and is null elsewhere.

    ``snapshot`` (see there) is the state to start from, for example that of a
    batch over all that came before the stream. Rows of one micro-batch are taken
    in order of seq; null and empty tokens are left out."""
    allowed = (F.col("type") == "decision.made") & (F.col("decision") == "ALLOW")
    captured = (F.col("type") == "payment.captured") & (F.col("amount_paise") > 0)
    kept = stream.where((F.coalesce("token_id", F.lit("")) != "") & (allowed | captured))
    rows = kept.select("token_id", "seq", F.coalesce(captured, F.lit(False)).alias("captured"), F.coalesce("amount_paise", F.lit(0)).cast("long").alias("amount_paise"), F.coalesce("occurred_at", F.lit(0)).cast("long").alias("occurred_at"), F.coalesce("nonce", F.lit("")).alias("nonce"))
    if snapshot is not None and not stream.isStreaming:  # in a batch no later rows can ask for the state of other tokens
        snapshot = snapshot.join(rows.select("token_id").distinct(), "token_id", "left_semi")
    start = snapshot.groupBy("token_id") if snapshot is not None else None
    return rows.groupBy("token_id").transformWithStateInPandas(_Lien(p.day_seconds), OUT, "Append", "None", start)


def snapshot(log: DataFrame) -> DataFrame:
    """The state after a deduplicated batch, for a stream to go on from: a row
    of sums for each token and a row for each spent nonce."""
    sums = blockstate.block_state(log).select("token_id", "consumed_today", "consumed_total", "last_computed_at", F.lit("").alias("nonce"), F.lit(0).cast("long").alias("first_seq"))
    none = F.lit(None).cast("long")
    spent = blockstate.spent_nonces(log).select("token_id", none.alias("consumed_today"), none.alias("consumed_total"), none.alias("last_computed_at"), "nonce", F.col("first_seq").cast("long"))
    return sums.select(*[F.col(c).cast(t) for c, t in zip(sums.columns, ("string", "long", "long", "long", "string", "long"))]).unionByName(spent)


def current(start: DataFrame, later: DataFrame) -> DataFrame:
    """The state, as ``snapshot`` gives it, after the rows that ``lien_states``
    gave from ``start`` on."""
    moved = later.where("consumed_total > 0").groupBy("token_id").agg(F.max_by(F.struct("consumed_today", "consumed_total", "last_computed_at"), "seq").alias("s"))
    moved = moved.select("token_id", "s.*", F.lit("").alias("nonce"), F.lit(0).cast("long").alias("first_seq"))
    held = start.join(moved.select("token_id"), "token_id", "left_anti").where("nonce = ''").unionByName(start.where("nonce <> ''"))
    none = F.lit(None).cast("long")
    spent = later.where("nonce is not null").select("token_id", none.alias("consumed_today"), none.alias("consumed_total"), none.alias("last_computed_at"), "nonce", F.col("seq").alias("first_seq"))
    return held.unionByName(moved).unionByName(spent)
