"""Running quantiles with a bounded relative error, in parallel.

Amounts fall into bins whose edges grow by a constant factor, so counts by bin
are a sketch that merges by addition and any value of a bin is within ``error``
of the bin's middle. A principal's events are cut into blocks of consecutive
events; the counts before a block are prefix sums over the blocks' sketches, and
each block is finished alone with those. No task holds more than a block and
one sketch of a principal, whatever its share of all events.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import DEFAULT, Params
from ..storage import settled
from . import scan

#: Relative error, consecutive events of a block, cells of a working matrix, shares of a principal in the join of its last block.
ERROR, BLOCK, CELLS, SALT = 0.005, 4096, 1 << 21, 64


def _growth(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("the relative error is between 0 and 1")
    return (1 + error) / (1 - error)


def bin_of(x: Column, error: float = ERROR) -> Column:
    """The number of the bin of a positive value."""
    return F.ceil(F.log(x) / math.log(_growth(error))).cast("int")


def middle_of(at: Column, error: float = ERROR) -> Column:
    """A value within ``error`` of all values of a bin."""
    g = _growth(error)
    return 2 * F.pow(F.lit(g), at) / (g + 1)


def _before(counts: DataFrame) -> DataFrame:
    """``(principal, _block, _bin, _c)``: how many values of a bin come before a
    block, from counts by block. A count holds until the block where the bin has
    values again, so a principal's bins are summed by different tasks."""
    last = counts.groupBy("principal").agg(F.max("_block").alias("_last")).where("_last > 0")
    last = last.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    held = counts.withColumn("_s", F.pmod("_bin", F.lit(SALT))).join(last, ["principal", "_s"])
    w = Window.partitionBy("principal", "_bin").orderBy("_block")
    held = held.withColumn("_sum", F.sum("_c").over(w)).withColumn("_until", F.coalesce(F.lead("_block").over(w), "_last"))
    reach = F.when(F.col("_until") > F.col("_block"), F.sequence(F.col("_block") + 1, F.col("_until")))
    return held.select("principal", F.explode(reach).alias("_block"), "_bin", F.col("_sum").alias("_c"))


def _prior(q: float, bins: np.ndarray, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bin of the quantile before each event of a block. First come the bins
    with counts from before the block (n = -1), then its events in their order."""
    cut = int(np.searchsorted(n, 0))
    names, at = np.unique(bins, return_inverse=True)
    base = np.zeros(len(names), np.int64)
    base[at[:cut]] = counts[:cut]
    at, n = at[cut:], n[cut:]
    place = np.minimum(n - 1, np.floor(q * n).astype(np.int64))
    found, step = np.zeros(len(n), np.int64), max(1, CELLS // len(names))
    for a in range(0, len(n), step):
        z = min(a + step, len(n))
        seen = np.zeros((z - a + 1, len(names)), np.int64)
        seen[0] = base
        seen[np.arange(1, z - a + 1), at[a:z]] = 1
        seen = np.cumsum(seen, axis=0)
        base = seen[-1]
        found[a:z] = np.argmax(np.cumsum(seen[:-1], axis=1) > place[a:z, None], axis=1)
    return names[found]


def _finished(q: float):
    """Sorted rows of blocks to events; the last block of a batch waits for the next one."""

    def ended(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        n, bins, counts = (rows[c].to_numpy(np.int64) for c in ("_n", "_bin", "_c"))
        own = n >= 0
        prior = [_prior(q, bins[a:z], counts[a:z], n[a:z]) for a, z in zip(starts, [*starts[1:], len(rows)], strict=True)]
        out = rows.loc[own, ["principal", "seq", "amount_paise"]].assign(n_amount=n[own], _prior=np.concatenate(prior))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            rows = b if held is None else pd.concat([held, b], ignore_index=True)
            who, block = rows["principal"].to_numpy(object), rows["_block"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (block[1:] != block[:-1])])) if len(rows) else np.zeros(0, int)
            if len(starts) > 1:
                yield ended(rows.iloc[: starts[-1]], starts[:-1])
                rows = rows.iloc[starts[-1] :].reset_index(drop=True)
            held = rows
        if held is not None and len(held):
            yield ended(held, np.zeros(1, int))

    return run


def running(log: DataFrame, q: float = 0.95, error: float = ERROR, block: int = BLOCK, p: Params = DEFAULT, **dealing) -> DataFrame:
    """``(principal, seq, amount_paise, n_amount, usual, over, d_over)`` of each
    event with a principal and a positive amount. ``usual`` is within ``error``
    of the quantile of the n_amount amounts before it: the one at place
    min(n - 1, floor(q * n)) of their order, 0 where there is none. ``over`` is
    by how much of it the amount is above, ``d_over`` that squashed. ``log``:
    principal, seq (unique in a principal), amount_paise; other columns are
    ignored. Events without principal or amount, and empty logs, give no row."""
    if not 0 <= q <= 1 or block < 1:
        raise ValueError("a quantile lies in [0, 1], a block has an event")
    rows = log.where((F.coalesce("principal", F.lit("")) != "") & (F.col("amount_paise") > 0)).select("principal", F.col("seq").cast("long").alias("seq"), F.col("amount_paise").cast("long").alias("amount_paise"))
    rows = scan.numbered(rows, ["principal"], "seq", **dealing)
    rows = settled(rows.withColumn("_block", F.floor(F.col("_n") / block)).withColumn("_bin", bin_of(F.col("amount_paise").cast("double"), error)), "amounts")
    counts = settled(rows.groupBy("principal", "_block", "_bin").agg(F.count(F.lit(1)).alias("_c")), "sketches")
    none = F.lit(0).cast("long")
    both = rows.withColumn("_c", none).unionByName(_before(counts).withColumns({"seq": none, "amount_paise": none, "_n": none - 1}))
    both = both.repartition("principal", "_block").sortWithinPartitions("principal", "_block", "_n")
    out = both.mapInPandas(_finished(q), "principal string, seq long, amount_paise long, n_amount long, _prior long")
    out = out.withColumn("usual", F.when(F.col("n_amount") > 0, middle_of(F.col("_prior"), error)).otherwise(0.0))
    out = out.withColumn("over", F.greatest(F.lit(0.0), (F.col("amount_paise") - F.col("usual")) / (F.col("usual") + p.epsilon)))
    return out.withColumn("d_over", S.squash(F.col("over"), p.p95_scale)).drop("_prior")
