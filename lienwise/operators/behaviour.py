"""Behavioural baselines per principal, folded in arrival order.

Moving averages, places and gaps are scans (``amounts``, ``gaps``, ``novelty``) in
which a principal of very many events is shared among tasks. The five-marker
quantile can't be put together from parts: ``signals`` folds it, with all else,
over sorted partitions and carries one principal's state from batch to batch.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import DEFAULT, Params
from ..storage import settled
from . import scan


class MarkerQuantile:
    """The P-square estimate (Jain and Chlamtac 1985) of one quantile."""

    __slots__ = ("first", "height", "place", "q", "share", "wish")

    def __init__(self, q: float) -> None:
        self.q, self.first, self.height, self.place = q, [], None, None
        self.share = (0.0, q / 2, q, (1 + q) / 2, 1.0)
        self.wish = [2 * q, 4 * q, 2 + 2 * q]

    def estimate(self) -> float:
        if self.height is not None:
            return self.height[2]
        return sorted(self.first)[min(len(self.first) - 1, int(self.q * len(self.first)))] if self.first else 0.0

    def push(self, x: float) -> None:
        if self.height is None:
            self.first.append(x)
            if len(self.first) == 5:
                self.height, self.place = sorted(self.first), [0, 1, 2, 3, 4]
            return
        h, at = self.height, self.place
        h[0], h[4] = min(h[0], x), max(h[4], x)
        cell = next((i for i in range(3) if x < h[i + 1]), 3)
        for i in range(cell + 1, 5):
            at[i] += 1
        for i in (1, 2, 3):
            self.wish[i - 1] += self.share[i]
            lag = self.wish[i - 1] - at[i]
            before, after = at[i] - at[i - 1], at[i + 1] - at[i]
            move = 1 if lag >= 1 and after > 1 else -1 if lag <= -1 and before > 1 else 0
            if not move:
                continue
            rise, fall = (h[i + 1] - h[i]) / after, (h[i] - h[i - 1]) / before
            curve = h[i] + move / (before + after) * ((before + move) * rise + (after - move) * fall)
            h[i] = curve if h[i - 1] < curve < h[i + 1] else h[i] + (rise if move > 0 else -fall)
            at[i] += move


class Baseline:
    """What is known of one principal; ``observe`` judges an event against the
    past and then learns it."""

    def __init__(self, p: Params) -> None:
        self.p, self.n, self.mean, self.mad = p, 0, 0.0, 0.0
        self.p95 = MarkerQuantile(0.95)
        self.last, self.gaps, self.gap = 0, 0, 0.0
        self.merchants: Counter = Counter()
        self.visits = 0

    def observe(self, amount: float, merchant: str, ts: int) -> tuple:
        p = self.p
        z = over = speed = novelty = 0.0
        n_amount, n_gap, n_merchant = self.n, self.gaps, self.visits
        if amount > 0:
            if self.n:
                z = abs(amount - self.mean) / (p.mad_to_sigma * self.mad + p.epsilon)
            usual = self.p95.estimate()
            over = max(0.0, (amount - usual) / (abs(usual) + p.epsilon))
            if self.n:
                off = amount - self.mean
                self.mean += p.ewma_alpha * off
                self.mad += p.ewma_alpha * (abs(off) - self.mad)
            else:
                self.mean = amount
            self.n += 1
            self.p95.push(amount)
        if ts:
            gap = max(0, ts - self.last)
            if self.last and self.gaps and self.gap > 0:
                speed = max(0.0, (self.gap - gap) / (self.gap + p.epsilon))
            if self.last:
                self.gap = self.gap + p.ewma_alpha * (gap - self.gap) if self.gaps else float(gap)
                self.gaps += 1
            self.last = ts
        if merchant:
            novelty = max(0.0, 1 - self.merchants[merchant] / (self.visits + 1))
            self.merchants[merchant] += 1
            self.visits += 1
        return z, over, speed, novelty, n_amount, n_gap, n_merchant, self.mean, self.mad, self.p95.estimate(), self.n, len(self.merchants)


SIGNALS = "principal string, seq long, z double, over_p95 double, speed double, novelty double, n_amount long, n_gap long, n_merchant long, ewma_mean double, ewma_mad double, p95 double, n_after long, merchants long"


def signals(log: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Raw signals of every observation. ``log``: principal, seq,
    amount_paise, merchant_id, occurred_at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, state = None, None
        for b in batches:
            rows = []
            for principal, seq, amount, merchant, ts in b.itertuples(index=False):
                if principal != who:
                    who, state = principal, Baseline(p)
                rows.append((principal, seq, *state.observe(float(amount or 0), merchant or "", int(ts or 0))))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SIGNALS.split(", ")])

    rows = log.where(F.coalesce("principal", F.lit("")) != "").select("principal", "seq", F.coalesce("amount_paise", F.lit(0)).alias("amount_paise"), "merchant_id", F.coalesce("occurred_at", F.lit(0)).alias("occurred_at"))
    return rows.repartition("principal").sortWithinPartitions("principal", "seq").mapInPandas(run, SIGNALS)


def deviations(found: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Signals squashed to [0, 1), shrunk by their support, and their noisy-OR."""
    squashed = found.select(
        "*",
        S.squash(F.col("z"), p.z_scale).alias("d_z"),
        S.squash(F.col("over_p95"), p.p95_scale).alias("d_p95"),
        S.squash(F.col("speed"), p.velocity_scale).alias("d_velocity"),
        F.col("novelty").alias("d_novelty"),
    )
    parts = [S.shrink(F.col(d), F.col(n), p) for d, n in (("d_z", "n_amount"), ("d_p95", "n_amount"), ("d_velocity", "n_gap"), ("d_novelty", "n_merchant"))]
    return squashed.withColumn("deviation", S.noisy_or(*parts)).withColumn("vector", F.array(*parts, F.log1p("n_after"), F.log1p("merchants")))


def novelty(log: DataFrame, **dealing) -> DataFrame:
    """Merchant novelty: exact counts before each event, by places in the order
    of the principal and of the principal at that merchant. Principals and pairs
    with a large share of all events are numbered in ranges."""
    rows = scan.numbered(log, ["principal"], "seq", **dealing).withColumnRenamed("_n", "_all")
    rows = scan.numbered(settled(rows, "novelty"), ["principal", "merchant_id"], "seq", **dealing)
    return rows.withColumn("novelty", F.greatest(F.lit(0.0), 1 - F.col("_n") / (F.col("_all") + 1))).drop("_n", "_all")


def amounts(log: DataFrame, p: Params = DEFAULT, block: int | None = None, **dealing) -> DataFrame:
    """Each event of a positive amount with z, its distance from the moving mean
    before it in moving deviations (0 for a principal's first), n_amount, the
    amounts before it, and the ewma_mean and ewma_mad after it.

    Two affine scans: the deviation is one over the distances that the first
    gives. Amounts are taken relative to the principal's first one, so that a
    constant amount has exactly no deviation."""
    rows = log.where(F.col("amount_paise") > 0).withColumn("_x", F.col("amount_paise").cast("double"))
    rows = settled(scan.numbered(rows, ["principal"], "seq", first={"_x0": F.col("_x")}, **dealing), "amounts")
    rows = scan.decayed(rows, ["principal"], p.ewma_alpha * (F.col("_x") - F.col("_x0")), 1 - p.ewma_alpha, "_mean", "_mean_before", block)
    rows = rows.withColumn("_off", F.abs(F.col("_x") - F.col("_x0") - F.col("_mean_before")))
    rows = scan.decayed(rows, ["principal"], p.ewma_alpha * F.col("_off"), 1 - p.ewma_alpha, "ewma_mad", "_mad_before", block)
    z = F.when(F.col("_n") > 0, F.col("_off") / (p.mad_to_sigma * F.col("_mad_before") + p.epsilon)).otherwise(0.0)
    out = rows.withColumn("z", z).withColumn("ewma_mean", F.col("_mean") + F.col("_x0")).withColumnRenamed("_n", "n_amount")
    return out.drop("_x", "_x0", "_mean", "_mean_before", "_off", "_mad_before")


def ewma(log: DataFrame, p: Params = DEFAULT, block: int | None = None, **dealing) -> DataFrame:
    """(principal, ewma_mean, ewma_mad) after the last positive amount."""
    last = amounts(log, p, block, **dealing).groupBy("principal").agg(F.max_by(F.struct("ewma_mean", "ewma_mad"), "seq").alias("s"))
    return last.select("principal", "s.*")


def gaps(log: DataFrame, p: Params = DEFAULT, block: int | None = None, **dealing) -> DataFrame:
    """Each event with a time, with speed, by how much its gap is shorter than
    the moving mean of the gaps before, n_gap, the gaps before it, and d_velocity,
    the speed squashed. The first event has no gap, the second no mean."""
    rows = log.where(F.col("occurred_at") != 0)
    rows = settled(scan.numbered(rows, ["principal"], "seq", **dealing), "gaps")
    rows = scan.previous(rows, ["principal"], {"_last": "occurred_at"})
    rows = rows.where("_n > 0").withColumn("_gap", F.greatest(F.lit(0), F.col("occurred_at") - F.col("_last")).cast("double"))
    rows = settled(rows.withColumn("_n", F.col("_n") - 1).drop("_last"), "gaps")
    x = F.when(F.col("_n") == 0, F.col("_gap")).otherwise(p.ewma_alpha * F.col("_gap"))
    rows = scan.decayed(rows, ["principal"], x, 1 - p.ewma_alpha, "ewma_gap", "_before", block)
    speed = F.when((F.col("_n") > 0) & (F.col("_before") > 0), F.greatest(F.lit(0.0), (F.col("_before") - F.col("_gap")) / (F.col("_before") + p.epsilon))).otherwise(0.0)
    return rows.withColumn("speed", speed).withColumn("d_velocity", S.squash(F.col("speed"), p.velocity_scale)).withColumnRenamed("_n", "n_gap").drop("_gap", "_before")
