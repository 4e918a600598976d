"""Ordered passes over the rows of a key that no single task has to hold.

Windows put all rows of a key into one task. Here a key with a large share of
all rows is cut at quantiles of its order into ranges, so that windows run over
(key, range), and what stands in earlier ranges is carried in from a table of one
row for each such key and range: at most ``HOT * (CUTS + 1)`` rows, which bounds
its broadcast. All other keys have one range and no carry, so nothing is
shuffled that a plain window would not shuffle.

Decayed sums (moving averages) run over blocks of consecutive rows instead: a
block is as long as it takes for a value's weight to fall under 2**-60, so the
two blocks before say all that double precision can hold.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled

#: A key is cut if it has over one in HOT rows (and over LEAST); into CUTS + 1 ranges.
HOT, CUTS, LEAST = 1024, 255, 256
#: 0 for a key of one range, from 1 on for the ranges of a cut key.
RANGE = "_range"


def _beside(rows: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join by key with a small table, null keys being equal."""
    named = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in table.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(named[f"_k{i}"]) for i, k in enumerate(keys)])
    return rows.join(F.broadcast(named), same, how).drop(*[f"_k{i}" for i in range(len(keys))])


def dealt(rows: DataFrame, keys: list[str], order: str, hot: int = HOT, cuts: int = CUTS, least: int = LEAST) -> DataFrame:
    """``rows`` with ``_range``: which part of its key's order a row is in.
    ``order`` is numeric; nulls come first; rows of equal order share a range.
    The rows are read up to three times, so they should be a table or cheap."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = settled(counts.where(F.col("_n") > least), "keys")
    if not counts.head(1):
        return rows.withColumn(RANGE, F.lit(0))
    total = rows.count()
    large = counts.where(F.col("_n") * hot > total).drop("_n")
    if not large.head(1):
        return rows.withColumn(RANGE, F.lit(0))
    own = _beside(rows.select(*keys, order), large, keys, "left_semi")
    share = F.array(*[F.lit((i + 1) / (cuts + 1)) for i in range(cuts)])
    marks = settled(own.groupBy(*keys).agg(F.percentile_approx(order, share, 20 * (cuts + 1)).alias("_cuts")), "cuts")
    found = _beside(rows, marks, keys, "left")
    at = 1 + F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0))
    return found.withColumn(RANGE, F.when(F.col("_cuts").isNotNull(), at).otherwise(0)).drop("_cuts")


def _earlier(rows: DataFrame, keys: list[str], parts: list[Column], carry: list[Column]) -> DataFrame:
    """``(keys, _range, carries)`` of cut keys: ``parts`` sum up a range,
    ``carry`` are window expressions over the ranges before it."""
    return rows.where(F.col(RANGE) > 0).groupBy(*keys, RANGE).agg(*parts).select(*keys, RANGE, *carry)


def _ranges(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` of ``dealt`` with the sums of each column from its key's first
    row to the row itself. ``order`` begins with the column that was dealt by
    and must be total, else ties are summed in any order."""
    w = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carry = _earlier(rows, keys, [F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())], [F.sum(f"_s{i}").over(_ranges(keys)).alias(f"_c{i}") for i in range(len(sums))])
    out = rows.select("*", *[F.sum(c).over(w).alias(name) for name, c in sums.items()])
    out = _beside(out, carry, [*keys, RANGE], "left")
    return out.withColumns({name: F.coalesce(name, F.lit(0)) + F.coalesce(f"_c{i}", F.lit(0)) for i, name in enumerate(sums)}).drop(*[f"_c{i}" for i in range(len(sums))])


def numbered(rows: DataFrame, keys: list[str], order: str, ties: list[Column] | None = None, first: dict[str, Column] | None = None, **dealing) -> DataFrame:
    """``rows`` with ``_n``, their place from 0 in their key's order, and the
    value that each column of ``first`` has in the key's first row. Cut keys are
    numbered range by range."""
    first, by = first or {}, [F.col(order).asc_nulls_first(), *(ties or [])]
    held = dealt(rows, keys, order, **dealing)
    w = Window.partitionBy(*keys, RANGE).orderBy(*by)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = held.select("*", (F.row_number().over(w) - 1).cast("long").alias("_n"), *[F.first(c).over(every).alias(name) for name, c in first.items()])
    place = F.struct(F.col(order).isNotNull().alias("_known"), F.col(order).alias("_o"), *(ties or []))
    parts = [F.count(F.lit(1)).alias("_size"), *[F.min_by(F.struct(c.alias("v")), place).alias(f"_f{i}") for i, c in enumerate(first.values())]]
    carry = [F.sum("_size").over(_ranges(keys)).alias("_before"), *[F.first(f"_f{i}").over(_ranges(keys)).alias(f"_v{i}") for i in range(len(first))]]
    out = _beside(out, _earlier(held, keys, parts, carry), [*keys, RANGE], "left")
    out = out.withColumn("_n", F.col("_n") + F.coalesce("_before", F.lit(0)))
    for i, name in enumerate(first):
        out = out.withColumn(name, F.when(F.col(f"_v{i}").isNotNull(), F.col(f"_v{i}")["v"]).otherwise(F.col(name)))
    return out.drop("_before", RANGE, *[f"_v{i}" for i in range(len(first))])


def last_before(rows: DataFrame, keys: list[str], order: str, ties: list[Column], value: Column, name: str, **dealing) -> DataFrame:
    """``rows`` with the last value that is not null at or before each row, in
    its key's order. A value that is a struct is taken whole, null fields and
    all: an as-of join, where both sides are united and ``value`` is null on the
    asking one."""
    held = dealt(rows, keys, order, **dealing).withColumn("_value", value)
    by = [F.col(order).asc_nulls_first(), *ties]
    w = Window.partitionBy(*keys, RANGE).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(F.col(order).isNotNull().alias("_known"), F.col(order).alias("_o"), *ties)
    parts = [F.max_by("_value", F.when(F.col("_value").isNotNull(), place)).alias("_last")]
    carry = _earlier(held, keys, parts, [F.last("_last", ignorenulls=True).over(_ranges(keys)).alias("_carried")])
    out = _beside(held.withColumn(name, F.last("_value", ignorenulls=True).over(w)), carry, [*keys, RANGE], "left")
    return out.withColumn(name, F.coalesce(name, "_carried")).drop("_value", "_carried", RANGE)


# --- blocks of numbered rows


def _blocks(keys: list[str]):
    return Window.partitionBy(*keys, "_block").orderBy("_n")


def _carried(ends: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """What block ends give to the next block."""
    return ends.select(*keys, (F.col("_block") + 1).alias("_block"), *names)


def _joined(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    on = [*keys, "_block"]
    named = carry.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], *[c for c in carry.columns if c not in on])
    return rows.join(named, reduce(lambda a, b: a & b, [rows[k].eqNullSafe(named[f"_k{i}"]) for i, k in enumerate(on)]), "left").drop(*[f"_k{i}" for i in range(len(on))])


def previous(rows: DataFrame, keys: list[str], columns: dict[str, str], block: int = 4096) -> DataFrame:
    """Numbered ``rows`` with the values that the named columns have in the row
    before (null in a key's first row)."""
    held = rows.withColumn("_block", F.floor(F.col("_n") / block))
    ends = held.where(F.col("_n") % block == block - 1).select(*keys, "_block", *[F.col(c).alias(f"_p{i}") for i, c in enumerate(columns.values())])
    out = held.select("*", *[F.lag(c).over(_blocks(keys)).alias(name) for name, c in columns.items()])
    out = _joined(out, _carried(ends, keys, [f"_p{i}" for i in range(len(columns))]), keys)
    first = F.col("_n") % block == 0
    return out.withColumns({name: F.when(first, F.col(f"_p{i}")).otherwise(F.col(name)) for i, name in enumerate(columns)}).drop("_block", *[f"_p{i}" for i in range(len(columns))])


def block_length(decay: float) -> int:
    """Rows until a weight of ``decay`` a row has fallen under 2**-60."""
    return max(2, math.ceil(60 * math.log(2) / -math.log(decay)))


def decayed(rows: DataFrame, keys: list[str], x: Column, decay: float, name: str, before: str, block: int | None = None) -> DataFrame:
    """Numbered ``rows`` with y = decay * (y of the row before) + x, as ``name``,
    and the y before, as ``before`` (0 in a key's first row).

    A block's own sums are a window over (key, block); the carry of a block is
    the end of the block before and, by decay ** length, that of the one before
    it: older ones weigh under 2**-120. With a shorter ``block`` than
    ``block_length`` (tests) more blocks before it are added, up to that weight."""
    if not 0 < decay < 1:
        raise ValueError("decay is between 0 and 1")
    size = block or block_length(decay)
    place = (F.col("_n") % size).cast("double")
    held = rows.withColumn("_block", F.floor(F.col("_n") / size))
    w = _blocks(keys).rowsBetween(Window.unboundedPreceding, 0)
    held = settled(held.withColumn("_own", F.pow(F.lit(decay), place) * F.sum(x * F.pow(F.lit(decay), -place)).over(w)), "scan")
    weight, back = decay**size, 1 + math.ceil(block_length(decay) / size)
    ends = held.where(F.col("_n") % size == size - 1).select(*keys, F.explode(F.array(*[F.struct((F.col("_block") + j).alias("_block"), (F.col("_own") * weight ** (j - 1)).alias("_c")) for j in range(1, back + 1)])).alias("e"))
    carry = ends.groupBy(*keys, F.col("e._block").alias("_block")).agg(F.sum("e._c").alias("_c"))
    out = _joined(held, carry, keys)
    out = out.withColumn(name, F.col("_own") + F.pow(F.lit(decay), place + 1) * F.coalesce("_c", F.lit(0.0)))
    out = out.withColumn(before, F.coalesce(F.lag(name).over(_blocks(keys)), F.coalesce("_c", F.lit(0.0))))
    return out.drop("_own", "_c", "_block")
