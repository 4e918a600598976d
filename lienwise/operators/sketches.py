"""Sketches of bounded size as typed, mergeable columns.

Values go through a salted 64-bit hash. A sketch is first a sparse table, a row
for each key and cell, made by a group-by that combines before the shuffle, so a
hot key is no single task's work; then one array a key. Arrays of parts of the
data merge into the array of the whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and counters of a row of a frequency sketch (a power of two), bits of a register's number.
ROWS, WIDTH, BITS = 4, 256, 8


def hash64(value: Column, salt: int = 0) -> Column:
    """Blake2b of the text, 8 bytes, big end first, as a signed long; null for
    null. Each distinct value of a batch is hashed once."""
    mark = salt.to_bytes(2, "little")

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        code, known = pd.factorize(values)
        found = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8, salt=mark).digest(), "big", signed=True) for x in known]
        out = pd.Series(np.array([*found, 0], np.int64)[code], dtype="Int64")
        return out.mask(code < 0)

    return run(value)


def _dense(cells: DataFrame, key: str, size: int, merge, name: str) -> DataFrame:
    """One array a key from rows (key, cell, n); at most ``size`` of them a key."""
    rows = cells.groupBy(key, "cell").agg(merge("n").cast("long").alias("n")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("_e"))
    rows = rows.withColumn("_last", F.concat(F.array(F.lit(-1)), F.transform("_e", lambda e: e["cell"])))
    nothing = F.lit(0).cast("long")
    # each cell after as many zeros as there are cells between it and the one before
    filled = F.zip_with("_e", F.slice("_last", 1, F.size("_e")), lambda e, last: F.concat(F.array_repeat(nothing, e["cell"] - last - 1), F.array(e["n"])))
    return rows.select(key, F.concat(F.flatten(filled), F.array_repeat(nothing, size - 1 - F.element_at("_last", -1))).alias(name))


def _places(value: Column, rows: int, width: int) -> Column:
    """The cell of a value in each row of counters."""
    return F.array(*[hash64(value, i + 1).bitwiseAND(width - 1).cast("int") + i * width for i in range(rows)])


def frequencies(log: DataFrame, key: str, value: str, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """``(key, counts)``: a count-min sketch of each key's values as an array of
    rows * width counters. Null values are not counted."""
    if width & (width - 1):
        raise ValueError("width is a power of two")
    seen = log.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    return _dense(seen.select(key, F.explode(_places(F.col("_v"), rows, width)).alias("cell"), "n"), key, rows * width, F.sum, "counts")


def merged_frequencies(sketches: DataFrame, key: str) -> DataFrame:
    """Sketches of parts, several rows a key, as one: counters add up."""
    size = sketches.select(F.size("counts")).first()
    cells = sketches.select(key, F.posexplode("counts").alias("cell", "n")).where("n > 0")
    return _dense(cells, key, size[0] if size else ROWS * WIDTH, F.sum, "counts")


def estimated(counts: Column, value: Column, rows: int = ROWS, width: int = WIDTH) -> Column:
    """How often the value was counted: never too low, and too high by more than
    e / width of the key's total once in e ** rows."""
    return F.array_min(F.transform(_places(value.cast("string"), rows, width), lambda i: F.get(counts, i)))


def distinct(log: DataFrame, key: str, value: str, bits: int = BITS) -> DataFrame:
    """``(key, registers)``: a HyperLogLog sketch with 2 ** bits registers, the
    highest rank of the hashes that fall to each. Null values are not counted."""
    h = hash64(F.col("_v"))
    seen = log.where(F.col(value).isNotNull()).select(key, F.col(value).cast("string").alias("_v")).distinct().withColumn("_h", h)
    rest = F.shiftleft("_h", bits)
    rank = F.when(rest == 0, 1).otherwise(65 - F.length(F.bin(rest)))
    return _dense(seen.select(key, F.shiftrightunsigned("_h", 64 - bits).cast("int").alias("cell"), rank.alias("n")), key, 1 << bits, F.max, "registers")


def merged_distinct(sketches: DataFrame, key: str) -> DataFrame:
    """Sketches of parts as one: registers take the highest rank."""
    size = sketches.select(F.size("registers")).first()
    cells = sketches.select(key, F.posexplode("registers").alias("cell", "n")).where("n > 0")
    return _dense(cells, key, size[0] if size else 1 << BITS, F.max, "registers")


def cardinality(registers: Column, bits: int = BITS) -> Column:
    """The estimated number of distinct values: a standard error of 1.04 /
    sqrt(2 ** bits), linear counting where registers are empty."""
    m = 1 << bits
    alpha = 0.7213 / (1 + 1.079 / m) if m >= 128 else 0.709
    total = F.aggregate(registers, F.lit(0.0), lambda s, r: s + F.pow(F.lit(2.0), -r))
    empty = F.size(F.filter(registers, lambda r: r == 0))
    raw = alpha * m * m / total
    return F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(F.lit(float(m)) / empty)).otherwise(raw)
