"""The event log: total order ``seq``, at-least-once delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def dedupe(log: DataFrame) -> DataFrame:
    """The first arrival of each event_id; keyless rows go."""
    first = Window.partitionBy("event_id").orderBy("seq")
    return log.where(F.coalesce("event_id", F.lit("")) != "").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def of_types(log: DataFrame, *kinds: str) -> DataFrame:
    return log.where(F.col("type").isin(*kinds))


def keyed(log: DataFrame, *keys: str) -> DataFrame:
    out = log
    for k in keys:
        out = out.where(F.coalesce(F.col(k), F.lit("")) != "")
    return out


def routed(log: DataFrame) -> DataFrame:
    return log.withColumn("topic", S.topic_for(F.col("type")))


def decode(raw: DataFrame, payload_schema: str, column: str = "payload") -> DataFrame:
    """JSON payloads as a struct; what can't be decoded is skipped."""
    out = raw.withColumn(column, F.from_json(column, payload_schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return out.where(F.col(column).isNotNull() & F.col(f"{column}._bad").isNull())
