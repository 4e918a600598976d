"""Intermediate and source tables of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import settled as written

__all__ = ["beside", "by_id", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Ids that a broadcast may hold; beyond that, joins shuffle.
BROADCAST_IDS = 1 << 20


def beside(rows: DataFrame) -> DataFrame:
    """``rows`` of a few short columns, for a join: to be broadcast where their
    checked count is low."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def by_id(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """A semi or anti join by id, all columns of ``docs`` kept. Ids whose count
    is checked to be low are broadcast, so that texts need not move."""
    return docs.join(beside(ids.select(id_col).distinct()), id_col, how).select(docs.columns)
