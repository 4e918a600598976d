"""Reading and writing logs and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id string, type string, token_id string, occurred_at long, source string, payload string, seq long"


def read_jsonl(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """A JSON-lines log; blank and undecodable lines go."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null and event_id is not null").drop("_bad")


def write_log(log: DataFrame, path: str) -> None:
    """Appends events, partitioned by type so that readers prune; unknown types
    are an error before anything is written."""
    from ..functions.scalars import topic_for

    if log.where(topic_for(F.col("type")).isNull()).head(1):
        raise ValueError("the log has an event of an unknown type")
    log.write.mode("append").partitionBy("type").parquet(path)


def contained(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens whose ceilings are positive and nested, and the rejected rest."""
    fine = F.coalesce((F.col("max_amount_paise") > 0) & (F.col("max_amount_paise") <= F.col("max_per_day_paise")) & (F.col("max_per_day_paise") <= F.col("token_ceiling_paise")), F.lit(False))
    return tokens.where(fine), tokens.where(~fine)


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``; changes win over what was there."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    cols = [c for c in current.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("_new", order)).alias("r")).select(key, "r.*").select(current.columns)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1, glob: str = "*") -> DataFrame:
    """A parquet folder as a stream of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", glob).parquet(path)
