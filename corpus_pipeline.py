"""A training corpus from raw documents, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lienwise.llm import decontaminate, packing, quality, recompression, simhash
from lienwise.llm.storage import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier gives the top grade."""
    return quality.select_good(docs, quality.grades(table(spark, sf_dir, "labels")))


def near_duplicates_gone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return simhash.one_of_each(docs)


def repeats_gone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller id has."""
    out = recompression.without_repeats(docs)
    return out.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_gone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_duplicates_gone),
    ("substring dedup", repeats_gone),
    ("benchmark decontamination", benchmark_gone),
    ("packing", packed),
]

#: Its classifier is fitted and its groups are found by iteration, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
