"""Sealed personal data: AES-GCM under a key per session, erased by its key."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settled


def keyring(sessions: DataFrame) -> DataFrame:
    """(session_id, key_id, key): 32 random bytes for each session, drawn once
    and written; nothing derives a key again once its row is gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array([os.urandom(32) for _ in range(b.num_rows)], pa.binary())], ["session_id", "key_id", "key"])

    ids = sessions.select("session_id").where("session_id is not null").distinct().select("session_id", F.concat(F.lit("key:"), "session_id").alias("key_id"))
    return settled(ids.mapInArrow(run, "session_id string, key_id string, key binary"), "keys")


def seal(plain: DataFrame, keys: DataFrame, nonce=None) -> DataFrame:
    """(session_id, field, plaintext[, seq]) to (session_id, field, key_id,
    sealed); empty texts are not written, a later seal replaces an earlier one.
    The session is authenticated with the text."""
    rows = plain.where(F.coalesce("plaintext", F.lit("")) != "")
    if "seq" in plain.columns:
        rows = rows.groupBy("session_id", "field").agg(F.max_by("plaintext", "seq").alias("plaintext"))
    iv = nonce if nonce is not None else F.unhex(F.substring(F.sha2(F.concat_ws("|", F.uuid(), "session_id"), 256), 1, 24))
    cipher = F.aes_encrypt(F.encode("plaintext", "UTF-8"), "key", F.lit("GCM"), F.lit("DEFAULT"), iv, F.encode("session_id", "UTF-8"))
    return rows.join(keys, "session_id").select("session_id", "field", "key_id", cipher.alias("sealed"))


def reveal(asked: DataFrame, sealed: DataFrame, keys: DataFrame) -> DataFrame:
    """(session_id, field) with status ok, not_found, erased or corrupt."""
    rows = asked.join(sealed.drop("key_id"), ["session_id", "field"], "left").join(keys, "session_id", "left")
    plain = F.decode(F.try_aes_decrypt("sealed", "key", F.lit("GCM"), F.lit("DEFAULT"), F.encode("session_id", "UTF-8")), "UTF-8")
    status = F.when(F.col("sealed").isNull(), "not_found").when(F.col("key").isNull(), "erased").when(F.col("plaintext").isNull(), "corrupt").otherwise("ok")
    return rows.withColumn("plaintext", plain).select("session_id", "field", status.alias("status"), "plaintext")


def erase(sealed: DataFrame, keys: DataFrame, erasures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and keys without the erased sessions."""
    gone = erasures.select("session_id").distinct()
    return sealed.join(gone, "session_id", "left_anti"), keys.join(gone, "session_id", "left_anti")
