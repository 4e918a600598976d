"""Intent: sealed envelopes, their digests and how far a debit strays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import DEFAULT, Params
from . import scan

#: Tokens that are held at a time, beyond those of one text.
PIECE_TOKENS = 1 << 17


def envelope_digest(purpose: Column, category: Column, max_amount: Column, merchant: Column, constraints: Column | None = None) -> Column:
    """SHA-256 of the canonical JSON of an envelope: sorted keys, no spaces, all
    but ASCII escaped. ``constraints`` is a VARIANT of any depth (none or null:
    an empty object)."""
    text = lambda x: S.canonical_json(F.to_variant_object(F.struct(F.lower(F.trim(F.coalesce(x, F.lit("")))).alias("v"))))
    value = lambda x: F.regexp_extract(text(x), r'(?s)^\{"v":(.*)\}$', 1)
    more = F.lit("{}") if constraints is None else F.coalesce(S.canonical_json(constraints), F.lit("{}"))
    blob = F.concat(F.lit('{"category":'), value(category), F.lit(',"constraints":'), more, F.lit(',"max_amount_paise":'), F.coalesce(max_amount, F.lit(0)).cast("string"), F.lit(',"merchant_preference":'), value(merchant), F.lit(',"purpose":"'), S.normalise_purpose(purpose), F.lit('"}'))
    return F.sha2(blob, 256)


def latest_envelope(log: DataFrame, columns: list[str], **dealing) -> DataFrame:
    """Each debit with what the last envelope of its session before it sealed: a
    new envelope replaces the old one whole, so a field that it leaves null is
    null, not what an older one said. ``sealed`` marks envelope rows; order by
    seq. A session with a large share of all rows is passed in ranges."""
    sealed = F.when(F.col("sealed"), F.struct(*columns))
    out = scan.last_before(log, ["session_id"], "seq", [], sealed, "_envelope", **dealing)
    return out.where(~F.col("sealed")).select(*log.columns, *[F.col("_envelope")[c].alias(f"env_{c}") for c in columns])


def hashed_embedding(frame: DataFrame, text: str, p: Params = DEFAULT) -> DataFrame:
    """``frame`` with ``vector``: signed token hashes in a unit vector."""
    dim = p.embed_dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(pc.list_value_length(whole.column("_tokens")).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE_TOKENS)) + 1).tolist(), whole.num_rows]
            for at, end in zip(cuts, cuts[1:], strict=False):
                b = whole.slice(at, end - at)
                lists = b.column("_tokens")
                coded = lists.flatten().dictionary_encode()
                digests = [hashlib.blake2b(w.encode(), digest_size=8).digest() for w in coded.dictionary.to_pylist()]
                cell = np.array([int.from_bytes(h[:4], "big") % dim for h in digests], np.int64)
                sign = np.array([1.0 if h[4] & 1 else -1.0 for h in digests])
                code = coded.indices.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                v = np.bincount(row * dim + cell[code], sign[code], b.num_rows * dim).reshape(b.num_rows, dim)
                norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dim, pa.int32()), pa.array((v / np.where(norm > 0, norm, 1)).ravel()))
                yield pa.record_batch([*(b.column(c) for c in names), vectors], [*names, "vector"])

    names = frame.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.withColumn("_tokens", S.tokenise(F.coalesce(F.col(text), F.lit("")))).mapInArrow(run, f"{schema}, vector array<double>")


def debit_divergence(similarity: Column, purpose: Column, sealed_purpose: Column, has_envelope: Column, p: Params = DEFAULT) -> Column:
    """How far a debit strays from its envelope; without one, a high figure."""
    return F.when(~has_envelope, F.lit(p.unattested)).otherwise(S.divergence(S.semantic_distance(similarity), S.purpose_mismatch(purpose, sealed_purpose, p)))
