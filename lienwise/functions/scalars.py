"""Scalar column functions, built in or composed of built-in ones; the HMAC
alone runs over Arrow batches, as a composed one is far slower."""

from __future__ import annotations

import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def clamp01(x: Column) -> Column:
    """Within [0, 1]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def squash(x: Column, scale: float) -> Column:
    """1 - exp(-x/scale) above zero, else 0."""
    return F.when(x <= 0, F.lit(0.0)).otherwise(1 - F.exp(-x / scale))


def noisy_or(*parts: Column) -> Column:
    rest = F.lit(1.0)
    for p in parts:
        rest = rest * (1 - p)
    return 1 - rest


def noisy_or_array(parts: Column) -> Column:
    return 1 - F.aggregate(parts, F.lit(1.0), lambda acc, x: acc * (1 - x))


def day_of(seconds: Column, p: Params = DEFAULT) -> Column:
    """Days since the epoch; division truncates."""
    return (seconds / p.day_seconds).cast("long")


def present(x: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(x, F.lit(""))


def principal_of(agent: Column, customer: Column, token: Column) -> Column:
    return F.coalesce(present(agent), present(customer), present(token), F.lit(""))


def intent_key(session: Column, token: Column) -> Column:
    return F.coalesce(present(session), token)


def topic_for(kind: Column, p: Params = DEFAULT) -> Column:
    """The topic of an event type; null for an unknown one."""
    out = F.lit(None).cast("string")
    for topic in sorted(set(p.topics.values())):
        out = F.when(kind.isin(*[k for k, v in p.topics.items() if v == topic]), F.lit(topic)).otherwise(out)
    return out


def deposit_id(kind: Column, key: Column, at: Column) -> Column:
    return F.sha1(F.concat_ws(":", kind, key, at.cast("string")))


def label_id(reason: Column, event_id: Column) -> Column:
    return F.concat_ws(":", F.lit("label"), reason, event_id)


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by the unit separator; null counts as ''."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def node_id(kind: str, raw: Column) -> Column:
    return F.concat(F.lit(kind + ":"), raw)


def node_type(node: Column) -> Column:
    return F.substring_index(node, ":", 1)


def bare_id(node: Column) -> Column:
    return F.regexp_extract(node, r"^[^:]*:(.*)$", 1)


def rupees(paise: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(paise / 100, 2))


def distinct_keys(*keys: Column) -> Column:
    """The non-empty keys, each once, in order."""
    return F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull() & (k != "")))


def normalise_decision(raw: Column) -> Column:
    return F.regexp_replace(raw, "^ANSWER_", "")


#: Purposes and the words that stand for them.
PURPOSES = {
    "purchase": ("purchase", "buy", "order", "shop", "shopping"),
    "subscription": ("subscription", "subscribe", "recurring", "renewal", "membership"),
    "top-up": ("top-up", "topup", "recharge", "wallet", "refill"),
}


def normalise_purpose(raw: Column) -> Column:
    """A known purpose, or ''."""
    key = F.replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), F.lit("_"), F.lit("-"))
    out = F.lit("")
    for purpose, names in PURPOSES.items():
        out = F.when(key.isin(*names), F.lit(purpose)).otherwise(out)
    return out


def tokenise(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def joined_text(*parts: Column) -> Column:
    """The non-empty trimmed parts joined by ' · '."""
    return F.concat_ws(" · ", *[present(F.trim(p)) for p in parts])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors; else within [-1, 1]."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(fine, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def semantic_distance(similarity: Column) -> Column:
    return clamp01((1 - similarity) / 2)


def purpose_mismatch(a: Column, b: Column, p: Params = DEFAULT) -> Column:
    return F.when((a != "") & (b != "") & (a != b), F.lit(p.purpose_penalty)).otherwise(0.0)


def divergence(distance: Column, mismatch: Column) -> Column:
    return noisy_or(distance, mismatch)


def shrink(deviation: Column, n: Column, p: Params = DEFAULT) -> Column:
    return deviation * n / (n + p.shrink_strength)


def combine(floor: Column, baseline: Column, calibrated: Column) -> Column:
    return clamp01(F.greatest(F.coalesce(calibrated, baseline), floor))


def combine_risk(structural: Column, propagated: Column, learned: Column | None = None) -> Column:
    parts = [structural, propagated, *([learned] if learned is not None else [])]
    return clamp01(F.greatest(*parts))


def risk_score(behaviour: Column, intent: Column, network: Column, consumption: Column, reputation: Column, p: Params = DEFAULT) -> Column:
    z = F.lit(p.bias) + p.weight_behaviour * clamp01(behaviour) + p.weight_intent * clamp01(intent) + p.weight_network * clamp01(network) + p.weight_consumption * clamp01(consumption) - p.weight_reputation * clamp01(reputation)
    return 1 / (1 + F.exp(-z))


def expected_loss(probability: Column, amount: Column) -> Column:
    return (probability * amount).cast("long")


def decide(degraded: Column, loss: Column, cost: int) -> Column:
    """(answer, code); never a block."""
    return (
        F.when(degraded, F.struct(F.lit("STEP_UP").alias("answer"), F.lit("STEPUP_FAILCLOSED").alias("code")))
        .when(loss > cost, F.struct(F.lit("STEP_UP").alias("answer"), F.lit("STEPUP_RISK").alias("code")))
        .otherwise(F.struct(F.lit("ALLOW").alias("answer"), F.lit("OK_ALLOW").alias("code")))
    )


def freshness(computed_at: Column, now: Column, budget: int) -> Column:
    stale = F.lit(budget > 0) & (now - computed_at > budget)
    return F.when(computed_at.isNull(), "missing").when(stale, "stale").otherwise("fresh")


def consumption_frac(consumed: Column, ceiling: Column) -> Column:
    return F.when(consumed.isNull() | ceiling.isNull() | (ceiling <= 0), F.lit(0.0)).otherwise(clamp01(consumed / ceiling))


def hmac_sha256(key: Column, message: Column) -> Column:
    """The lower-case hex digits of the HMAC; null for a null key or message."""

    @F.pandas_udf("string")
    def run(keys: pd.Series, messages: pd.Series) -> pd.Series:
        return pd.Series([None if k is None or m is None else hmac.digest(k, m.encode(), "sha256").hex() for k, m in zip(keys, messages, strict=True)], dtype=object)

    return run(key.cast("binary"), message)


def hmac_verify(key: Column, message: Column, mac: Column) -> Column:
    """Whether ``mac`` (hex digits of either case) is that of the message."""
    return F.coalesce(hmac_sha256(key, message) == F.lower(mac), F.lit(False))


def _ascii(text: Column) -> Column:
    """Characters beyond "~" as \\uXXXX, those beyond 16 bits as two."""

    def one(c: Column) -> Column:
        h = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        return F.when(c <= "~", c).otherwise(F.concat(F.lit("\\u"), F.substring(h, 1, 4), F.when(F.length(h) > 4, F.concat(F.lit("\\u"), F.substring(h, 5, 4))).otherwise("")))

    return F.when(text.rlike("[^\\x00-~]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def canonical_json(value: Column) -> Column:
    """The JSON of a VARIANT with sorted keys, no spaces and only ASCII; null for
    null. Numbers are integers or decimals of up to 15 digits without exponent; a
    decimal of whole value is an integer, as a VARIANT holds it."""
    text = F.to_json(value)
    for code in (11, 14, 15, *range(26, 32)):  # control characters have lower-case codes
        text = F.replace(text, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return _ascii(text)
