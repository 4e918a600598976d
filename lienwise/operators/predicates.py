"""The six deterministic predicates and their cascade, as column expressions.

They read one resolved row per request: the request's columns, and from left
joins the token's (t_), the block state's (b_) and the overlay's (o_)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT, Params

c = F.col


def _no(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def replayed() -> Column:
    return _no(c("nonce_spent")) & (F.coalesce(c("nonce"), F.lit("")) != "")


def wrong_identity() -> Column:
    return (F.coalesce(c("caller_id"), F.lit("")) == "") | c("t_customer_id").isNull() | _no(c("t_customer_id") != c("customer_id"))


def no_authority(now: Column) -> Column:
    spent = F.coalesce(c("b_consumed_total"), F.lit(0)) + c("amount_paise")
    return _no(c("t_status") != "confirmed") | _no((c("t_expire_at") > 0) & (now > c("t_expire_at"))) | _no(spent > c("t_token_ceiling_paise"))


def unbound_cart() -> Column:
    bound = F.coalesce(c("bound_amount_paise"), F.lit(0))
    return (F.coalesce(c("cart_hash"), F.lit("")) == "") | ((bound > 0) & (bound != c("amount_paise")))


def out_of_scope() -> Column:
    per_debit = F.least(c("t_max_amount_paise"), F.coalesce(c("o_per_debit"), c("t_max_amount_paise")))
    per_day = F.least(c("t_max_per_day_paise"), F.coalesce(c("o_per_day"), c("t_max_per_day_paise")))
    today = F.coalesce(c("b_consumed_today"), F.lit(0)) + c("amount_paise")
    return _no(c("o_denied_merchant") == c("merchant_id")) | _no(c("amount_paise") > per_debit) | _no(today > per_day)


def no_intent(p: Params = DEFAULT) -> Column:
    large = c("amount_paise") > p.value_floor
    envelope = F.coalesce(c("envelope_max_paise"), F.lit(0))
    return ((F.coalesce(c("envelope_digest"), F.lit("")) == "") & large) | ((envelope > 0) & (c("amount_paise") > envelope) & large)


def cascade(now: Column, p: Params = DEFAULT) -> Column:
    """struct(answer, code, predicate) of the first that holds, else null."""

    def hit(answer: str, code: str, name: str) -> Column:
        return F.struct(F.lit(answer).alias("answer"), F.lit(code).alias("code"), F.lit(name).alias("predicate"))

    return (
        F.when(replayed(), hit("BLOCK", "BLOCKED_DUPLICATE", "P1"))
        .when(wrong_identity(), hit("BLOCK", "BLOCKED_IDENTITY", "P5"))
        .when(no_authority(now), hit("BLOCK", "BLOCKED_AUTHORITY", "P4"))
        .when(unbound_cart(), hit("BLOCK", "BLOCKED_BINDING", "P6"))
        .when(out_of_scope(), hit("STEP_UP", "STEPUP_SCOPE", "P2"))
        .when(no_intent(p), hit("STEP_UP", "STEPUP_UNBOUND", "P3"))
    )
