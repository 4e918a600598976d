"""Parameters of all operators, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # fixed values: they decide verdicts and figures
    value_floor: int = 100_000
    interruption_cost: int = 5_000
    staleness_budget: int = 300
    weight_behaviour: float = 1.5
    weight_intent: float = 1.5
    weight_network: float = 1.2
    weight_consumption: float = 0.8
    weight_reputation: float = 1.0
    bias: float = -2.2
    prior_reputation: float = 0.5
    prior_strength: float = 20.0
    dispute_weight: float = 5.0
    cancellation_weight: float = 0.5
    ewma_alpha: float = 0.1
    mad_to_sigma: float = 1.2533
    shrink_strength: float = 20.0
    epsilon: float = 1e-9
    z_scale: float = 2.0
    p95_scale: float = 1.0
    velocity_scale: float = 0.5
    degree_scale: float = 30.0
    fan_out_scale: float = 15.0
    shared_scale: float = 8.0
    component_scale: float = 40.0
    propagation_rounds: int = 30
    propagation_damping: float = 0.85
    unattested: float = 0.85
    purpose_penalty: float = 0.5
    embed_dim: int = 64
    day_seconds: int = 86_400
    misuse_threshold: float = 0.5
    topics: dict = field(
        default_factory=lambda: {
            "decision.made": "evaluations.v1",
            "payment.captured": "payments.v1",
            "payment.failed": "payments.v1",
            "payment.disputed": "payments.v1",
            "token.confirmed": "tokens.v1",
            "token.cancelled": "tokens.v1",
            "envelope.sealed": "vault.v1",
            "erasure.requested": "vault.v1",
            "outcome.labeled": "outcomes.v1",
            "feature.behaviour.deposited": "features.v1",
            "feature.intent.deposited": "features.v1",
            "feature.network.deposited": "features.v1",
        }
    )


DEFAULT = Params()
