"""Every constant of the audit pipeline, as one frozen value."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """Thresholds, weights and families that results depend on."""

    min_peers: int = 30
    horizon_days: int = 365
    percentile_gate: float = 0.90
    risk_gate: float = 0.60
    duplicate_gate: float = 0.97
    weights: dict[str, float] = field(default_factory=lambda: {"peer_amount": 0.60, "peer_duration": 0.55, "completion_risk": 0.60, "conformance": 0.75, "change_point": 0.50, "anomaly": 0.40, "duplicate": 0.65})
    families: dict[str, str] = field(default_factory=lambda: {"peer_amount": "amount", "peer_duration": "duration", "completion_risk": "duration", "conformance": "lifecycle", "change_point": "behaviour", "anomaly": "multivariate", "duplicate": "duplication"})
    min_year_works: int = 5
    min_shift: float = 0.5
    min_periods: int = 6
    spike_z: float = 2.5
    persistent_ratio: float = 0.35
    emerging_shift: float = 0.20
    stall_floor_days: int = 30
    default_peer_days: float = 400.0
    labels_needed: int = 500


CONFIG = Config()
