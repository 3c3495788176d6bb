"""Operator parameters, passed explicitly to every operator that needs them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


# Fixed default values: results only agree with the published behaviour when these do.
@dataclass(frozen=True)
class Params:
    # lead brackets, hours
    lead_h1_max: float = 12.0
    lead_h2_max: float = 24.0
    lead_h3_max: float = 48.0
    lead_h4_max: float = 72.0
    lead_h5_max: float = 120.0
    anchor_hour_high: int = 15
    anchor_hour_low: int = 7
    # ensemble
    weight_min_factor: float = 0.05
    entropy_lambda: float = 0.10
    staleness_tau_days: float = 3.0
    k_spread: float = 0.50
    # bias filter
    r_default: float = 0.25
    beta: float = 2.0
    gamma: float = 0.10
    lambda_asym: float = 1.5
    gap_inflate: float = 2.0
    b_init: float = 0.0
    u_init: float = 4.0
    ewm_span_stable: int = 90
    ewm_span_volatile: int = 20
    ewm_vol_threshold: float = 2.0
    # regime
    bimodal_iqr: float = 1.35
    bimodal_centroid: float = 1.5
    bimodal_min_frac: float = 0.15
    sigma_cap: float = 6.0
    # sigma and skewness
    m_prior: float = 20.0
    sigma_floor: float = 0.1
    sigma_default: float = 2.0
    rmse_window_days: int = 90
    skew_significance: float = 2.0
    # pricing
    alpha_cap: float = 10.0
    p_floor: float = 0.001
    norm_tolerance: float = 0.001
    norm_warn: float = 0.10
    truncation_lead_hours: float = 6.0
    reading_stale_minutes: int = 120
    # gates
    ev_min_fraction: float = 0.025
    edge_base: float = 0.03
    spread_max: float = 4.0
    skill_enter: float = 0.07
    skill_exit: float = 0.03
    lead_ceiling_hours: float = 72.0
    # sizing
    fraction_cap: float = 0.10
    min_bet_fraction: float = 0.025
    jitter: float = 0.03
    phi_cap: float = 0.25
    phi_min: float = 0.10
    # exposure limits, share of bankroll
    max_single: float = 0.10
    max_station: float = 0.25
    max_office: float = 0.40
    max_total: float = 0.80
    max_station_day: float = 0.10
    # book
    stale_delta: float = 0.05
    tranche_threshold: int = 50
    tranche_size: int = 25
    # signals
    kcv_lookback: int = 7
    kcv_window: int = 90
    kcv_veto: float = 4.0
    divergence_veto: float = 0.12
    divergence_pos: float = 5.0
    divergence_neg: float = 8.0
    consensus_f: float = 1.0
    trend_veto: float = 1.5
    seasonal_scale: float = 0.15
    composite_weights: tuple[float, ...] = field(default=(0.25, 0.35, 0.15, 0.15, 0.10))
    composite_low: float = 0.25
    composite_high: float = 1.50
    # fees
    taker_rate: float = 0.07
    maker_rate: float = 0.0175
    fill_half_hours: float = 24.0
    maker_min_fill: float = 0.80
    convergence_threshold: float = 0.75
    # drawdown
    mdd_safe: float = 0.10
    mdd_halt: float = 0.20
    # evaluation
    skill_window_days: int = 90
    skill_min_rows: int = 10
    climatology: float = 1.0 / 15.0
    calibration_buckets: int = 10
    # monitoring
    warmup_days: int = 30
    min_bankroll: float = 5.0
    retention_days: int = 7

    def override(self, pairs: dict[str, object]) -> "Params":
        """Apply stored overrides (string values are cast to the field's type)."""
        known = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        cast = {k: known[k](v) if known[k] in (int, float) else v for k, v in pairs.items() if k in known}
        return replace(self, **cast)


DEFAULTS = Params()
