"""Typed contracts of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T



# One DDL line per contract; keys first. Open bin edges are NULL, instants are UTC.
CONTRACT_DDL = {
    "stations": "station_id string, city string, tz string, office bigint, city_code string, "
    "series_high string, series_low string, is_active boolean",
    "sources": "source_id string, is_enabled boolean",
    "params": "param_key string, param_value string, dtype string",
    "forecast_runs": "run_id bigint, source_id string, issued_at timestamp_ntz",
    "forecasts_daily": "run_id bigint, station_id string, source_id string, target_date date, "
    "high_f double, low_f double, lead_hours bigint",
    "forecasts_hourly": "run_id bigint, station_id string, source_id string, valid_time timestamp_ntz, "
    "temperature_f double, dewpoint_f double, humidity_pct double, wind_speed_mph double, "
    "wind_dir_deg double, cloud_cover_pct double, precip_prob_pct double",
    "observations": "station_id string, target_date date, observed_high_f double, observed_low_f double, "
    "source string, amended boolean",
    "readings": "station_id string, ts timestamp_ntz, temp_f double",
    "daily_extremes": "station_id string, local_date date, t_max_f double, t_min_f double, "
    "obs_count bigint, last_obs_at timestamp_ntz",
    "discussions": "office bigint, issued_at timestamp_ntz, text string",
    "discussion_signals": "station_id string, confidence string, disagreement int, direction string, "
    "sigma_mult double",
    "forecast_errors": "station_id string, source_id string, target_date date, target_type string, "
    "lead_bracket string, f_raw double, observed double, error_raw double, error_adjusted double",
    "bias_history": "station_id string, target_type string, target_date date, b_k double, u_k double, "
    "q_k double, r_k double, k_k double, epsilon double, state_version int, is_amendment boolean",
    "ensemble_state": "station_id string, target_date date, target_type string, top_source string, "
    "f_top double, f_bar double, s_unweighted double, s_weighted double, sigma_eff double, m_k bigint",
    "model_weights": "station_id string, target_type string, source_id string, lead_bracket string, "
    "weight double, skill double, is_stale boolean",
    "dashboard": "station_id string, source_id string, target_type string, lead_bracket string, "
    "window_days int, n bigint, bias double, mae double, rmse double",
    "skill_matrix": "station_id string, target_type string, lead_bracket string, n bigint, "
    "bs_model double, bs_clim double, bss double, qualified boolean",
    "shadow_book": "ticker string, station_id string, target_date date, target_type string, "
    "bin_lower double, bin_upper double, mu double, sigma_eff double, g1 double, alpha double, xi double, "
    "omega double, p_win double, truncated boolean",
    "shadow_book_history": "ticker string, run_date date, p_win double, mu double, sigma_eff double",
    "best_bets": "ticker string, station_id string, target_date date, target_type string, p_win double, "
    "contract_price double, f_star double, f_final double, contracts bigint, selected boolean",
    "positions": "position_id bigint, station_id string, office bigint, target_date date, target_type string, "
    "bin_lower double, bin_upper double, ticker string, entry_price double, contracts bigint, "
    "order_type string, status string",
    "order_log": "order_id bigint, ticker string, order_type string, price double, contracts bigint",
    "orderbook_snapshots": "ticker string, snapshot_at timestamp_ntz, "
    "levels array<struct<price:int,quantity:double>>",
    "markets": "ticker string, event_ticker string, series_ticker string, target_date date, "
    "bin_lower double, bin_upper double, status string, last_price double, yes_bid double, yes_ask double",
    "ignored_events": "event_ticker string",
    "brier_scores": "ticker string, target_date date, station_id string, target_type string, "
    "outcome int, brier double",
    "calibration_history": "param_key string, old_value string, new_value string, bic_old double, bic_new double",
    "financial_metrics": "metric_date date, daily_pnl double, bankroll double, mdd_all double, mdd_90 double",
    "system_alerts": "alert_id bigint, alert_type string, station_id string, severity double, details string, "
    "alert_ts timestamp_ntz, is_resolved boolean, resolved_ts timestamp_ntz",
    "day_health": "target_date date, n_forecast bigint, n_scored bigint, is_healthy boolean",
    "signal_log": "ticker string, composite double, veto boolean, veto_reason string",
    "bias_state": "station_id string, target_type string, b_k double, u_k double, q_base double, state_version int, "
    "top_source string, last_date date",
    "regime_flags": "station_id string, target_date date, target_type string, centroid_1 double, centroid_2 double, "
    "size_1 int, size_2 int, iqr_ratio double",
    "job_runs": "run_id bigint, run_type string, started_at timestamp_ntz, status string",
    "observation_runs": "run_id bigint, started_at timestamp_ntz",
}


def contract(name: str) -> T.StructType:
    """The schema registered under ``name``."""
    return T.StructType.fromDDL(CONTRACT_DDL[name])


def columns(name: str) -> list[str]:
    return contract(name).fieldNames()
