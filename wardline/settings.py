"""Thresholds and fixed values. Every operator takes a ``Settings`` so that tests and
backfills can override them without touching module state."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values -------------------------------------------------------------------
# Highest-priority action first.
ACTION_PRIORITY = ("deny", "tarpit", "slow", "alert", "monitor", "none")
SEVERITIES = ("critical", "high", "medium", "low", "info")
SCORE_BUCKETS = ("0-19", "20-39", "40-59", "60-79", "80-100")
# USD per million tokens equals 1000 nano-USD per token: (input, output).
TIER_PRICES_NANO_USD = {
    "haiku": (250, 1_250),
    "sonnet": (3_000, 15_000),
    "opus": (15_000, 75_000),
}
BASE_TIER = "haiku"
ESCALATED_TIER = "sonnet"
SUMMARY_TIER = "sonnet"
STRATEGIC_TIER = "opus"
# Record lifetimes in seconds.
RETENTION_SECONDS = {
    "events": 604_800,
    "window_summary": 7_776_000,
    "strategic_summary": 15_552_000,
    "exports": 86_400,
}
# ------------------------------------------------------------------------------------

NANO = 1_000_000_000


@dataclass(frozen=True)
class Settings:
    # ingest
    offset_stale_hours: int = 12
    # analysis windows
    event_count_threshold: int = 500
    time_ceiling_seconds: int = 300
    deny_ratio_threshold: float = 0.3
    spike_multiplier: float = 3.0
    baseline_seconds: int = 3_600
    # sampling
    sample_size: int = 50
    deny_sample_ratio: float = 0.4
    risk_sample_ratio: float = 0.3
    bot_sample_ratio: float = 0.2
    sample_score_threshold: int = 70
    # severity classes
    severity_critical_ratio: float = 0.5
    severity_high_ratio: float = 0.3
    severity_medium_ratio: float = 0.15
    coordinated_ips: int = 4
    coordinated_share: float = 0.5
    # cross-window reports
    summary_interval_minutes: int = 60
    # windows listed in an hourly request (None: all), and characters of each analysis
    summary_max_windows: int | None = None
    summary_analysis_chars: int = 500
    strategic_windows: int = 20
    lookback_hours: int = 168
    # spend
    warning_nano_usd: int = 5 * NANO
    cap_nano_usd: int = 10 * NANO
    prices: dict = field(default_factory=lambda: dict(TIER_PRICES_NANO_USD))
    # rows per block in block-wise running totals (see functions/blocked.py)
    block_rows: int = 65_536

    @property
    def time_ceiling_ms(self) -> int:
        return self.time_ceiling_seconds * 1000

    @property
    def baseline_ms(self) -> int:
        return self.baseline_seconds * 1000

    def sample_quota(self, ratio: float) -> int:
        return int(self.sample_size * ratio + 1e-9)


DEFAULTS = Settings()
