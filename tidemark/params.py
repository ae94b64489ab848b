"""Protocol constants and parameter records."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the protocol.
TRADING_DAYS = 252
HORIZONS = (1, 5, 22)
SEED = 1990
SAMPLE_START = "1990-01-02"
LOG_FLOOR = 1e-5
FORECAST_FLOOR = 1e-4
TARGET_FLOOR = 1e-6


@dataclass(frozen=True)
class Protocol:
    """Evaluation dates; the holdout begins the day after ``dev_end``."""

    eval_start: str = "2000-01-03"
    dev_end: str = "2018-12-31"


@dataclass(frozen=True)
class WalkForward:
    horizon: int = 22
    refit_every: int = 22
    min_train: int = 252


@dataclass(frozen=True)
class Backtest:
    half_spread: float = 0.5
    roll_days: int = 22
    vol_target: float = 0.10
    vol_lookback: int = 66
    cap: float = 1.5
    stop: float = -0.05
    rebalance_every: int = 1
