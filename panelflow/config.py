"""Parameters of the engine; defaults are the production ones."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    window: int = 60
    clusters: int = 10
    starts: int = 10
    rebalance: int = 1
    active_share: float = 0.8
    feature_window: int = 20
    obs_window: int = 30
    leverage: float = 2.0
    turnover_penalty: float = 0.005
    cost_rate: float = 0.0005
    risk_free: float = 0.03
    periods: int = 252
    train_steps: int = 80_000
    stop_loss: float = -0.2
    take_profit: float = 0.3
    wait: int | None = 5
