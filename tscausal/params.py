"""Every constant of an analysis in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    horizon: int = 37  # trailing steps that are the test part
    lags: tuple[int, ...] = tuple(range(-12, 13))  # signed lags of the causal scan
    surrogates: int = 500
    surrogate_rounds: int = 100
    forecast_lags: tuple[int, ...] = tuple(range(1, 13))
    dimensions: tuple[int, ...] = tuple(range(2, 11))  # candidate embedding dimensions
    tau: int = 1
    horizons: tuple[int, ...] = (1, 3, 6, 12)
    level_lags: tuple[int, ...] = (1, 2, 3, 6, 12)
    exog_windows: tuple[int, ...] = (3, 6)
    max_gap: int = 6
    jump_z: float = 6.0
    level_z: float = 5.0
    gap_warning: float = 0.15
    alpha: float = 0.05
    season: int = 12
    # Depth, learning rate and number of trees of the six grid points.
    tree_grid: tuple[tuple[int, float, int], ...] = ((2, 0.05, 200), (3, 0.05, 200), (3, 0.10, 100), (4, 0.05, 300), (3, 0.03, 400), (5, 0.05, 200))


DEFAULT = Params()
