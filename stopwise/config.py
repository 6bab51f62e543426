"""Constants of an analysis, passed explicitly to the operators that need them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """Rules and dates of one data set. All date bounds are inclusive ISO dates."""

    scope: tuple[str, ...] = ("IC", "IR", "RE", "EC")
    excluded_operators: tuple[str, ...] = ()
    country_prefix: int = 85
    delay_min: float = -5.0
    delay_max: float = 360.0
    min_station_share: float = 0.8
    horizons: tuple[int, ...] = (15, 30, 60)
    lag_min: int = 2
    windows: tuple[int, ...] = (10, 30, 60)
    late_min: float = 3.0
    ahead_max_min: int = 60
    period_start: str = "2025-08-01"
    period_end: str = "2026-09-30"
    train_end: str = "2026-04-30"
    valid_end: str = "2026-05-31"
    test_end: str = "2026-06-30"
    min_segment: int = 20
    min_history: int = 30
    min_edge_runs: int = 50
    reference_quantile: float = 0.2
    max_nodes: int = 32
    max_edges: int = 96
    d0_edges: tuple[float, ...] = field(default=(-99.0, 1.0, 3.0, 10.0, 999.0))


#: Binding of the ``events`` table: see ``sources.fixture``.
EVENTS = Config(
    scope=("click", "view", "purchase", "error"), excluded_operators=("OP6",), period_start="2024-01-01", period_end="2024-12-31", train_end="2024-01-18", valid_end="2024-01-22", test_end="2024-01-25",
    min_segment=5, min_history=5, min_edge_runs=10,
)
