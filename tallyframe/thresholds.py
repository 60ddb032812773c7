"""Settings of the analytics: ranges of days and value cutoffs."""

from __future__ import annotations

from dataclasses import dataclass

#: Shortest lookback for last activity, in days.
LOOKBACK_FLOOR = 750
#: Below this a negative value of stock is rounding; above this an imbalance of quantities counts.
VALUE_NOISE, BALANCE_TOLERANCE = 0.01, 0.5


@dataclass(frozen=True)
class Thresholds:
    """Immutable settings; days lie within 1-3650, cutoffs within 1-99 with A below B."""

    low_stock_days: int = 15
    overstock_days: int = 90
    trailing_days: int = 90
    dead_stock_days: int = 90
    tier_a_pct: int = 70
    tier_b_pct: int = 90

    def __post_init__(self) -> None:
        for name in ("low_stock_days", "overstock_days", "trailing_days", "dead_stock_days"):
            if not 1 <= getattr(self, name) <= 3650:
                raise ValueError(f"{name} must lie within 1 and 3650")
        if not (1 <= self.tier_a_pct < self.tier_b_pct <= 99):
            raise ValueError("cutoffs must satisfy 1 <= A < B <= 99")
