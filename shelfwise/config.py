"""Configuration: brand lists, tiers and thresholds. No operator hard-codes a client."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class PriceRules:
    """Row filters for unit-of-measure and liquidation errors in shelf prices."""

    excluded_upc_prefixes: tuple[str, ...] = ()
    excluded_upcs: tuple[str, ...] = ()
    min_price_per_unit: float = 0.50


@dataclass(frozen=True)
class RetailConfig:
    own_brands: tuple[str, ...]
    own_parent: str
    subcategory: str
    excluded_channels: tuple[str, ...] = ("CONVENTIONAL|MILITARY",)
    excluded_accounts: tuple[str, ...] = ("DECA",)
    rollup_pattern: str = "MULTI OUTLET|MULO|TOTAL US|ALL CHANNEL"
    rollup_levels: tuple[str, ...] = ("NATIONAL", "TOTAL")
    #: brand -> competitor tier (1 closest .. 3); brands not listed have no tier
    brand_tiers: dict[str, int] = field(default_factory=dict)
    price: PriceRules = PriceRules()
    #: evidence floor, in weeks, of the pair and price-window features
    min_weeks: int = 8
    #: reference date of every "recent" rule; never the wall clock
    as_of: date = date(1998, 4, 6)

    @property
    def tier_one_brands(self) -> tuple[str, ...]:
        return tuple(sorted(b for b, t in self.brand_tiers.items() if t == 1))


#: Fixed values of the demand-transfer rules (shares of change).
DONOR_LOSS_STRONG = -0.10
DONOR_LOSS_MILD = -0.03
FOCAL_GAIN = 0.03
TDP_JUMP = 0.15
PROMO_WEEK_SHIFT = 2
DISCOUNT_SHIFT = 0.05

#: Fixed values of outlier classes on the 13-row z-score.
Z_EXTREME, Z_OUTLIER, Z_WATCH = 3.0, 2.0, 1.5

#: Fixed values of the forecast recursion.
HORIZON = 13
SEASONAL_BLEND = 0.40
YOY_CLIP = (0.5, 2.0)

#: Fixed values of the portfolio constraint.
LAUNCH_WINDOW = 26
TRANSFER_MIN_PROB = 0.30
DONOR_CAP = 0.20
RECEIVER_CAP = 0.50
MIN_FOCAL_UNITS = 10.0

#: ISO week -> holiday code
#: (1 new year, 2 big game, 3 memorial day, 4 labor day, 5 thanksgiving, 6 christmas).
HOLIDAY_WEEKS = {1: 1, 2: 1, 5: 2, 21: 3, 36: 4, 47: 5, 52: 6}
