"""Scopes, ranges and limits of the registered queries, chosen for the sample tables."""

from __future__ import annotations

from dueward.config import Period, Scope, ScopeLimits, StabilityLimits

SCOPE = Scope.of("ASIA", "PROMO", "1996-01-01", "1999-12-31", "1999-12-20T00:00:00+00:00")
AGENCY = "ASIA"
OBSERVED_AT = Scope.of("ASIA", None, "1996-01-01", "2001-12-31", "2001-07-20T00:00:00+00:00").extracted_at
ALL_MONTHS = Period.of("1996-01-01", "2001-12-31", "all months")
PERIODS = tuple(
    Period.of(start, end)
    for start in ("1996-01-01", "1997-01-01", "1998-01-01") for end in ("2000-06-30", "1999-12-31")
) + (Period.of("1999-01-01", "2001-09-30"),)
SELECTED = Period.of("1997-01-01", "1999-12-31")
# Tight volatility limits, so that the narrowing rule has ranges to act on.
STABILITY = StabilityLimits(
    minimum_eligible_records=1_000, minimum_monthly_eligible_volume=20,
    warning_month_to_month_change=0.12, severe_month_to_month_change=0.14,
)
LIMITS = ScopeLimits(
    minimum_candidate_eligible_records=2_000, minimum_complaint_type_eligible_records=500,
    minimum_median_monthly_volume=10,
)
SAMPLE_PER_YEAR = 1_000
PAGE_LIMIT = 2_000
ORDERS_PER_PAGE = 500
