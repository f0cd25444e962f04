"""Thresholds, vocabularies and scopes.

Everything here is small, fixed and known before a job starts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone

# ---- fixed values: statuses -------------------------------------------------
ALLOWED_STATUSES = ("closed",)
EXCLUDED_STATUSES = ("assigned", "cancelled", "duplicate", "open", "pending", "started")
CLOSED_LABELS = ("Closed",)
ACTIVE_LABELS = ("Assigned", "In Progress", "Open", "Pending", "Started")
SPECIAL_LABELS = ("Cancel", "Cancelled", "Unspecified")

# ---- fixed values: column sets ----------------------------------------------
TIMESTAMP_COLUMNS = (
    "created_date", "closed_date", "due_date", "resolution_action_updated_date",
)
SIGNATURE_COLUMNS = (
    "created_date", "due_date", "closed_date", "agency", "complaint_type", "status",
)
MATERIAL_COLUMNS = SIGNATURE_COLUMNS + (
    "descriptor", "resolution_description", "resolution_action_updated_date",
)
PROFILE_CATEGORY_COLUMNS = (
    "agency", "agency_name", "complaint_type", "descriptor", "descriptor_2",
    "status", "borough", "location_type", "open_data_channel_type",
)
QUALITY_CATEGORY_COLUMNS = (
    "agency", "agency_name", "complaint_type", "descriptor", "status", "borough",
    "open_data_channel_type",
)
OVERVIEW_CONFLICT_COLUMNS = (
    "created_date", "closed_date", "due_date", "agency", "complaint_type", "status", "borough",
)
DIAGNOSTIC_CONFLICT_COLUMNS = (
    "created_date", "closed_date", "due_date", "agency", "agency_name", "complaint_type", "status",
)
CORE_REQUIRED = ("unique_key", "created_date", "agency", "complaint_type")
ESSENTIAL_TARGET = ("closed_date", "due_date")
TARGET_VALIDATION = ("status",)
CANDIDATE_FEATURES = (
    "agency", "complaint_type", "descriptor", "borough", "open_data_channel_type",
)
SUPPORTING = ("agency_name",)

# ---- fixed values: vocabularies ---------------------------------------------
NULL_LIKE = ("null", "none", "nan", "n/a", "na", "unknown")
UNSPECIFIED_BOROUGHS = ("", "unknown", "unspecified", "n/a", "na")
PLACEHOLDERS = ("unknown", "n/a", "na", "unspecified", "other")
FORBIDDEN_MANIFEST_KEYS = (
    "authorization", "authorization_header", "x-app-token", "app_token", "token",
)
COMPLETION_STATUSES = ("success", "failure")
SEVERITY_RANK = {"CRITICAL": 0, "ERROR": 1, "WARNING": 2, "INFO": 3}

# ---- fixed values: exclusion reasons, first match wins ----------------------
EXCLUSION_ORDER = (
    "outside_selected_scope", "missing_created_date", "missing_due_date",
    "missing_closed_date", "due_before_created", "closed_before_created",
    "excluded_status", "conflicting_duplicate_unique_key",
    "exact_duplicate_unique_key", "outcome_not_mature",
)


def _day(value: str | date) -> date:
    return value if isinstance(value, date) else date.fromisoformat(str(value)[:10])


def _instant(value: str | datetime) -> datetime:
    moment = value if isinstance(value, datetime) else datetime.fromisoformat(
        str(value).strip().replace("Z", "+00:00")
    )
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


@dataclass(frozen=True)
class Scope:
    """One agency, one complaint type, an inclusive calendar range, one observation instant.

    ``complaint_type=None`` means every type of the agency; only the monthly
    metrics accept that.
    """

    agency: str
    complaint_type: str | None
    start: date
    end: date
    extracted_at: datetime
    decision_status: str = "APPROVED"

    @classmethod
    def of(cls, agency: str, complaint_type: str | None, start, end, extracted_at,
           decision_status: str = "APPROVED") -> "Scope":
        if not str(agency).strip() or (complaint_type is not None and not str(complaint_type).strip()):
            raise ValueError("A scope needs an agency, and a complaint type that is not blank.")
        first, last = _day(start), _day(end)
        if first > last:
            raise ValueError("The scope start must not be after its end.")
        return cls(agency, complaint_type, first, last, _instant(extracted_at), decision_status)

    @property
    def end_exclusive(self) -> date:
        return self.end + timedelta(days=1)


@dataclass(frozen=True)
class Period:
    """A named inclusive calendar range."""

    name: str
    start: date
    end: date

    @classmethod
    def of(cls, start: str, end: str, name: str | None = None) -> "Period":
        return cls(name or f"{start} through {end}", _day(start), _day(end))

    @property
    def months(self) -> int:
        return (self.end.year - self.start.year) * 12 + self.end.month - self.start.month + 1

    @property
    def complete_years(self) -> int:
        """Whole January-to-December years inside the inclusive range."""
        first = self.start.year if (self.start.month, self.start.day) == (1, 1) else self.start.year + 1
        last = self.end.year if (self.end.month, self.end.day) == (12, 31) else self.end.year - 1
        return max(last - first + 1, 0)


# Default thresholds of the temporal decision.
@dataclass(frozen=True)
class StabilityLimits:
    """Gates and volatility limits for a candidate date range."""

    minimum_eligible_records: int = 10_000
    minimum_due_date_coverage: float = 0.70
    minimum_closed_date_coverage: float = 0.80
    minimum_target_rate: float = 0.05
    maximum_target_rate: float = 0.95
    minimum_active_months: int = 24
    minimum_monthly_eligible_volume: int = 250
    minimum_complete_calendar_years: int = 2
    minimum_outcome_maturity_rate: float = 0.98
    maximum_invalid_timestamp_rate: float = 0.05
    warning_target_rate_range: float = 0.30
    warning_target_rate_standard_deviation: float = 0.10
    warning_month_to_month_change: float = 0.20
    severe_target_rate_range: float = 0.50
    severe_target_rate_standard_deviation: float = 0.15
    severe_month_to_month_change: float = 0.25
    severe_monthly_volume_coefficient_of_variation: float = 0.60
    better_candidate_minimum_eligible_fraction: float = 0.50


# Default thresholds of the scope decision.
@dataclass(frozen=True)
class ScopeLimits:
    """Gates of the agency, complaint-type and candidate stages."""

    minimum_candidate_eligible_records: int = 10_000
    minimum_complaint_type_eligible_records: int = 1_000
    minimum_due_date_coverage: float = 0.70
    minimum_closed_date_coverage: float = 0.80
    minimum_target_rate: float = 0.05
    maximum_target_rate: float = 0.95
    minimum_active_months: int = 12
    minimum_median_monthly_volume: float = 25
    maximum_invalid_timestamp_rate: float = 0.05
    recent_activity_months: int = 12
    operational_relevance_score: float = 0.5


@dataclass(frozen=True)
class BoundingBox:
    min_latitude: float
    max_latitude: float
    min_longitude: float
    max_longitude: float


@dataclass(frozen=True)
class ValidationRules:
    """Settings of the raw validation suite."""

    timestamp_columns: tuple[str, ...] = TIMESTAMP_COLUMNS
    category_columns: tuple[str, ...] = PROFILE_CATEGORY_COLUMNS
    rare_category_max_rows: int = 10
    high_cardinality_threshold: int = 1000
    #: None profiles every value of a column.
    maximum_profile_values_per_column: int | None = None
    null_like: tuple[str, ...] = NULL_LIKE
    latitude_range: tuple[float, float] = (-90.0, 90.0)
    longitude_range: tuple[float, float] = (-180.0, 180.0)
    box: BoundingBox = field(default_factory=lambda: BoundingBox(40.40, 41.00, -74.30, -73.60))


# Fixed value: the source audit uses a tighter box than the validation suite.
AUDIT_BOX = BoundingBox(40.45, 40.95, -74.30, -73.65)

# Dataset identity and sample size.
DATASET_ID = "erm2-nwe9"
SAMPLE_ROWS_PER_YEAR = 1_000

# Weights of the scope scores.
SCORE_WEIGHTS = {
    "due_date_score": 0.30,
    "closed_date_score": 0.20,
    "eligible_volume_score": 0.15,
    "target_balance_score": 0.15,
    "data_consistency_score": 0.10,
    "operational_relevance_score": 0.10,
}
