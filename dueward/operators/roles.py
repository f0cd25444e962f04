"""Creation-time roles of fields, and the gate a training frame must pass."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dueward.schemas import SOURCE_COLUMNS, require_columns

# Fields by role. Every other known field is conditional.
IDENTIFIERS = ("unique_key",)
SAFE_FEATURES = ("created_date", "agency", "agency_name", "complaint_type", "open_data_channel_type")
TARGET_INPUTS = ("due_date", "closed_date")
POST_CREATION_FIELDS = (
    "status", "final_status", "resolution_description", "resolution_action_updated_date",
    "actual_resolution_duration", "actual_resolution_duration_hours",
)
TARGET_DERIVED = (
    "is_conflicting_duplicate", "is_exact_duplicate", "missed_resolution_target",
    "outcome_mature", "primary_exclusion_reason", "target_eligible",
)
FUTURE_AGGREGATES = (
    "full_period_target_rate", "future_category_miss_rate", "future_complaint_volume",
    "post_period_aggregate", "test_target_rate", "validation_target_rate",
)
KNOWN_FIELDS = tuple(dict.fromkeys(
    SOURCE_COLUMNS + ("final_status", "actual_resolution_duration", "actual_resolution_duration_hours")
    + TARGET_DERIVED + FUTURE_AGGREGATES
))

# Fixed values: (available at creation, mutable later, allowed, decision) per role.
ROLE_POLICY = {
    "IDENTIFIER": (True, False, False, "BLOCKED"),
    "SAFE_FEATURE": (True, False, True, "APPROVED"),
    "CONDITIONAL_FEATURE": (None, None, False, "CONDITIONAL"),
    "TARGET_INPUT": (False, True, False, "NOT_APPROVED"),
    "POST_CREATION_FIELD": (False, True, False, "BLOCKED"),
    "TARGET_DERIVED": (False, False, False, "BLOCKED"),
    "EXCLUDED": (False, False, False, "BLOCKED"),
    "UNKNOWN": (None, None, False, "UNKNOWN"),
}
_ROLE_BY_FIELD = {
    **{f: "IDENTIFIER" for f in IDENTIFIERS},
    **{f: "SAFE_FEATURE" for f in SAFE_FEATURES},
    **{f: "TARGET_INPUT" for f in TARGET_INPUTS},
    **{f: "POST_CREATION_FIELD" for f in POST_CREATION_FIELDS},
    **{f: "TARGET_DERIVED" for f in TARGET_DERIVED},
    **{f: "EXCLUDED" for f in FUTURE_AGGREGATES},
}


class FeaturePolicyError(ValueError):
    """A requested training column breaks the creation-time boundary."""


def role_of(field: str) -> str:
    if field not in KNOWN_FIELDS:
        return "UNKNOWN"
    return _ROLE_BY_FIELD.get(field, "CONDITIONAL_FEATURE")


def _decision(field: str) -> tuple[str, bool | None, bool | None, bool, str]:
    role = role_of(field)
    available, mutable, allowed, decision = ROLE_POLICY[role]
    if field == "due_date":  # its timing is unproven rather than known to be late
        available, mutable = None, None
    return role, available, mutable, allowed, decision


def role_inventory(spark: SparkSession, fields: Sequence[str] = KNOWN_FIELDS) -> DataFrame:
    """The role table as a small DataFrame."""
    rows = []
    for field in fields:
        role, available, mutable, allowed, decision = _decision(field)
        kind = "datetime64[ns, UTC]" if "date" in field else "string"
        rows.append((field, kind, role, available, mutable, allowed, decision))
    return spark.createDataFrame(
        rows, "column_name string, data_type string, role string, available_at_creation boolean, "
              "mutable_after_creation boolean, allowed_for_baseline boolean, decision_status string")


def leakage_audit(spark: SparkSession, columns: Iterable[str] | None = None) -> DataFrame:
    """SAFE, CONDITIONAL or BLOCKED per column; an unknown column is blocked."""
    table = role_inventory(spark, tuple(columns) if columns is not None else KNOWN_FIELDS)
    return table.withColumn(
        "leakage_status",
        F.when(F.col("decision_status") == "APPROVED", "SAFE")
        .when(F.col("decision_status") == "CONDITIONAL", "CONDITIONAL").otherwise("BLOCKED"),
    )


def check_features(columns: Sequence[str], approved: Iterable[str] = ()) -> None:
    """Raise one error that lists every offending column."""
    allowed = set(approved)
    problems = []
    for column in columns:
        role = role_of(column)
        if role == "SAFE_FEATURE" or (role == "CONDITIONAL_FEATURE" and column in allowed):
            continue
        if role == "UNKNOWN":
            problems.append(f"{column} is in no policy")
        elif role == "CONDITIONAL_FEATURE":
            problems.append(f"{column} is conditional and was not approved")
        else:
            problems.append(f"{column} is barred as {role}")
    if problems:
        raise FeaturePolicyError("These columns may not be features: " + "; ".join(problems))


def select_features(df: DataFrame, columns: Sequence[str], approved: Iterable[str] = (),
                    label: str | None = None) -> DataFrame:
    """The training frame: checked columns, and the label only when asked for by name."""
    check_features(columns, approved)
    wanted = list(columns) + ([label] if label else [])
    require_columns(df.columns, wanted, "Training frame")
    return df.select(*wanted)
