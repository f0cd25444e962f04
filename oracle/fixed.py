"""Values of the report contract as the SQL twins use them.

Written out here, not taken from the engine, so that a wrong value there shows as a difference.
"""

from __future__ import annotations

# Columns, vocabularies and rule names.
DIAGNOSTIC_CONFLICT_COLUMNS = (
    "created_date", "closed_date", "due_date", "agency", "agency_name", "complaint_type", "status",
)
EXCLUSION_ORDER = (
    "outside_selected_scope", "missing_created_date", "missing_due_date", "missing_closed_date", "due_before_created",
    "closed_before_created", "excluded_status", "conflicting_duplicate_unique_key", "exact_duplicate_unique_key",
    "outcome_not_mature",
)
MATERIAL_COLUMNS = (
    "created_date", "due_date", "closed_date", "agency", "complaint_type", "status", "descriptor",
    "resolution_description", "resolution_action_updated_date",
)
NULL_LIKE = (
    "null", "none", "nan", "n/a", "na", "unknown",
)
OVERVIEW_CONFLICT_COLUMNS = (
    "created_date", "closed_date", "due_date", "agency", "complaint_type", "status", "borough",
)
PLACEHOLDERS = (
    "unknown", "n/a", "na", "unspecified", "other",
)
PROFILE_CATEGORY_COLUMNS = (
    "agency", "agency_name", "complaint_type", "descriptor", "descriptor_2", "status", "borough", "location_type",
    "open_data_channel_type",
)
QUALITY_CATEGORY_COLUMNS = (
    "agency", "agency_name", "complaint_type", "descriptor", "status", "borough", "open_data_channel_type",
)
TIMESTAMP_COLUMNS = (
    "created_date", "closed_date", "due_date", "resolution_action_updated_date",
)
RAW_COLUMNS = (
    "unique_key", "created_date", "closed_date", "due_date", "agency", "agency_name", "complaint_type", "descriptor",
    "descriptor_2", "status", "borough", "incident_zip", "latitude", "longitude", "location_type",
    "open_data_channel_type", "resolution_description", "resolution_action_updated_date",
)
SUMS = (
    "total_records", "created_date_present_count", "due_date_present_count", "closed_date_present_count",
    "eligible_target_count", "missed_target_count", "invalid_due_sequence_count", "invalid_closed_sequence_count",
)
DAY_COUNTS = (
    "total_records", "due_date_present_count", "closed_date_present_count", "outcome_mature_count", "mature_open_count",
    "invalid_timestamp_count", "eligible_records", "missed_count",
)
READINESS_RULES = (
    "has_created_date", "has_due_date", "has_closed_date", "valid_due_chronology", "valid_closed_chronology",
    "status_allowed", "outcome_mature", "is_conflicting_duplicate", "candidate_target_eligible",
)
RULES = (
    "within_selected_scope", "has_created_date", "has_due_date", "has_closed_date", "valid_due_chronology",
    "valid_closed_chronology", "status_allowed", "is_exact_duplicate", "is_conflicting_duplicate", "outcome_mature",
    "target_eligible",
)
# Severities.
PATTERN_SEVERITY = {
    "closed_and_due_both_missing": "critical_for_target",
    "closed_present_due_missing": "critical_for_target",
    "due_present_closed_missing": "review_required",
    "closed_status_missing_closed_date": "critical_for_target",
    "non_closed_status_with_closed_date": "review_required",
    "latitude_without_longitude": "warning",
    "longitude_without_latitude": "warning",
    "borough_and_zip_both_missing": "warning",
    "borough_missing_coordinates_present": "review_required",
}
CHRONOLOGY_SEVERITY = {
    "closed_before_created": "critical_for_target",
    "due_before_created": "critical_for_target",
    "resolution_update_before_created": "warning",
    "created_after_analysis_time": "warning",
    "closed_after_analysis_time": "warning",
    "resolution_update_after_analysis_time": "warning",
    "due_after_analysis_time": "informational",
}
STATUS_SEVERITY = {
    "closed_status_missing_closed_date": "critical_for_target",
    "active_status_with_closed_date": "review_required",
    "closed_status_closed_before_created": "critical_for_target",
    "special_status_with_closed_date": "review_required",
}
GEO_SEVERITY = {
    "latitude_outside_global_range": "warning",
    "longitude_outside_global_range": "warning",
    "latitude_without_longitude": "warning",
    "longitude_without_latitude": "warning",
    "both_coordinates_missing": "informational",
    "borough_missing_coordinates_present": "review_required",
    "coordinates_outside_approximate_nyc_box": "informational",
    "incident_zip_malformed": "review_required",
}
GEO_METRICS = (
    ("borough", "missing", "WARNING"),
    ("borough", "unspecified_or_null_like", "WARNING"),
    ("latitude", "missing", "WARNING"),
    ("latitude", "parseable", "INFO"),
    ("latitude", "invalid_numeric", "ERROR"),
    ("latitude", "outside_world_range", "ERROR"),
    ("longitude", "missing", "WARNING"),
    ("longitude", "parseable", "INFO"),
    ("longitude", "invalid_numeric", "ERROR"),
    ("longitude", "outside_world_range", "ERROR"),
    ("coordinate_pair", "outside_nyc_bounding_box", "WARNING"),
    ("incident_zip", "missing", "WARNING"),
    ("incident_zip", "non_digit", "WARNING"),
    ("incident_zip", "unexpected_length", "WARNING"),
    ("incident_zip", "decimal_like", "WARNING"),
)
#: Severity, and the action for a chronology rule that is violated.
VIOLATIONS = {
    "due_before_created": ("ERROR", "Retain as excluded/quarantine evidence; do not repair automatically."),
    "closed_before_created": ("ERROR", "Retain as excluded/quarantine evidence; do not repair automatically."),
    "resolution_action_before_created": ("WARNING", "Review source timing; do not use the post-creation field as a feature."),
    "closed_present_created_invalid": ("ERROR", "Quarantine row because chronology cannot be established."),
    "due_present_created_invalid": ("ERROR", "Quarantine row because chronology cannot be established."),
}
COLUMN_GROUPS = (
    ("core_required", (
        "unique_key", "created_date", "agency", "complaint_type",
    ), "critical"),
    ("essential_target", (
        "closed_date", "due_date",
    ), "critical_for_target"),
    ("target_eligibility_and_validation", (
        "status",
    ), "warning"),
    ("candidate_feature", (
        "agency", "complaint_type", "descriptor", "borough", "open_data_channel_type",
    ), "warning"),
    ("supporting_metadata", (
        "agency_name",
    ), "informational"),
)
SEMANTIC_TYPES = {
    "unique_key": "identifier_string",
    "created_date": "timestamp",
    "closed_date": "timestamp",
    "due_date": "timestamp",
    "resolution_action_updated_date": "timestamp",
    "latitude": "numeric_coordinate",
    "longitude": "numeric_coordinate",
    "incident_zip": "postal_code_string",
}
DEFAULT_SEMANTIC_TYPE = "string_or_nullable_source_value"
# Role of each field.
ROLES = {
    "unique_key": "IDENTIFIER",
    "created_date": "SAFE_FEATURE",
    "closed_date": "TARGET_INPUT",
    "due_date": "TARGET_INPUT",
    "agency": "SAFE_FEATURE",
    "agency_name": "SAFE_FEATURE",
    "complaint_type": "SAFE_FEATURE",
    "descriptor": "CONDITIONAL_FEATURE",
    "descriptor_2": "CONDITIONAL_FEATURE",
    "status": "POST_CREATION_FIELD",
    "borough": "CONDITIONAL_FEATURE",
    "incident_zip": "CONDITIONAL_FEATURE",
    "latitude": "CONDITIONAL_FEATURE",
    "longitude": "CONDITIONAL_FEATURE",
    "location_type": "CONDITIONAL_FEATURE",
    "open_data_channel_type": "SAFE_FEATURE",
    "resolution_description": "POST_CREATION_FIELD",
    "resolution_action_updated_date": "POST_CREATION_FIELD",
}
