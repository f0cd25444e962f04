"""Declared schemas; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

# The ordered 18-column ingestion contract.
RAW_COLUMNS = (
    "unique_key", "created_date", "closed_date", "due_date", "agency", "agency_name",
    "complaint_type", "descriptor", "descriptor_2", "status", "borough", "incident_zip",
    "latitude", "longitude", "location_type", "open_data_channel_type",
    "resolution_description", "resolution_action_updated_date",
)

# The ordered 44-column source projection.
SOURCE_COLUMNS = (
    "unique_key", "created_date", "closed_date", "agency", "agency_name", "complaint_type",
    "descriptor", "descriptor_2", "location_type", "incident_zip", "incident_address",
    "street_name", "cross_street_1", "cross_street_2", "intersection_street_1",
    "intersection_street_2", "address_type", "city", "landmark", "facility_type", "status",
    "due_date", "resolution_description", "resolution_action_updated_date",
    "community_board", "council_district", "police_precinct", "bbl", "borough",
    "x_coordinate_state_plane", "y_coordinate_state_plane", "open_data_channel_type",
    "park_facility_name", "park_borough", "vehicle_type", "taxi_company_borough",
    "taxi_pick_up_location", "bridge_highway_name", "bridge_highway_direction", "road_ramp",
    "bridge_highway_segment", "latitude", "longitude", "location",
)

ROW_ID = "source_row_index"
#: A number that orders rows, where their source gives one.
ROW_PLACE = "row_place"


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType(), True) for name in columns])


RAW_SCHEMA = text_schema(RAW_COLUMNS)
SOURCE_SCHEMA = T.StructType([
    T.StructField(
        name,
        T.MapType(T.StringType(), T.StringType()) if name == "location" else T.StringType(),
        True,
    )
    for name in SOURCE_COLUMNS
])

# Meaning of a column, independent of how it is stored.
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

# Columns of the check table.
CHECK_COLUMNS = (
    "check_id", "area", "check_name", "severity", "status", "observed_value",
    "expected_value", "affected_rows", "affected_rate", "message",
    "recommended_step_7_action",
)

# The 38 fields of a run manifest.
MANIFEST_SCHEMA = T.StructType([
    T.StructField("source_name", T.StringType()),
    T.StructField("dataset_id", T.StringType()),
    T.StructField("base_url", T.StringType()),
    T.StructField("scope_authority_path", T.StringType()),
    T.StructField("scope_authority_extraction_timestamp", T.StringType()),
    T.StructField("selected_agency", T.StringType()),
    T.StructField("selected_complaint_type", T.StringType()),
    T.StructField("selected_start_date", T.StringType()),
    T.StructField("selected_end_date", T.StringType()),
    T.StructField("extraction_start_utc", T.StringType()),
    T.StructField("extraction_completion_utc", T.StringType()),
    T.StructField("count_preflight_utc", T.StringType()),
    T.StructField("count_postflight_utc", T.StringType()),
    T.StructField("selected_source_columns", T.ArrayType(T.StringType())),
    T.StructField("where_clause", T.StringType()),
    T.StructField("ordering", T.ArrayType(T.StringType())),
    T.StructField("page_size", T.LongType()),
    T.StructField("timeout_seconds", T.DoubleType()),
    T.StructField("maximum_retries", T.LongType()),
    T.StructField("expected_source_count", T.LongType()),
    T.StructField("retrieved_row_count", T.LongType()),
    T.StructField("page_count", T.LongType()),
    T.StructField("page_row_counts", T.ArrayType(T.LongType())),
    T.StructField("retry_count", T.LongType()),
    T.StructField("minimum_created_date", T.StringType()),
    T.StructField("maximum_created_date", T.StringType()),
    T.StructField("unique_key_count", T.LongType()),
    T.StructField("duplicate_unique_key_count", T.LongType()),
    T.StructField("raw_file_path", T.StringType()),
    T.StructField("raw_file_format", T.StringType()),
    T.StructField("raw_file_size", T.LongType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("query_hash", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("completion_status", T.StringType()),
    T.StructField("python_version", T.StringType()),
    T.StructField("package_version", T.StringType()),
])


def require_columns(columns, required, what: str = "Input") -> None:
    """Fail with the sorted list of absent columns."""
    missing = sorted(set(required) - set(columns))
    if missing:
        raise ValueError(f"{what}: these columns are missing: {missing}")


def project(df, columns, allowed=SOURCE_COLUMNS):
    """Select columns in the given order after checking them against an allow-list."""
    names = list(columns)
    unknown = sorted(set(names) - set(allowed))
    if unknown:
        raise ValueError(f"Columns outside the allow-list: {unknown}")
    if len(set(names)) != len(names):
        raise ValueError("A projection must not repeat a column.")
    require_columns(df.columns, names, "Projection")
    return df.select(*names)
