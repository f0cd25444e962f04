"""The source audit: one counter row feeds every conditional-count table and the issue register."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dueward.config import (
    ACTIVE_LABELS, AUDIT_BOX, CANDIDATE_FEATURES, CLOSED_LABELS, CORE_REQUIRED, ESSENTIAL_TARGET,
    PLACEHOLDERS, QUALITY_CATEGORY_COLUMNS, SPECIAL_LABELS, SUPPORTING, TARGET_VALIDATION, BoundingBox,
)
from dueward.functions.numbers import holds, percentage, to_double, total
from dueward.functions.shape import rows_from, whole_table
from dueward.functions.text import fold, has_leading_space, has_trailing_space
from dueward.functions.time import at
from dueward.operators.categories import value_counts
from dueward.schemas import RAW_COLUMNS

# Requirement groups, severity when a column is absent.
COLUMN_GROUPS = (
    ("core_required", CORE_REQUIRED, "critical"),
    ("essential_target", ESSENTIAL_TARGET, "critical_for_target"),
    ("target_eligibility_and_validation", TARGET_VALIDATION, "warning"),
    ("candidate_feature", CANDIDATE_FEATURES, "warning"),
    ("supporting_metadata", SUPPORTING, "informational"),
)
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


def column_requirements(spark: SparkSession, present: Sequence[str]) -> DataFrame:
    """Presence of every required column, from the schema."""
    rows = [(c, group, c in present, severity) for group, columns, severity in COLUMN_GROUPS for c in columns]
    return spark.createDataFrame(
        rows, "column_name string, column_group string, is_present boolean, severity_if_missing string")


def column_role_text(column: str) -> str:
    groups = [group for group, columns, _ in COLUMN_GROUPS if column in columns]
    return ", ".join(groups) if groups else "selected_project_field"


def missingness_level(pct: Column) -> Column:
    return (
        F.when(pct.isNull(), "not_computable").when(pct == 0, "none").when(pct < 5.0, "low")
        .when(pct < 30.0, "moderate").when(pct < 100.0, "high").otherwise("complete")
    )


# ---- conditions -------------------------------------------------------------

def missing_pattern_conditions() -> dict[str, Column]:
    missing = {c: F.col(c).isNull() for c in
               ("closed_date", "due_date", "latitude", "longitude", "borough", "incident_zip")}
    status = F.col("status")
    return {
        "closed_and_due_both_missing": missing["closed_date"] & missing["due_date"],
        "closed_present_due_missing": ~missing["closed_date"] & missing["due_date"],
        "due_present_closed_missing": ~missing["due_date"] & missing["closed_date"],
        "closed_status_missing_closed_date": status.isin(list(CLOSED_LABELS)) & missing["closed_date"],
        "non_closed_status_with_closed_date": ~status.isin(list(CLOSED_LABELS)) & ~missing["closed_date"],
        "latitude_without_longitude": ~missing["latitude"] & missing["longitude"],
        "longitude_without_latitude": ~missing["longitude"] & missing["latitude"],
        "borough_and_zip_both_missing": missing["borough"] & missing["incident_zip"],
        "borough_missing_coordinates_present":
            missing["borough"] & ~missing["latitude"] & ~missing["longitude"],
    }


def chronology_conditions(analysed_at: datetime) -> dict[str, Column]:
    created, closed, due, updated = (F.col(c) for c in ("created_ts", "closed_ts", "due_ts", "updated_ts"))
    now = at(analysed_at)
    return {
        "closed_before_created": closed < created,
        "due_before_created": due < created,
        "resolution_update_before_created": updated < created,
        "created_after_analysis_time": created > now,
        "closed_after_analysis_time": closed > now,
        "resolution_update_after_analysis_time": updated > now,
        "due_after_analysis_time": due > now,
    }


def status_conditions() -> dict[str, Column]:
    status, closed = F.col("status"), F.col("closed_date")
    is_closed = status.isin(list(CLOSED_LABELS))
    return {
        "closed_status_missing_closed_date": is_closed & closed.isNull(),
        "active_status_with_closed_date": status.isin(list(ACTIVE_LABELS)) & closed.isNotNull(),
        "closed_status_closed_before_created": is_closed & (F.col("closed_ts") < F.col("created_ts")),
        "special_status_with_closed_date": status.isin(list(SPECIAL_LABELS)) & closed.isNotNull(),
    }


def geo_conditions(box: BoundingBox = AUDIT_BOX, position: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """Coordinates that are present but unreadable count as present, not as a position.

    ``position`` are the coordinates as numbers, where they are columns already.
    """
    lat_raw, lon_raw = F.col("latitude"), F.col("longitude")
    lat, lon = position or (to_double(lat_raw), to_double(lon_raw))
    outside = ~(lat.between(box.min_latitude, box.max_latitude)
                & lon.between(box.min_longitude, box.max_longitude))
    return {
        "latitude_outside_global_range": ~lat.between(-90, 90),
        "longitude_outside_global_range": ~lon.between(-180, 180),
        "latitude_without_longitude": lat_raw.isNotNull() & lon_raw.isNull(),
        "longitude_without_latitude": lon_raw.isNotNull() & lat_raw.isNull(),
        "both_coordinates_missing": lat_raw.isNull() & lon_raw.isNull(),
        "borough_missing_coordinates_present":
            F.col("borough").isNull() & lat_raw.isNotNull() & lon_raw.isNotNull(),
        "coordinates_outside_approximate_nyc_box": lat.isNotNull() & lon.isNotNull() & outside,
        "incident_zip_malformed": ~F.col("incident_zip").rlike(r"^[0-9]{5}$"),
    }


def audit_counts(analysed_at: datetime, columns: Sequence[str] = RAW_COLUMNS,
                 position: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """Every conditional count of the audit."""
    groups = {
        "missing": {c: F.col(c).isNull() for c in columns},
        "pattern": missing_pattern_conditions(),
        "chronology": chronology_conditions(analysed_at),
        "status": status_conditions(),
        "geo": geo_conditions(position=position),
    }
    return {f"{group}__{name}": F.count_if(holds(cond)) for group, conds in groups.items() for name, cond in conds.items()}


def audit_counters(typed: DataFrame, analysed_at: datetime, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """The counts in one row and one scan; a table that uses a few of them prunes the rest."""
    return typed.agg(F.count(F.lit(1)).alias("all_rows"), *[c.alias(n) for n, c in audit_counts(analysed_at, columns).items()])


def _check_rows(counters: DataFrame, group: str, severities: dict[str, str]) -> DataFrame:
    return rows_from(counters, [
        {"check_name": name, "affected_count": F.col(f"{group}__{name}"),
         "affected_percentage": percentage(F.col(f"{group}__{name}"), F.col("all_rows")), "severity": severity}
        for name, severity in severities.items()])


def missing_values(counters: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    rows = F.col("all_rows")
    return rows_from(counters, [
        {"column_name": c, "total_rows": rows, "non_null_count": rows - F.col(f"missing__{c}"),
         "missing_count": F.col(f"missing__{c}"),
         "missing_percentage": percentage(F.col(f"missing__{c}"), rows),
         "missingness_level": missingness_level(percentage(F.col(f"missing__{c}"), rows)),
         "column_role": column_role_text(c)} for c in columns])


def missing_patterns(counters: DataFrame) -> DataFrame:
    return _check_rows(counters, "pattern", PATTERN_SEVERITY)


def timestamp_consistency(counters: DataFrame) -> DataFrame:
    return _check_rows(counters, "chronology", CHRONOLOGY_SEVERITY)


def status_timestamp(counters: DataFrame) -> DataFrame:
    return _check_rows(counters, "status", STATUS_SEVERITY)


def geo_quality(counters: DataFrame) -> DataFrame:
    return _check_rows(counters, "geo", GEO_SEVERITY)


# ---- status vocabulary ------------------------------------------------------

def status_category(status: Column) -> Column:
    return (
        F.when(status.isin(list(CLOSED_LABELS)), "closed")
        .when(status.isin(list(ACTIVE_LABELS)), "open_or_active")
        .when(status.isin(list(SPECIAL_LABELS)), "excluded_or_special")
        .otherwise("unclassified")
    )


def status_categories(df: DataFrame) -> DataFrame:
    """Observed statuses by category, one row each; values no list names stay visible as unclassified."""
    observed = df.where(F.col("status").isNotNull()).groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "status_category", status_category(F.col("status")))
    # Dirty text may make one category hold nearly all values, so totals are summed apart: four rows at most.
    totals = observed.groupBy("status_category").agg(F.count(F.lit(1)).alias("status_values"), F.sum("n").alias("record_count"))
    return observed.join(F.broadcast(totals), "status_category").select(
        "status_category", "status_values", "record_count", F.col("status").alias("observed_value"), F.col("n").alias("value_count"))


# ---- categorical audit ------------------------------------------------------

def case_collisions_of(counts: DataFrame) -> DataFrame:
    """Lower-cased values with more than one raw spelling, one row per spelling."""
    form = Window.partitionBy("column_name", "normalized_value")
    return counts.where(F.col("value").isNotNull()).withColumn("normalized_value", F.lower("value")).select(
        "column_name", "normalized_value", F.count(F.lit(1)).over(form).alias("raw_variant_count"),
        F.col("value").alias("raw_variant"), F.col("row_count").alias("variant_rows"),
        F.sum("row_count").over(form).alias("affected_count")).where("raw_variant_count > 1")


def case_collisions(df: DataFrame, columns: Sequence[str] = QUALITY_CATEGORY_COLUMNS) -> DataFrame:
    return case_collisions_of(value_counts(df, columns))


def categorical_checks_of(counts: DataFrame) -> DataFrame:
    """Five checks per categorical column, all from one set of value counts."""
    value, n = F.col("value"), F.col("row_count")
    forms = counts.groupBy("column_name", F.lower("value").alias("form")).agg(
        total("row_count").alias("rows"),
        F.count("value").alias("spellings"),
        total(F.when(value.isNull(), n)).alias("null_values"),
        total(F.when(value == "", n)).alias("empty_strings"),
        total(F.when(has_leading_space(value) | has_trailing_space(value), n)).alias("leading_or_trailing_whitespace"),
        total(F.when(fold(value).isin(list(PLACEHOLDERS)), n)).alias("placeholder_values"))
    checks = ("null_values", "empty_strings", "leading_or_trailing_whitespace", "placeholder_values")
    per_column = forms.groupBy("column_name").agg(
        total("rows").alias("all_rows"), *[total(c).alias(c) for c in checks],
        total(F.when(F.col("spellings") > 1, F.col("rows"))).alias("case_insensitive_collisions"))
    names = checks + ("case_insensitive_collisions",)
    return per_column.select("column_name", "all_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("check_name"), F.lit("computed").alias("status"), F.col(c).alias("affected_count"))
        for c in names]))).withColumn(
        "affected_percentage", percentage(F.col("affected_count"), F.col("all_rows"))).drop("all_rows")


def categorical_checks(df: DataFrame, columns: Sequence[str] = QUALITY_CATEGORY_COLUMNS) -> DataFrame:
    return categorical_checks_of(value_counts(df, columns))


def agency_name_mapping(df: DataFrame) -> DataFrame:
    """Agency codes that carry more than one name, one row per name."""
    return agency_names_of(df.where(F.col("agency").isNotNull()).groupBy("agency", "agency_name").agg(F.count(F.lit(1)).alias("n")))


def agency_names_of(pairs: DataFrame) -> DataFrame:
    code = Window.partitionBy("agency")
    return pairs.select(
        "agency", F.count("agency_name").over(code).alias("agency_name_variant_count"), "agency_name",
        F.col("n").alias("name_rows"), F.sum("n").over(code).alias("affected_count")).where("agency_name_variant_count > 1")


# ---- issue register and readiness -------------------------------------------

# Order of the register.
REGISTER_ORDER = (
    "schema_validation", "missingness", "missing_patterns", "duplicates", "timestamp_consistency",
    "status_timestamp_consistency", "categorical_quality", "geographic_quality", "overall",
)


def _counter_issues(counters: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Findings that come from the counter row, as one array explode."""
    rows = F.col("all_rows")
    entries = []
    for c in columns:
        count = F.col(f"missing__{c}")
        level = missingness_level(percentage(count, rows))
        if c in ESSENTIAL_TARGET:
            severity = F.lit("critical_for_target")
        elif c in CORE_REQUIRED:
            severity = F.lit("warning")
        else:
            severity = F.when(level.isin("high", "complete"), "review_required").otherwise("informational")
        entries.append({"severity": severity, "category": "missingness", "check_name": "column_missing_values",
                        "column_name": c, "affected_count": count})
    for group, category, severities in (
        ("pattern", "missing_patterns", PATTERN_SEVERITY),
        ("chronology", "timestamp_consistency", CHRONOLOGY_SEVERITY),
        ("status", "status_timestamp_consistency", STATUS_SEVERITY),
        ("geo", "geographic_quality", GEO_SEVERITY),
    ):
        for name, severity in severities.items():
            entries.append({"severity": F.lit(severity), "category": category, "check_name": name,
                            "column_name": "", "affected_count": F.col(f"{group}__{name}")})
    for e in entries:
        e["affected_percentage"] = percentage(e["affected_count"], rows)
    return rows_from(counters, entries)


def _failed_checks(audit: DataFrame | None, like: DataFrame) -> DataFrame:
    """Checks an audit log reports as failed: known to be unknown, so NULL and never zero."""
    if audit is None:
        return like.limit(0)
    return audit.where(F.col("status") != "computed").select(
        F.lit("not_computable").alias("severity"), F.col("category"), F.col("check_name"),
        F.lit("").alias("column_name"), F.lit(None).cast("bigint").alias("affected_count"),
        F.lit(None).cast("double").alias("affected_percentage"))


def issue_register(counters: DataFrame, duplicates: DataFrame, counts: DataFrame, names: DataFrame, present: Sequence[str],
                   columns: Sequence[str] = RAW_COLUMNS, audit: DataFrame | None = None) -> DataFrame:
    """Every non-zero or not computable finding, numbered in a fixed order.

    From counted evidence alone: the counter row, the duplicate rows, (column, value, rows) of the category columns and
    (agency, name, rows). ``present`` names the columns that the source holds.
    """
    fields = ("severity", "category", "check_name", "column_name", "affected_count", "affected_percentage")
    findings = _counter_issues(counters, columns).select(*fields)
    registered = ("null_unique_key", "duplicated_unique_key_groups", "excess_duplicate_id_rows",
                  "conflicting_duplicate_ids", "exact_duplicate_rows")
    keys = duplicates.where(F.col("check_name").isin(list(registered))).select(
        F.when(F.col("check_name") == "exact_duplicate_rows", "warning").otherwise("critical").alias("severity"),
        F.lit("duplicates").alias("category"), "check_name",
        F.when(F.col("check_name").contains("unique_key"), "unique_key").otherwise("").alias("column_name"),
        "affected_count", "affected_percentage")
    categories = categorical_checks_of(counts).select(
        F.lit("review_required").alias("severity"), F.lit("categorical_quality").alias("category"),
        "check_name", "column_name", "affected_count", "affected_percentage")
    mapped = agency_names_of(names).agg(total("name_rows").alias("n")).select(
        F.lit("review_required").alias("severity"), F.lit("categorical_quality").alias("category"),
        F.lit("agency_name_mapping").alias("check_name"), F.lit("agency_name").alias("column_name"),
        F.col("n").alias("affected_count"), F.lit(None).cast("double").alias("affected_percentage"))
    absent = column_requirements(counters.sparkSession, present).where(~F.col("is_present")).select(
        F.col("severity_if_missing").alias("severity"), F.lit("schema_validation").alias("category"),
        F.lit("required_column_missing").alias("check_name"), "column_name",
        F.lit(None).cast("bigint").alias("affected_count"), F.lit(None).cast("double").alias("affected_percentage"))
    found = findings.unionByName(keys).unionByName(categories).unionByName(mapped).where("affected_count > 0")
    found = found.unionByName(absent).unionByName(_failed_checks(audit, findings))
    place = F.array_position(F.array(*[F.lit(c) for c in REGISTER_ORDER]), F.col("category"))
    # A register holds tens of findings, whatever the table's size.
    order = whole_table().orderBy(place, "check_name", "column_name")
    return found.withColumn(
        "issue_id", F.concat(F.lit("DQ-"), F.lpad(F.row_number().over(order).cast("string"), 4, "0"))
    ).select("issue_id", *fields)


def readiness(counters: DataFrame, duplicates: DataFrame, present: Sequence[str]) -> DataFrame:
    """Six readiness areas, each with a status and the count behind it, from the counter row and the duplicate rows."""
    duplicates = duplicates.agg(
        total(F.when(F.col("check_name") == "null_unique_key", F.col("affected_count"))).alias("null_keys"),
        total(F.when(F.col("check_name") == "duplicated_unique_key_groups", F.col("affected_count"))).alias("groups"))
    core_missing = len(set(CORE_REQUIRED) - set(present))
    target_missing = len(set(ESSENTIAL_TARGET) - set(present))
    feature_missing = len(set(CANDIDATE_FEATURES) - set(present))
    rows = F.col("all_rows")
    empty = sum((F.when(F.col(f"missing__{c}") == rows, 1).otherwise(0) for c in ESSENTIAL_TARGET), F.lit(0))
    bad = [f"chronology__{n}" for n, s in CHRONOLOGY_SEVERITY.items() if s == "critical_for_target"]
    bad += [f"status__{n}" for n, s in STATUS_SEVERITY.items() if s == "critical_for_target"]
    bad += [f"missing__{c}" for c in ESSENTIAL_TARGET]
    target_findings = sum((F.col(c) for c in bad), F.lit(0))
    ordered = sum((F.col(f"chronology__{n}") for n, s in CHRONOLOGY_SEVERITY.items() if s != "informational"), F.lit(0))
    # Areas and status texts of the readiness table.
    features = "Passed" if not feature_missing else (
        "Partially passed" if feature_missing < len(CANDIDATE_FEATURES) else "Failed")
    types = {"evidence_count": "bigint", "status": "string"}
    first = rows_from(counters, [
        {"readiness_area": "Core schema readiness", "evidence_count": core_missing,
         "status": "Passed" if not core_missing else "Failed"},
        {"readiness_area": "Target-input structural availability", "evidence_count": empty + target_missing,
         "status": F.when(empty + target_missing == 0, "Passed").otherwise("Failed")},
        {"readiness_area": "Target-quality readiness", "evidence_count": target_findings,
         "status": F.when(target_findings > 0, "Provisional review required")
         .otherwise("No material issue detected by configured checks")},
        {"readiness_area": "Timestamp integrity", "evidence_count": ordered,
         "status": F.when(ordered == 0, "Passed").otherwise("Review required")},
        {"readiness_area": "Candidate-feature availability", "evidence_count": feature_missing, "status": features},
    ], types)
    repeated = F.col("null_keys") + F.col("groups")
    second = rows_from(duplicates, [
        {"readiness_area": "Duplicate integrity", "evidence_count": repeated,
         "status": F.when(repeated == 0, "Passed").otherwise("Review required")}], types)
    return first.unionByName(second)
