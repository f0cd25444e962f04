"""Report tables: a fixed set of names, stored as Parquet with a CSV copy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dueward.sources.runs import discard_folder

# Required table sets.
VALIDATION_TABLES = (
    "validation_checks", "schema_validation", "scope_validation", "column_profile", "missingness_summary",
    "timestamp_validation_summary", "chronology_violations", "duplicate_summary", "exact_duplicate_records",
    "conflicting_duplicate_records", "category_profile", "category_variants", "status_validation",
    "geographic_validation", "geographic_outliers", "target_readiness_summary",
    "candidate_exclusion_reason_summary", "proposed_cleaning_actions",
)
LABEL_TABLES = (
    "target_summary", "target_distribution", "eligibility_summary", "exclusion_reason_summary",
    "status_analysis", "duplicate_summary", "exact_duplicate_summary", "conflicting_duplicate_summary",
    "conflicting_duplicate_records", "timestamp_violation_summary", "outcome_maturity_summary",
    "leakage_audit", "feature_role_inventory", "extraction_metadata",
)


OVERVIEW_TABLES = (
    "extraction_metadata", "dataset_scope", "table_facts", "column_inventory", "date_coverage", "records_by_year", "records_by_month",
    "sample_columns", "overview_facts", "distribution_agency_summary", "distribution_type_summary", "distribution_descriptor_summary",
    "distribution_type_descriptor_summary", "distribution_status_summary", "distribution_borough_summary",
    "distribution_channel_summary", "distribution_location_summary",
)
AUDIT_TABLES = (
    "column_requirements", "missing_values", "missing_patterns", "duplicate_summary", "duplicate_keys", "conflicting_keys",
    "timestamp_consistency", "status_timestamp_consistency", "status_categories", "categorical_quality", "case_collisions",
    "agency_name_mapping", "geographic_quality", "query_audit", "issue_register", "readiness_summary",
)
FEASIBILITY_TABLES = (
    "target_required_columns", "target_timestamp_parse_summary", "target_field_coverage", "target_eligibility_summary",
    "target_ineligibility_reasons", "target_coverage_by_complaint_type", "target_coverage_by_status", "target_coverage_by_year",
    "target_coverage_by_agency", "target_timestamp_checks", "target_leakage_assessment", "target_feasibility_decision",
)
#: Column that numbers the rows of an ordered table from 1.
PLACE = "place"


def _flat(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[
        F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, nested) else F.col(c) for c in df.columns])


def _rows() -> Column:
    return F.count(F.lit(1)).alias("rows")


def write_ordered(df: DataFrame, path: str, order: Sequence[Column | str], seen: Observation | None = None) -> None:
    """Store a table in order: files by name and rows within them, each row with its place.

    A range-partitioned sort deals the rows; the rows of each range, counted, tell where the next one starts. No task
    sees the whole table. The sorted rows are stored on the way, so that places cannot differ between tries. ``seen``
    counts them in that write, behind the sort, whose sampling would count rows twice.
    """
    spark, staging = df.sparkSession, f"{path}__sorted"
    numbered = df.orderBy(*order).select(*df.columns, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_seq"))
    (numbered if seen is None else numbered.observe(seen, _rows())).write.mode("overwrite").parquet(staging)
    rows = spark.read.parquet(staging)
    ranges = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min("_seq").alias("_first"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per task of the sort
    starts = ranges.select("_range", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    placed = rows.join(F.broadcast(starts), "_range").select(
        *df.columns, (F.col("_start") + F.col("_seq") - F.col("_first") + 1).alias(PLACE))
    placed.repartitionByRange(PLACE).sortWithinPartitions(PLACE).write.mode("overwrite").parquet(path)
    discard_folder(spark, staging)


def write_tables(tables: Mapping[str, DataFrame], required: Iterable[str], root: str, *, csv: bool = True,
                 orders: Mapping[str, Sequence[Column | str]] | None = None) -> dict[str, DataFrame]:
    """Write every table and read it back; a missing name is an error before anything is written.

    Tables named in ``orders`` are stored in that order, with a place column.
    """
    missing = sorted(set(required) - set(tables))
    if missing:
        raise ValueError(f"Report tables are missing: {missing}")
    return {name: _write(df, name, root, csv, (orders or {}).get(name)) for name, df in tables.items()}


def _write(df: DataFrame, name: str, root: str, csv: bool, order: Sequence[Column | str] | None,
           seen: Observation | None = None) -> DataFrame:
    path = f"{root}/parquet/{name}"
    if order:
        write_ordered(df, path, order, seen)
    else:
        (df if seen is None else df.observe(seen, _rows())).write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.parquet(path)
    if csv:
        rows = written.repartitionByRange(PLACE).sortWithinPartitions(PLACE) if order else written
        _flat(rows).write.mode("overwrite").option("header", True).csv(f"{root}/csv/{name}")
    return written


AUDIT_SCHEMA = "query_name string, category string, check_name string, status string, row_count bigint, " \
               "executed_at string, reason string"


def run_audited(spark: SparkSession, checks: Mapping[str, tuple[str, Callable[[], DataFrame]]], root: str, *, csv: bool = True,
                orders: Mapping[str, Sequence[Column | str]] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Write named tables under ``root``, keep what worked and log every outcome.

    Each table is computed once: its write counts the rows. A failed table has a NULL row count, never zero.
    """
    results, log = {}, []
    for name, (category, build) in checks.items():
        moment = datetime.now(timezone.utc).isoformat()
        try:
            seen = Observation(name)
            results[name] = _write(build(), name, root, csv, (orders or {}).get(name), seen)
            log.append((name, category, name, "computed", seen.get["rows"], moment, ""))
        except Exception as error:  # any failure is a finding, not a crash
            results.pop(name, None)
            log.append((name, category, name, "not_computable", None, moment, str(error).splitlines()[0][:500]))
    return results, spark.createDataFrame(log, AUDIT_SCHEMA)
