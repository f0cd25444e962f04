"""Overview, source audit and target feasibility, each from gathered evidence to its stored report tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueward.config import QUALITY_CATEGORY_COLUMNS
from dueward.operators import duplicates, evidence, feasibility, overview, quality, roles
from dueward.operators.evidence import Evidence
from dueward.operators.silver import TYPED, stored_names
from dueward.schemas import RAW_COLUMNS
from dueward.sources.report_tables import AUDIT_TABLES, FEASIBILITY_TABLES, OVERVIEW_TABLES, run_audited, write_tables

_LABELS = {f"distribution_{n}": columns for n, columns in overview.DISTRIBUTIONS.items()}


def _orders() -> dict[str, tuple]:
    """Row order of the tables whose order is part of the report; ties follow the labels."""
    by_count = (F.desc("record_count"),)
    orders = {f"{name}_summary": (*by_count, *columns) for name, columns in _LABELS.items()}
    return orders | {
        "records_by_year": ("created_year",), "records_by_month": ("created_month",), "column_inventory": ("column_position",),
        "missing_values": (F.desc("missing_count"), "column_name"), "issue_register": ("issue_id",),
        "duplicate_keys": (F.desc("record_count"), "unique_key"), "case_collisions": (F.desc("affected_count"), "column_name", "raw_variant"),
        "target_coverage_by_complaint_type": (F.desc("target_eligible_count"), F.desc("record_count"), F.asc_nulls_last("complaint_type")),
        "target_coverage_by_status": (*by_count, F.asc_nulls_last("status")),
        "target_coverage_by_year": (F.asc_nulls_last("created_year"),),
        "target_coverage_by_agency": (*by_count, F.asc_nulls_last("agency")),
    }


def write_overview(found: Evidence, root: str, *, source: str, extracted_at: str, page_size: int) -> dict[str, DataFrame]:
    """Facts, date coverage, volumes, distributions and a sample's completeness."""
    rows = found.rows
    tables = {
        "extraction_metadata": overview.extraction_metadata(rows, source, extracted_at, page_size),
        "dataset_scope": overview.dataset_scope(rows),
        "table_facts": overview.table_facts(rows),
        "column_inventory": overview.column_inventory(rows, found.counters),
        "date_coverage": overview.date_coverage(rows),
        "records_by_year": overview.by_year(rows),
        "records_by_month": overview.by_month(rows),
        "sample_columns": overview.sample_columns(overview.yearly_sample(rows)),
        "overview_facts": overview.overview_facts(rows),
        **{f"{name}_summary": overview.distribution(rows, columns) for name, columns in _LABELS.items()},
    }
    return write_tables(tables, OVERVIEW_TABLES, root, orders=_orders())


def audit_checks(found: Evidence) -> Mapping[str, tuple[str, Callable[[], DataFrame]]]:
    """The audit's tables by name, with their category; each reads evidence, few read rows."""
    counters, rows = found.counters, found.rows
    present = stored_names(rows)

    def counts() -> DataFrame:
        return evidence.value_counts(found.cells, QUALITY_CATEGORY_COLUMNS)

    return {
        "column_requirements": ("schema_validation", lambda: quality.column_requirements(rows.sparkSession, present)),
        "missing_values": ("missingness", lambda: quality.missing_values(counters)),
        "missing_patterns": ("missing_patterns", lambda: quality.missing_patterns(counters)),
        "duplicate_summary": ("duplicates", lambda: duplicates.audit_duplicates(found.keys, evidence.whole_rows(found.cells))),
        "duplicate_keys": ("duplicates", lambda: duplicates.duplicate_groups(rows)),
        "conflicting_keys": ("duplicates", lambda: duplicates.conflicting_keys(rows)),
        "timestamp_consistency": ("timestamp_consistency", lambda: quality.timestamp_consistency(counters)),
        "status_timestamp_consistency": ("status_timestamp_consistency", lambda: quality.status_timestamp(counters)),
        "status_categories": ("categorical_quality", lambda: quality.status_categories(rows)),
        "categorical_quality": ("categorical_quality", lambda: quality.categorical_checks_of(counts())),
        "case_collisions": ("categorical_quality", lambda: quality.case_collisions_of(counts())),
        "agency_name_mapping": ("categorical_quality", lambda: quality.agency_names_of(evidence.agency_names(found.cells))),
        "geographic_quality": ("geographic_quality", lambda: quality.geo_quality(counters)),
    }


def write_audit(found: Evidence, root: str) -> dict[str, DataFrame]:
    """The audit's tables, the log of how each went, the issue register and the readiness areas.

    A table that cannot be computed is missing from the result and a finding of the register.
    """
    spark, present = found.rows.sparkSession, stored_names(found.rows)
    done, log = run_audited(spark, audit_checks(found), root, orders=_orders())
    repeated = done.get("duplicate_summary", None)
    if repeated is None:
        repeated = duplicates.audit_duplicates(found.keys, evidence.whole_rows(found.cells))
    written = write_tables({
        "query_audit": log,
        "issue_register": quality.issue_register(
            found.counters, repeated, evidence.value_counts(found.cells, QUALITY_CATEGORY_COLUMNS), evidence.agency_names(found.cells),
            present, audit=log),
        "readiness_summary": quality.readiness(found.counters, repeated, present),
    }, (), root, orders=_orders())
    absent = sorted(set(AUDIT_TABLES) - set(done) - set(written) - {r.query_name for r in log.where("status <> 'computed'").collect()})
    if absent:
        raise ValueError(f"Report tables are missing: {absent}")
    return done | written


def write_feasibility(found: Evidence, root: str, agency: str) -> dict[str, DataFrame]:
    """Can the label be built: coverage by group, the funnel, pair checks and the decision for one agency."""
    rows = found.rows
    by = {
        "complaint_type": F.col("complaint_type"), "status": F.col("status"), "year": F.year(F.col("created_ts")), "agency": F.col("agency"),
    }
    names = {"year": "created_year"}
    coverage = write_tables({
        f"target_coverage_by_{k}": feasibility.coverage_by(rows, c, names.get(k, k)) for k, c in by.items()}, (), root, orders=_orders())
    tables = {
        "target_required_columns": quality.column_requirements(rows.sparkSession, stored_names(rows)).where(
            F.col("column_group").isin("core_required", "essential_target")),
        "target_timestamp_parse_summary": feasibility.timestamp_parse_summary(rows),
        "target_field_coverage": feasibility.field_coverage(rows, [c for c in RAW_COLUMNS if c in (*TYPED, "unique_key", "agency", "complaint_type", "status")]),
        "target_eligibility_summary": feasibility.eligibility_funnel(rows),
        "target_ineligibility_reasons": feasibility.basic_reasons(rows),
        "target_classes": feasibility.target_classes(rows),
        "target_timestamp_checks": feasibility.timestamp_checks(rows),
        "target_violation_rate": feasibility.violation_rate_ratio(rows, agency),
        "target_leakage_assessment": roles.leakage_audit(rows.sparkSession),
        "target_feasibility_decision": feasibility.feasibility_decision(rows, agency),
        **{f"target_coverage_headline_{k}": feasibility.coverage_headline(coverage[f"target_coverage_by_{k}"]) for k in by},
    }
    return write_tables(tables, [t for t in FEASIBILITY_TABLES if t not in coverage], root) | coverage
