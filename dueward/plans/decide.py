"""Date-range decision, then the governed label for the decided scope."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueward.config import Period, Scope, StabilityLimits
from dueward.operators import eligibility, overview, roles, temporal
from dueward.sources.report_tables import LABEL_TABLES, write_tables


def decide_range(typed: DataFrame, agency: str, complaint_type: str, periods: Sequence[Period],
                 extracted_at: datetime, limits: StabilityLimits = StabilityLimits()) -> dict[str, DataFrame]:
    """Monthly, yearly and candidate tables from one pass over the scope's rows."""
    rows = temporal.scope_rows(typed, agency, complaint_type)
    monthly = temporal.monthly_metrics(rows, periods, extracted_at)
    comparison = temporal.compare_candidates(temporal.evaluate_candidates(monthly, limits), limits)
    chosen = comparison.where("selected").select("candidate_name")
    return {
        "temporal_stability_summary": comparison,
        "candidate_yearly_metrics": temporal.yearly_metrics(monthly),
        "selected_scope_monthly_metrics": monthly.join(chosen, "candidate_name", "left_semi"),
        "rejected_scope_candidates": temporal.temporal_rejections(comparison),
        "regime_change_evidence": temporal.regime_changes(monthly, periods[0].name),
        "descriptor_yearly_distribution": temporal.descriptor_yearly(rows),
    }


def selected_scope(comparison: DataFrame, agency: str, complaint_type: str, extracted_at: datetime,
                   decision_status: str = "APPROVED_WITH_LIMITATIONS") -> Scope:
    """The chosen range as a scope; a comparison without a choice is an error."""
    row = comparison.where(F.col("selected")).select("start_date", "end_date").first()
    if row is None:
        raise ValueError("No candidate range passed the feasibility gates.")
    return Scope.of(agency, complaint_type, row["start_date"], row["end_date"], extracted_at, decision_status)


def label_tables(typed: DataFrame, scope: Scope, cube: DataFrame | None = None, source: str = "service requests",
                 page_size: int = 50_000, governed: DataFrame | None = None) -> dict[str, DataFrame]:
    """The fourteen label tables: one cube, the governed rows, key groupings and two fixed inventories."""
    cube = eligibility.eligibility_cube(typed, scope) if cube is None else cube
    governed = eligibility.evaluate_eligibility(typed, scope) if governed is None else governed
    spark = typed.sparkSession
    return {
        "target_summary": eligibility.target_summary(cube, scope),
        "target_distribution": eligibility.target_distribution(cube),
        "eligibility_summary": eligibility.rule_pass_counts(cube),
        "exclusion_reason_summary": eligibility.exclusion_reasons(cube),
        "status_analysis": eligibility.status_analysis(cube),
        "duplicate_summary": eligibility.duplicate_overview(typed),
        "exact_duplicate_summary": eligibility.exact_duplicate_summary(typed),
        "conflicting_duplicate_summary": eligibility.conflicting_duplicate_summary(typed),
        "conflicting_duplicate_records": eligibility.conflicting_records(governed),
        "timestamp_violation_summary": eligibility.timestamp_violations(cube),
        "outcome_maturity_summary": eligibility.maturity_summary(cube),
        "leakage_audit": roles.leakage_audit(spark),
        "feature_role_inventory": roles.role_inventory(spark),
        "extraction_metadata": overview.extraction_metadata(typed, source, scope.extracted_at.isoformat(), page_size),
    }


def write_label(typed: DataFrame, scope: Scope, root: str) -> None:
    """Store the governed rows and the label tables.

    The rows and the cube are written first and every table reads them back, so
    a lost executor costs a re-read rather than the whole lineage.
    """
    spark = typed.sparkSession
    eligibility.evaluate_eligibility(typed, scope).write.mode("overwrite").parquet(f"{root}/governed")
    eligibility.eligibility_cube(typed, scope).write.mode("overwrite").parquet(f"{root}/cube")
    cube = spark.read.parquet(f"{root}/cube")
    governed = spark.read.parquet(f"{root}/governed")
    write_tables(label_tables(typed, scope, cube, governed=governed), LABEL_TABLES, root)
