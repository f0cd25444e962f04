"""One stored run to the eighteen validation tables and a verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession

from dueward.config import Scope, ValidationRules
from dueward.operators import categories, checks, duplicates, evidence, geography, profile, readiness
from dueward.operators.evidence import Evidence
from dueward.operators.silver import stored_names, typed_requests, with_placeholders, with_row_id
from dueward.schemas import RAW_COLUMNS
from dueward.sources import runs
from dueward.sources.report_tables import VALIDATION_TABLES, write_tables


@dataclass(frozen=True)
class ValidationResult:
    manifest: dict
    tables: dict[str, DataFrame]
    verdict: DataFrame


def evidence_tables(found: Evidence, scope: Scope, rules: ValidationRules, cube: DataFrame) -> dict[str, DataFrame]:
    """Every table but the schema, the checks and the actions: counts come from the evidence, lists of rows from the rows."""
    typed, counts = found.rows, evidence.value_counts(found.cells, rules.category_columns)
    return {
        "scope_validation": profile.scope_validation(typed, scope),
        "column_profile": profile.column_profile(found.cells, typed),
        "missingness_summary": profile.missingness_of(found.counters),
        "timestamp_validation_summary": profile.timestamp_profile(typed, rules.timestamp_columns),
        "chronology_violations": profile.chronology_violations(typed),
        "duplicate_summary": duplicates.duplicate_summary(found.keys, evidence.whole_rows(found.cells)),
        "exact_duplicate_records": duplicates.exact_duplicates(typed),
        "conflicting_duplicate_records": duplicates.conflicting_duplicates(typed),
        "category_profile": categories.category_profile(counts, rules),
        "category_variants": categories.category_variants(counts),
        "status_validation": categories.status_validation(typed),
        "geographic_validation": geography.geo_summary(typed, rules),
        "geographic_outliers": geography.geo_outliers(typed, rules),
        "target_readiness_summary": readiness.target_readiness(cube),
        "candidate_exclusion_reason_summary": readiness.candidate_exclusions(cube),
    }


def validate(spark: SparkSession, root: str, scope: Scope, report_root: str, *, run_id: str | None = None,
             extraction_date: str | None = None, authority_path: str | None = None,
             rules: ValidationRules = ValidationRules(), fail_on_error: bool = False,
             fail_on_warning: bool = False) -> ValidationResult:
    """Validate one run, or the latest successful one, and leave it as it was.

    The check table is written once and read back for the verdict and the actions.
    """
    if run_id is None:
        newest = runs.latest_run(runs.read_manifests(spark, root)).first()
        if newest is None:
            raise runs.RunUnreadable(f"No successful run exists under {root}")
        run_id, extraction_date = newest["folder_run_id"], newest["extraction_date"]
    raw, manifest = runs.read_run(spark, root, extraction_date, run_id)
    before, written = runs.listing(spark, manifest["raw_file_path"]), runs.stored_fingerprint(spark, runs.RunPaths(root, extraction_date, run_id))
    names = stored_names(raw)
    selected = manifest["selected_source_columns"] or RAW_COLUMNS
    observed = Scope.of(scope.agency, scope.complaint_type, scope.start, scope.end,
                        manifest["extraction_completion_utc"], scope.decision_status)
    # Parsed once and stored; the write counts every condition, and the tables below read what was gathered.
    # The same pass takes the fingerprint of the raw rows as they were read.
    seen = Observation("raw rows")
    rows = with_placeholders(typed_requests(with_row_id(raw))).observe(seen, *runs.fingerprint_sums(raw.columns))
    found = evidence.gather(rows, report_root, observed, observed.extracted_at, rules, mode="overwrite")
    readiness.readiness_cube(found.rows, observed).write.mode("overwrite").parquet(f"{report_root}/readiness_cube")
    cube = spark.read.parquet(f"{report_root}/readiness_cube")
    schema = {"schema_validation": profile.schema_table(raw.select(*names), RAW_COLUMNS, selected)}
    write_tables(schema | evidence_tables(found, observed, rules, cube), (), report_root)
    unchanged = runs.listing(spark, manifest["raw_file_path"]) == before and (
        written is None or {**seen.get, "columns": raw.columns} == written)
    checked = checks.validation_checks(
        found, observed, manifest, rules=rules, authority_path=authority_path, unchanged=unchanged, stored=names)
    write_tables({"validation_checks": checks.ordered_checks(checked)}, (), report_root)
    stored = spark.read.parquet(f"{report_root}/parquet/validation_checks")
    write_tables({"proposed_cleaning_actions": checks.proposed_actions(stored)}, (), report_root)
    written = {name: spark.read.parquet(f"{report_root}/parquet/{name}") for name in VALIDATION_TABLES}
    verdict = checks.validation_verdict(stored, fail_on_error=fail_on_error, fail_on_warning=fail_on_warning)
    return ValidationResult(manifest, written, verdict)
