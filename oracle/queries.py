"""The registered queries: operators applied to the sample tables."""

from __future__ import annotations

from collections.abc import Callable
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dueward.config import DATASET_ID, QUALITY_CATEGORY_COLUMNS, ValidationRules
from dueward.operators import (
    categories, checks, duplicates, eligibility, evidence, feasibility, geography, landing_checks, overview, profile,
    quality, readiness, reconcile, roles, scope, temporal,
)
from dueward.schemas import RAW_COLUMNS, ROW_ID
from dueward.session import shared_folder, use_utc
from dueward.sources import runs, store
from oracle.sample_tables import as_landed, service_requests
from oracle import settings as S


def plain(df: DataFrame) -> DataFrame:
    """Types both engines agree on: BIGINT, DOUBLE rounded to six digits, BOOLEAN and text."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        columns.append(c.alias(f.name))
    return df.select(*columns)


_PLANS: dict[tuple[str, str, str], DataFrame] = {}


def _plan(kind: str, spark: SparkSession, folder: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Reuse an unexecuted plan inside one application; no data is kept."""
    use_utc(spark)
    key = (kind, spark.sparkContext.applicationId, folder)
    if key not in _PLANS:
        _PLANS[key] = make()
    return _PLANS[key]


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return _plan("raw", spark, folder, lambda: service_requests(spark, folder))


#: Folders of what was stored for (kind, application, input folder).
_STORED: dict[tuple[str, str, str], str] = {}


def _stored(kind: str, spark: SparkSession, folder: str, make: Callable[[str], object]) -> str:
    """Store something once per application and input folder, in the folder that the cluster shares."""
    use_utc(spark)
    key = (kind, spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        root = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
        make(root)
        _STORED[key] = root
    return _STORED[key]


def request_store(spark: SparkSession, folder: str) -> str:
    """The sample's request store: typed rows, gold and key states by month."""
    return _stored("store", spark, folder, lambda root: store.refresh(raw(spark, folder).drop("order_key"), root))


def typed(spark: SparkSession, folder: str) -> DataFrame:
    """The typed rows as the store holds them, with the month that prunes its files."""
    root = request_store(spark, folder)
    return _plan("typed", spark, root, lambda: store.read_rows(spark, root))


def evidence_of(spark: SparkSession, folder: str) -> evidence.Evidence:
    """What the checks, the register and the profiles share, gathered once."""
    rows, at = typed(spark, folder).drop("created_month"), request_store(spark, folder)
    root = _stored("evidence", spark, folder, lambda root: evidence.gather(
        rows, root, S.SCOPE, S.OBSERVED_AT, rows_stored=True, held=store.repeated_filter(spark, at), alike=store.alike_hashes(spark, at)))
    return evidence.stored(spark, root, rows)


def forget_stored(name: str) -> None:
    """Make the next query that needs a stored table build it anew; the bench times that."""
    kind = {"request_store": "store", "evidence_of": "evidence"}.get(name, name)
    for key in [k for k in _STORED if k[0] == kind]:
        del _STORED[key]


def landed(spark: SparkSession, folder: str) -> DataFrame:
    return as_landed(raw(spark, folder), orders_per_page=S.ORDERS_PER_PAGE, limit=S.PAGE_LIMIT)


def line_count(spark: SparkSession, folder: str) -> int:
    """The count a source would have announced; read from file footers."""
    return spark.read.parquet(f"{folder}/lineitem.parquet").count()


def cube(spark, folder) -> DataFrame:
    return eligibility.eligibility_cube(typed(spark, folder), S.SCOPE)


def governed(spark, folder) -> DataFrame:
    return eligibility.evaluate_eligibility(typed(spark, folder), S.SCOPE)


def counters(spark, folder) -> DataFrame:
    return evidence_of(spark, folder).counters


def agency_rows(spark, folder) -> DataFrame:
    return temporal.scope_rows(typed(spark, folder), S.AGENCY)


def monthly(spark, folder, periods=(S.ALL_MONTHS,)) -> DataFrame:
    """Monthly metrics of some ranges, from one stored table of them all."""
    listed = (S.ALL_MONTHS, *S.PERIODS)
    root = _stored("monthly", spark, folder, lambda root: temporal.monthly_metrics(
        agency_rows(spark, folder), listed, S.OBSERVED_AT).write.parquet(root))
    return spark.read.parquet(root).where(F.col("candidate_name").isin([p.name for p in periods]))


def evaluated(spark, folder) -> DataFrame:
    return temporal.evaluate_candidates(monthly(spark, folder, S.PERIODS), S.STABILITY)


def compared(spark, folder) -> DataFrame:
    return temporal.compare_candidates(evaluated(spark, folder), S.STABILITY)


def gold(spark, folder) -> DataFrame:
    return store.read(spark, request_store(spark, folder), "gold")


def agencies(spark, folder) -> DataFrame:
    return store.agency_summary(spark, request_store(spark, folder))


def decided(spark, folder) -> DataFrame:
    cutoff = scope.recent_cutoff(S.OBSERVED_AT, S.LIMITS.recent_activity_months)
    return scope.type_decision(scope.type_summary(gold(spark, folder), cutoff), S.LIMITS)


def discovered(spark, folder) -> DataFrame:
    cutoff = scope.recent_cutoff(S.OBSERVED_AT, S.LIMITS.recent_activity_months)
    return scope.agency_discovery(agencies(spark, folder), S.LIMITS, cutoff)


def general(spark, folder) -> DataFrame:
    return scope.general_candidates(gold(spark, folder), decided(spark, folder), S.AGENCY, S.PERIODS, S.LIMITS)


def chosen_months(spark, folder) -> DataFrame:
    return scope.selected_monthly(gold(spark, folder), decided(spark, folder), S.AGENCY, S.SELECTED)


def manifest(spark, folder) -> dict[str, object]:
    return {
        "selected_agency": S.SCOPE.agency, "selected_complaint_type": S.SCOPE.complaint_type,
        "selected_start_date": S.SCOPE.start.isoformat(), "selected_end_date": S.SCOPE.end.isoformat(),
        "dataset_id": DATASET_ID, "retrieved_row_count": line_count(spark, folder),
    }


def all_checks(spark, folder) -> DataFrame:
    return checks.validation_checks(evidence_of(spark, folder), S.SCOPE, manifest(spark, folder))


def category_counts(spark, folder, columns=ValidationRules().category_columns) -> DataFrame:
    return evidence.value_counts(evidence_of(spark, folder).cells, columns)


def duplicate_rows(spark, folder) -> DataFrame:
    found = evidence_of(spark, folder)
    return duplicates.audit_duplicates(found.keys, evidence.whole_rows(found.cells))


def register(spark, folder) -> DataFrame:
    found = evidence_of(spark, folder)
    return quality.issue_register(
        found.counters, duplicate_rows(spark, folder), evidence.value_counts(found.cells, QUALITY_CATEGORY_COLUMNS),
        evidence.agency_names(found.cells), RAW_COLUMNS)


def manifests(spark, folder) -> DataFrame:
    """A manifest per four landed pages, some of them broken by rule."""
    pages = landing_checks.page_summary(landed(spark, folder))
    run = F.floor((F.col("page_number") - 1) / 4).cast("bigint")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "returned_rows"))),
                         lambda p: p["returned_rows"])
    base = pages.groupBy(run.alias("run")).agg(
        listed.alias("page_row_counts"), F.sum("returned_rows").alias("n"), F.count(F.lit(1)).alias("pages"))
    run = F.col("run")
    at = F.lit("2001-07-20T00:00:00+00:00")
    text = {c: F.lit("x") for c in runs.REQUIRED_TEXT}
    table = base.select(
        F.concat(F.lit("run-"), F.lpad(run.cast("string"), 8, "0")).alias("run_id"),
        *[(F.when(run % 7 == 5, "").otherwise(c) if n == "query_hash" else c).alias(n)
          for n, c in text.items() if n != "run_id"],
        *[(F.when(run % 6 == 4, "2001-07-20T00:00:00").otherwise(at) if n == "count_preflight_utc" else at).alias(n)
          for n in runs.UTC_FIELDS],
        F.when(run % 5 == 3, "partial").otherwise("success").alias("completion_status"),
        "page_row_counts",
        (F.col("pages") + F.when(run % 3 == 1, 1).otherwise(0)).alias("page_count"),
        (F.col("n") - F.when(run % 4 == 2, 1).otherwise(0)).alias("retrieved_row_count"),
        F.col("n").alias("expected_source_count"),
    )
    return table.withColumn("json_text", F.when(
        F.col("run_id").endswith("1"), F.to_json(F.struct("run_id", F.lit("s").alias("X-App-Token"))))
        .otherwise(F.to_json(F.struct("run_id", "retrieved_row_count"))))


FLAG_COLUMNS = (
    ROW_ID, "unique_key", "within_selected_scope", "has_created_date", "has_due_date", "has_closed_date",
    "valid_due_chronology", "valid_closed_chronology", "status_normalized", "status_allowed", "is_cancelled",
    "is_open", "status_closed_date_inconsistent", "outcome_mature", "is_exact_duplicate",
    "is_conflicting_duplicate", "target_eligible",
)
STABILITY_COLUMNS = (
    "candidate_name", "total_records", "eligible_records", "eligible_rate", "due_date_coverage",
    "closed_date_coverage", "outcome_maturity_rate", "outcome_immature_count", "mature_open_count",
    "missed_count", "on_time_count", "missed_target_rate", "active_months", "expected_months", "missing_months",
    "minimum_monthly_eligible_volume", "maximum_monthly_eligible_volume", "mean_monthly_eligible_volume",
    "monthly_volume_standard_deviation", "monthly_volume_coefficient_of_variation",
    "minimum_monthly_missed_target_rate", "maximum_monthly_missed_target_rate", "monthly_target_rate_range",
    "monthly_target_rate_standard_deviation", "largest_absolute_month_to_month_target_rate_change",
)
MONTHLY_COLUMNS = (
    "month", "total_records", "due_date_present_count", "closed_date_present_count", "outcome_mature_count",
    "outcome_immature_count", "mature_open_count", "invalid_timestamp_count", "eligible_records", "eligible_rate",
    "due_date_coverage", "closed_date_coverage", "outcome_maturity_rate", "missed_count", "on_time_count",
    "missed_target_rate",
)
RANGE_COLUMNS = (
    "candidate_name", "start_date", "end_date", "total_records", "eligible_target_count", "eligible_target_rate",
    "due_date_coverage", "closed_date_coverage", "missed_target_count", "on_time_count", "missed_target_rate",
    "active_months", "median_monthly_eligible_records", "minimum_monthly_eligible_records",
    "complaint_type_count", "missing_month_count",
)
AGENCY_COLUMNS = (
    "agency", "agency_name", "total_records", "created_date_present_count", "created_date_coverage",
    "due_date_present_count", "due_date_coverage", "closed_date_present_count", "closed_date_coverage",
    "eligible_target_count", "eligible_target_rate", "missed_target_count", "on_time_count",
    "missed_target_rate", "first_created_date", "last_created_date", "active_months", "complaint_type_count",
    "duplicate_unique_key_count", "invalid_due_sequence_count", "invalid_closed_sequence_count",
)
TYPE_COLUMNS = (
    "agency", "agency_name", "complaint_type", "total_records", "due_date_present_count", "due_date_coverage",
    "closed_date_present_count", "closed_date_coverage", "eligible_target_count", "eligible_target_rate",
    "missed_target_count", "on_time_count", "missed_target_rate", "first_created_date", "last_created_date",
    "active_months", "median_monthly_volume", "minimum_monthly_volume", "maximum_monthly_volume",
    "invalid_timestamp_count",
)
GATE_COLUMNS = tuple(g for g, _ in scope.CANDIDATE_GATES)
SCORE_COLUMNS = (
    "due_date_score", "closed_date_score", "eligible_volume_score", "target_balance_score",
    "data_consistency_score", "operational_relevance_score", "scope_score",
)


def _distribution(name: str):
    return lambda s, d: overview.distribution(raw(s, d), overview.DISTRIBUTIONS[name])


def _coverage_query(key: str):
    def run(s, d):
        column = F.year(F.col("created_ts")) if key == "created_year" else F.col(key)
        return feasibility.coverage_by(typed(s, d), column, key)
    return run


def _yearly_sample(s, d) -> DataFrame:
    return overview.yearly_sample(typed(s, d), S.SAMPLE_PER_YEAR).select(
        F.year("created_ts").alias("created_year"), "sample_rank", "unique_key", ROW_ID)


def _maturity_rows(s, d) -> DataFrame:
    return temporal.outcome_maturity(agency_rows(s, d), S.OBSERVED_AT).select(
        ROW_ID, "outcome_mature", "eligible_for_target", "analysis_eligible", "missed_resolution_target")


_BUILD: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # overview
    "dataset_scope": lambda s, d: overview.dataset_scope(typed(s, d)),
    "table_facts": lambda s, d: overview.table_facts(raw(s, d)),
    "column_inventory": lambda s, d: overview.column_inventory(evidence_of(s, d).rows, counters(s, d)),
    "column_presence": lambda s, d: landing_checks.column_presence(landed(s, d)),
    **{f"dist_{n}": _distribution(n) for n in overview.DISTRIBUTIONS},
    "by_year": lambda s, d: overview.by_year(typed(s, d)),
    "by_month": lambda s, d: overview.by_month(typed(s, d)),
    "date_coverage": lambda s, d: overview.date_coverage(typed(s, d)),
    "yearly_sample": _yearly_sample,
    "sample_columns": lambda s, d: overview.sample_columns(overview.yearly_sample(typed(s, d), S.SAMPLE_PER_YEAR)),
    "overview_facts": lambda s, d: overview.overview_facts(typed(s, d)),
    "extraction_metadata": lambda s, d: overview.extraction_metadata(
        typed(s, d), "sample tables", "2001-07-20T00:00:00+00:00", S.PAGE_LIMIT),
    "scope_filter": lambda s, d: typed(s, d).where(
        (F.col("agency") == S.SCOPE.agency) & (F.col("complaint_type") == S.SCOPE.complaint_type)
        & temporal.in_days(F.col("created_ts"), S.SCOPE.start, S.SCOPE.end_exclusive)).select(ROW_ID, *RAW_COLUMNS),
    "seeded_preview": lambda s, d: overview.seeded_preview(raw(s, d)).select(ROW_ID, "unique_key", "agency", "status"),
    "head_preview": lambda s, d: overview.head_preview(raw(s, d)).select(ROW_ID, "unique_key", "agency", "status"),
    # source audit
    # presence, beside what the table holds in each required column
    "column_requirements": lambda s, d: quality.column_requirements(s, RAW_COLUMNS).join(
        quality.missing_values(counters(s, d)).select("column_name", "non_null_count"), "column_name"),
    "missing_values": lambda s, d: quality.missing_values(counters(s, d)),
    "missing_patterns": lambda s, d: quality.missing_patterns(counters(s, d)),
    "timestamp_consistency": lambda s, d: quality.timestamp_consistency(counters(s, d)),
    "status_timestamp": lambda s, d: quality.status_timestamp(counters(s, d)),
    "geo_quality": lambda s, d: quality.geo_quality(counters(s, d)),
    "status_categories": lambda s, d: quality.status_categories(raw(s, d)),
    "categorical_checks": lambda s, d: quality.categorical_checks_of(category_counts(s, d, QUALITY_CATEGORY_COLUMNS)),
    "case_collisions": lambda s, d: quality.case_collisions_of(category_counts(s, d, QUALITY_CATEGORY_COLUMNS)),
    "agency_name_mapping": lambda s, d: quality.agency_names_of(evidence.agency_names(evidence_of(s, d).cells)),
    "duplicate_groups": lambda s, d: duplicates.duplicate_groups(raw(s, d)),
    "conflicting_keys": lambda s, d: duplicates.conflicting_keys(raw(s, d)),
    "duplicate_summary_full": duplicate_rows,
    "full_row_duplicates": lambda s, d: duplicates.full_row_duplicates(raw(s, d)),
    "issue_register": register,
    "readiness": lambda s, d: quality.readiness(counters(s, d), duplicate_rows(s, d), RAW_COLUMNS),
    # feasibility
    "timestamp_parse_summary": lambda s, d: feasibility.timestamp_parse_summary(typed(s, d)),
    "target_field_coverage": lambda s, d: feasibility.field_coverage(typed(s, d), (
        "unique_key", "created_date", "closed_date", "due_date", "agency", "complaint_type", "status")),
    "eligibility_funnel": lambda s, d: feasibility.eligibility_funnel(typed(s, d)),
    "basic_eligibility": lambda s, d: feasibility.basic_reasons(typed(s, d)),
    "target_classes": lambda s, d: feasibility.target_classes(typed(s, d)),
    **{f"coverage_by_{k}": _coverage_query(k) for k in ("complaint_type", "status", "created_year", "agency")},
    "coverage_headline": lambda s, d: feasibility.coverage_headline(_coverage_query("complaint_type")(s, d)),
    "coverage_headline_status": lambda s, d: feasibility.coverage_headline(_coverage_query("status")(s, d)),
    "coverage_headline_year": lambda s, d: feasibility.coverage_headline(_coverage_query("created_year")(s, d)),
    "timestamp_checks": lambda s, d: feasibility.timestamp_checks(typed(s, d)),
    "violation_rate_ratio": lambda s, d: feasibility.violation_rate_ratio(typed(s, d), S.AGENCY),
    "feasibility_decision": lambda s, d: feasibility.feasibility_decision(typed(s, d), S.AGENCY),
    # raw validation
    "schema_checks": lambda s, d: checks.schema_check_table(raw(s, d).drop("order_key"), line_count(s, d)).drop("message"),
    "schema_checks_drift": lambda s, d: checks.schema_check_table(
        raw(s, d).drop("descriptor_2", "order_key").withColumn("new_field", F.lower("status")), line_count(s, d)).select(
        "check_id", "severity", "status", "affected_rows", "affected_rate", "observed_value", "expected_value"),
    "column_profile": lambda s, d: profile.column_profile(evidence_of(s, d).cells, evidence_of(s, d).rows),
    "scope_validation": lambda s, d: profile.scope_validation(typed(s, d), S.SCOPE),
    "missingness": lambda s, d: profile.missingness_of(counters(s, d)),
    "timestamp_profile": lambda s, d: profile.timestamp_profile(typed(s, d)),
    "invalid_timestamps": lambda s, d: profile.invalid_timestamps(typed(s, d)),
    "chronology_violations": lambda s, d: profile.chronology_violations(typed(s, d)),
    "duplicate_summary": lambda s, d: duplicates.duplicate_summary(
        evidence_of(s, d).keys, evidence.whole_rows(evidence_of(s, d).cells)),
    "exact_duplicates": lambda s, d: duplicates.exact_duplicates(raw(s, d)),
    "conflicting_duplicates": lambda s, d: duplicates.conflicting_duplicates(raw(s, d)),
    "category_profile": lambda s, d: categories.category_profile(category_counts(s, d)),
    "category_variants": lambda s, d: categories.category_variants(category_counts(s, d)),
    "status_validation": lambda s, d: categories.status_validation(typed(s, d)),
    "geo_summary": lambda s, d: geography.geo_summary(raw(s, d)),
    "geo_outliers": lambda s, d: geography.geo_outliers(raw(s, d)),
    "target_readiness": lambda s, d: readiness.target_readiness(readiness.readiness_cube(typed(s, d), S.SCOPE)),
    "candidate_exclusions": lambda s, d: readiness.candidate_exclusions(
        readiness.readiness_cube(typed(s, d), S.SCOPE)),
    "validation_checks": all_checks,
    "validation_verdict": lambda s, d: checks.validation_verdict(all_checks(s, d), fail_on_error=True),
    "proposed_actions": lambda s, d: checks.proposed_actions(all_checks(s, d)),
    # governed label
    "eligibility_flags": lambda s, d: governed(s, d).select(*FLAG_COLUMNS),
    "exclusion_reason": lambda s, d: governed(s, d).select(ROW_ID, "primary_exclusion_reason"),
    "missed_target": lambda s, d: governed(s, d).select(ROW_ID, "target_eligible", eligibility.TARGET),
    "eligibility_invariants": lambda s, d: eligibility.invariant_violations(governed(s, d)),
    "target_summary": lambda s, d: eligibility.target_summary(cube(s, d), S.SCOPE),
    "target_distribution": lambda s, d: eligibility.target_distribution(cube(s, d)),
    "rule_pass_counts": lambda s, d: eligibility.rule_pass_counts(cube(s, d)),
    "exclusion_reasons": lambda s, d: eligibility.exclusion_reasons(cube(s, d)),
    "status_analysis": lambda s, d: eligibility.status_analysis(cube(s, d)),
    "timestamp_violations": lambda s, d: eligibility.timestamp_violations(cube(s, d)),
    "maturity_summary": lambda s, d: eligibility.maturity_summary(cube(s, d)),
    "open_breakdown": lambda s, d: eligibility.open_breakdown(cube(s, d)),
    "cancelled_breakdown": lambda s, d: eligibility.cancelled_breakdown(cube(s, d)),
    "dup_overview": lambda s, d: eligibility.duplicate_overview(typed(s, d)),
    "exact_duplicate_summary": lambda s, d: eligibility.exact_duplicate_summary(typed(s, d)),
    "conflicting_duplicate_summary": lambda s, d: eligibility.conflicting_duplicate_summary(typed(s, d)),
    "outcome_maturity": _maturity_rows,
    "scope_diagnostics": lambda s, d: store.scope_diagnostics(s, request_store(s, d)),
    # scope selection
    "scope_monthly": lambda s, d: scope.scope_monthly(typed(s, d)),
    "agency_summary": lambda s, d: agencies(s, d).select(*AGENCY_COLUMNS),
    "type_summary": lambda s, d: scope.type_summary(gold(s, d)).select(*TYPE_COLUMNS),
    "date_range_summary": lambda s, d: scope.date_range_summary(agency_rows(s, d), S.PERIODS).select(*RANGE_COLUMNS),
    "agency_discovery": lambda s, d: scope.with_viable_population(discovered(s, d), decided(s, d)).select(
        "agency", "invalid_timestamp_rate", "passes_eligible_volume", "passes_due_date_coverage",
        "passes_closed_date_coverage", "passes_temporal_coverage", "passes_data_consistency",
        "passes_target_balance", "passes_recent_activity", "passes_agency_wide_coverage",
        "proceed_to_complaint_type_review", "agency_discovery_reasons", "agency_wide_diagnostics",
        "has_viable_complaint_type_population"),
    "type_decision": lambda s, d: decided(s, d).select(
        "agency", "complaint_type", "recent_period_record_count", "invalid_timestamp_rate",
        *[r for r, _ in scope.TYPE_RULES], "scope_status", "inclusion_or_rejection_reasons"),
    "general_candidates": lambda s, d: general(s, d).select("candidate_id", "agency", *RANGE_COLUMNS, "invalid_timestamp_rate"),
    "candidate_gates": lambda s, d: general(s, d).select(
        "candidate_id", *GATE_COLUMNS, "passes_critical_gates", "gate_rejection_reasons"),
    "candidate_scores": lambda s, d: general(s, d).select("candidate_id", *SCORE_COLUMNS),
    "selected_monthly": lambda s, d: chosen_months(s, d).select(
        "created_month", "total_records", "due_date_present_count", "closed_date_present_count",
        "eligible_target_count", "missed_target_count", "complaint_type_count", "due_date_coverage",
        "closed_date_coverage", "eligible_target_rate", "on_time_count", "missed_target_rate"),
    "selected_yearly": lambda s, d: scope.selected_yearly(chosen_months(s, d)).select(
        "year", "total_records", "eligible_target_count", "due_date_present_count", "closed_date_present_count",
        "missed_target_count", "due_date_coverage", "closed_date_coverage", "missed_target_rate"),
    "monthly_stability": lambda s, d: scope.monthly_stability(chosen_months(s, d), S.SELECTED.months, S.LIMITS),
    "sensitivity": lambda s, d: scope.sensitivity(gold(s, d), S.AGENCY, S.SELECTED, S.LIMITS),
    "target_population": lambda s, d: scope.target_population(agencies(s, d)),
    # temporal stability
    "monthly_metrics": lambda s, d: monthly(s, d).select(*MONTHLY_COLUMNS),
    "yearly_metrics": lambda s, d: temporal.yearly_metrics(monthly(s, d)),
    "stability_metrics": lambda s, d: temporal.stability_metrics(monthly(s, d, S.PERIODS)).select(*STABILITY_COLUMNS),
    "candidate_evaluation": lambda s, d: evaluated(s, d).select(
        "candidate_name", "complete_calendar_years", "invalid_timestamp_rate", *temporal.GATES,
        "core_data_feasibility", "temporal_volatility_warning", "severe_temporal_volatility", "decision_status",
        "decision_reasons"),
    "candidate_containment": lambda s, d: temporal.containing_stable_candidates(evaluated(s, d), S.STABILITY),
    "candidate_comparison": lambda s, d: compared(s, d).select(
        "candidate_name", "better_stable_candidate_exists", "recent_period_relevance_score", "selection_score",
        "decision_status", "decision_reasons", "selected"),
    "temporal_rejections": lambda s, d: temporal.temporal_rejections(compared(s, d)).select(
        "candidate_name", "rejection_reason"),
    "rejected_candidates": lambda s, d: reconcile.general_rejections(general(s, d), compared(s, d)),
    "regime_change": lambda s, d: temporal.regime_changes(monthly(s, d), S.ALL_MONTHS.name),
    "descriptor_yearly": lambda s, d: temporal.descriptor_yearly(agency_rows(s, d).where("created_ts is not null")),
    "scope_reconcile": lambda s, d: reconcile.scope_reconcile(general(s, d), compared(s, d), S.AGENCY),
    # landing
    "page_summary": lambda s, d: landing_checks.page_summary(landed(s, d)),
    "oversized_pages": lambda s, d: landing_checks.oversized_pages(landed(s, d)),
    "repeated_pages": lambda s, d: landing_checks.repeated_pages(landed(s, d)),
    "unstable_order": lambda s, d: landing_checks.unstable_order(landed(s, d)),
    "page_repeated_keys": lambda s, d: landing_checks.repeated_keys_on_pages(landed(s, d)),
    "page_continuity": lambda s, d: landing_checks.page_continuity(landed(s, d)),
    "never_present_columns": lambda s, d: landing_checks.never_present_columns(landed(s, d)),
    "count_reconciliation": lambda s, d: landing_checks.count_reconciliation(raw(s, d), line_count(s, d), line_count(s, d)),
    "extraction_gates": lambda s, d: landing_checks.extraction_gates(
        typed(s, d), S.SCOPE, expected=line_count(s, d), postflight=line_count(s, d), query_hash="abc"),
    "extraction_observations": lambda s, d: landing_checks.extraction_observations(typed(s, d)),
    "key_integrity": lambda s, d: landing_checks.key_integrity(raw(s, d)),
    "manifest_check": lambda s, d: runs.manifest_check(manifests(s, d)),
    "latest_run": lambda s, d: runs.latest_run(manifests(s, d)),
    # feature policy, joined to what the table really holds
    "leakage_audit": lambda s, d: roles.leakage_audit(s, RAW_COLUMNS).join(
        profile.missingness(raw(s, d)).select("column_name", "null_count"), "column_name", "left"
    ).select("column_name", "role", "allowed_for_baseline", "leakage_status", "null_count"),
}


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(make):
        return lambda spark, folder: plain(make(spark, folder))
    return {name: wrap(make) for name, make in _BUILD.items()}
