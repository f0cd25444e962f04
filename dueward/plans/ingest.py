"""Landed pages to one immutable raw run."""

from __future__ import annotations

from datetime import datetime, timezone
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dueward.config import Scope
from dueward.functions.shape import one_row
from dueward.operators import landing_checks
from dueward.operators.silver import typed_requests
from dueward.schemas import RAW_COLUMNS, ROW_ID, ROW_PLACE
from dueward.sources import runs
from dueward.sources.landing import read_landed
from dueward.sources.report_tables import write_tables
from dueward.sources.scope_files import approved


def ingest(spark: SparkSession, landing: str, root: str, scope: Scope, *, preflight: int, postflight: int,
           source: str, authority_path: str, started_at: datetime | None = None, overwrite: bool = False,
           report_root: str | None = None, preflight_at: datetime | None = None,
           postflight_at: datetime | None = None) -> runs.RunPaths:
    """Check pages and gates, then store the run; a failed check stores nothing.

    The landed text is parsed once into a staging table; that write counts for the gates, the observations and the keys
    of each object. ``preflight_at`` and
    ``postflight_at`` are when the source was counted; without them, when the counts were handed over here.
    """
    approved(scope)
    handed_over = datetime.now(timezone.utc)
    started = started_at or handed_over
    paths = runs.run_paths(spark, root, scope, started)
    runs.guard_run(spark, paths, overwrite=overwrite)
    staging = f"{root}/_staging/landed-{uuid.uuid4().hex}"
    seen = Observation("landed rows")
    try:
        rows = landing_checks.with_variant(typed_requests(read_landed(spark, landing)))
        rows.observe(seen, *landing_checks.gate_counters(scope, rows.columns), *landing_checks.observation_counters(),
                     *landing_checks.key_presence()).drop("variant").write.mode("errorifexists").parquet(staging)
        return _store(spark, spark.read.parquet(staging), seen.get, scope, paths, preflight, postflight, source, authority_path, started,
                      preflight_at or handed_over, postflight_at or handed_over, report_root)
    finally:
        runs.discard_folder(spark, staging)


def _store(spark: SparkSession, landed: DataFrame, seen: dict[str, int], scope: Scope, paths: runs.RunPaths, preflight: int, postflight: int,
           source: str, authority_path: str, started: datetime, counted_before: datetime, counted_after: datetime,
           report_root: str | None) -> runs.RunPaths:
    reject_broken_pages(landed)
    digest = paths.run_id.rsplit("_", 1)[1]
    counts = one_row(spark, {**seen, "objects": seen["n"]})
    gates = landing_checks.gates_of(counts, landed.columns, expected=preflight, postflight=postflight, query_hash=digest)
    landing_checks.enforce_gates(gates)
    observed = counts.select("missing_due_dates", "missing_closed_dates", "invalid_timestamp_chronology_rows")
    observations = landing_checks.extraction_observations(landed, observed)
    warnings = [f"{r['observed_value']} {r['check_name']}" for r in observations.where("status = 'WARN'").collect()]
    presence = landing_checks.presence_of(counts)
    absent = [r["column_name"] for r in landing_checks.never_present_of(presence).collect()]
    warnings += [f"never present: {', '.join(absent)}"] if absent else []
    pages = landing_checks.page_summary(landed)
    page_size = pages.agg(F.max("requested_limit")).first()[0]

    def manifest_of(stored: DataFrame) -> DataFrame:
        return runs.build_manifest(
            stored, pages, scope, paths, expected=preflight, started_at=started,
            completed_at=datetime.now(timezone.utc), query_hash=digest, source=source,
            authority_path=authority_path, warnings=warnings, page_size=page_size,
            counted_before=counted_before, counted_after=counted_after)

    text = f"agency = {scope.agency}; type = {scope.complaint_type}; created {scope.start} to {scope.end}"
    runs.write_run(landed.select(*RAW_COLUMNS, ROW_ID, ROW_PLACE), manifest_of, text, paths)
    if report_root:
        checks = gates.unionByName(observations.withColumn("expected_value", F.lit("reported, not modified")))
        write_tables({
            "page_summary": pages, "extraction_validation": checks, "column_presence": presence,
            "count_reconciliation": landing_checks.reconciliation_of(counts.select(F.col("n").alias("retrieved")), preflight, postflight),
        }, ("page_summary", "extraction_validation"), report_root)
    return paths


def reject_broken_pages(landed: DataFrame) -> None:
    """Oversized, repeated, unordered or discontinuous pages end the ingestion."""
    findings = {
        "oversized pages": landing_checks.oversized_pages(landed),
        "repeated pages": landing_checks.repeated_pages(landed),
        "unstable page order": landing_checks.unstable_order(landed),
        "discontinuous pages": landing_checks.page_continuity(landed).where("NOT is_continuous"),
    }
    found = [name for name, df in findings.items() if not df.isEmpty()]
    if found:
        raise landing_checks.ExtractionRejected("Landed pages failed: " + ", ".join(found))
