"""Every validation finding as one severity-ranked check, the verdict and proposed actions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueward.config import ALLOWED_STATUSES, DATASET_ID, EXCLUDED_STATUSES, SEVERITY_RANK, Scope, ValidationRules
from dueward.functions.numbers import holds, ratio, total
from dueward.functions.shape import rows_from
from dueward.functions.text import comparison_form
from dueward.operators import geography
from dueward.operators.categories import variant_totals
from dueward.operators.evidence import Evidence, value_counts
from dueward.operators.keyed import KEY
from dueward.operators.profile import CHRONOLOGY_RULES, missing_policy, scope_counters
from dueward.operators.silver import stored_names
from dueward.schemas import CHECK_COLUMNS, RAW_COLUMNS

# Check ids, severities and action texts below are fixed values of the report contract.
OPTIONAL_CHRONOLOGY = ("closed_present_created_invalid", "due_present_created_invalid")
TYPES = {"observed_value": "string", "expected_value": "string"}


def check(check_id: str, area: str, name: str, severity, passed, observed, expected, affected, rows: Column,
          message: str, action) -> dict[str, object]:
    """One raw check record; :func:`finished` turns its outcome into a status and a rate."""
    return {
        "check_id": check_id, "area": area, "check_name": name, "severity": severity, "passed": passed,
        "observed_value": observed, "expected_value": expected, "affected_rows": affected, "all_rows": rows,
        "message": message, "recommended_step_7_action": action,
    }


def finished(records: DataFrame) -> DataFrame:
    """A failed CRITICAL or ERROR is FAIL, a failed WARNING is WARN, a failed INFO is INFO."""
    severity = F.col("severity")
    status = (
        F.when(F.col("passed"), "PASS").when(severity.isin("CRITICAL", "ERROR"), "FAIL")
        .when(severity == "WARNING", "WARN").otherwise("INFO")
    )
    return records.withColumns({
        "status": status, "affected_rows": F.col("affected_rows").cast("bigint"),
        "affected_rate": ratio(F.col("affected_rows"), F.col("all_rows")),
    }).select(*CHECK_COLUMNS)


def check_rows(one_row: DataFrame, records: Sequence[Mapping[str, object]]) -> DataFrame:
    return finished(rows_from(one_row, records, TYPES))


def _title(name: str) -> str:
    return name.replace("_", " ").title()


def zero_check(check_id, area, name, severity, count: Column, rows: Column, message, action) -> dict[str, object]:
    return check(check_id, area, name, severity, count == 0, count, "0", count, rows, message, action)


def schema_checks(df_columns: Sequence[str], key_is_text: bool, rows: Column, expected_rows: int,
                  required: Sequence[str] = RAW_COLUMNS, selected: Sequence[str] = RAW_COLUMNS,
                  landed_header: Sequence[str] | None = None, require_order: bool = True) -> list[dict]:
    """Eight structural checks; repeated names are judged on the landed header."""
    header = list(landed_header or df_columns)
    actual = list(df_columns)
    repeated = sorted({c for c in header if header.count(c) > 1})
    missing = [c for c in required if c not in actual]
    extra = [c for c in actual if c not in required]
    in_order = actual == list(selected)
    listing, wanted = "|".join(actual), "|".join(selected)
    return [
        check("schema.non_empty", "schema", "Non-empty dataset", "CRITICAL", rows > 0, rows, "> 0",
              F.when(rows > 0, 0).otherwise(1), rows, "A raw run holds at least one record.",
              "Re-run or investigate Step 5 extraction."),
        check("schema.unique_column_names", "schema", "Unique column names", "CRITICAL", not repeated,
              "|".join(repeated) or "none", "none", len(repeated), rows, "Raw column names do not repeat.",
              "Correct the ingestion schema before cleaning."),
        check("schema.required_columns", "schema", "Required source columns", "CRITICAL", not missing,
              "|".join(missing) or "none", "none missing", len(missing), rows, "Every governed source field is stored.",
              "Reconcile source schema and ingestion selection."),
        check("schema.metadata_columns", "schema", "Stored columns match metadata", "CRITICAL",
              set(actual) == set(selected), listing, wanted, len(set(actual) ^ set(selected)), rows,
              "Stored fields equal the fields the manifest selected.",
              "Treat the raw run as inconsistent and re-ingest."),
        check("schema.column_order", "schema", "Column order matches metadata", "ERROR",
              in_order or not require_order, listing, wanted, 0 if in_order else 1, rows,
              "Stored order equals the configured order.", "Preserve configured order during Step 7 reads."),
        check("schema.unexpected_columns", "schema", "Unexpected source columns", "WARNING", not extra,
              "|".join(extra) or "none", "none", len(extra), rows, "A new source field may mean schema drift.",
              "Review new fields before any cleaning or feature use."),
        check("schema.metadata_row_count", "schema", "Row count matches metadata", "CRITICAL",
              rows == expected_rows, rows, str(expected_rows), F.abs(rows - expected_rows), rows,
              "Stored rows reconcile to the manifest.", "Reject the inconsistent raw run and re-ingest."),
        check("schema.identifier_representation", "schema", "Identifier represented as string", "ERROR",
              key_is_text, "string" if key_is_text else "not text", "string or object preserving source digits",
              F.lit(0) if key_is_text else rows, rows, "Identifiers are stored as text, not as numbers.",
              "Preserve the source identifier as a string in Step 7."),
    ]


def manifest_scope_checks(manifest: Mapping[str, object], scope: Scope, rows: Column,
                          authority_path: str | None = None, dataset_id: str = DATASET_ID) -> list[dict]:
    """The manifest against the scope authority, and the dataset it came from."""
    pairs = {
        "agency": (manifest.get("selected_agency"), scope.agency),
        "complaint_type": (manifest.get("selected_complaint_type"), scope.complaint_type),
        "start_date": (manifest.get("selected_start_date"), scope.start.isoformat()),
        "end_date": (manifest.get("selected_end_date"), scope.end.isoformat()),
    }
    if authority_path is not None:
        pairs["authority_path"] = (manifest.get("scope_authority_path"), authority_path)
    found = [
        check(f"metadata_scope.{name}", "metadata", f"Metadata scope {name}", "CRITICAL", seen == wanted,
              seen, wanted, F.lit(0) if seen == wanted else rows, rows,
              "The manifest agrees with the scope authority.",
              "Stop downstream work and create a new governed ingestion run.")
        for name, (seen, wanted) in pairs.items()
    ]
    seen = manifest.get("dataset_id")
    return found + [check(
        "metadata.dataset_id", "metadata", "Expected dataset ID", "CRITICAL", seen == dataset_id, seen, dataset_id,
        F.lit(0) if seen == dataset_id else rows, rows, "The run comes from the configured dataset.",
        "Reject the raw run and re-ingest from the expected dataset.")]


def _key_is_text(df: DataFrame) -> bool:
    return KEY in df.columns and df.schema[KEY].dataType.simpleString() == "string"


def schema_check_table(raw: DataFrame, expected_rows: int, columns: Sequence[str] = RAW_COLUMNS,
                       selected: Sequence[str] | None = None) -> DataFrame:
    """The eight structural checks of a table as it is stored; ``selected`` is the manifest's list of columns."""
    one = raw.agg(F.count(F.lit(1)).alias("all_rows"))
    return check_rows(one, schema_checks(
        stored_names(raw), _key_is_text(raw), F.col("all_rows"), expected_rows, columns, selected or columns))


def validation_checks(found: Evidence, scope: Scope, manifest: Mapping[str, object], *,
                      rules: ValidationRules = ValidationRules(), columns: Sequence[str] = RAW_COLUMNS,
                      authority_path: str | None = None, unchanged: bool | None = None,
                      landed_header: Sequence[str] | None = None, stored: Sequence[str] | None = None) -> DataFrame:
    """The whole check table from gathered evidence; no row is read.

    ``stored`` names the columns as the run holds them; absent ones were counted as NULLs.
    ``unchanged`` adds the raw-immutability check once a second fingerprint exists.
    """
    rows = F.col("all_rows")
    stored = list(stored_names(found.rows) if stored is None else stored)
    is_text = KEY in stored and _key_is_text(found.rows)
    one = found.counters
    records = manifest_scope_checks(manifest, scope, rows, authority_path)
    records += schema_checks(stored, is_text, rows, int(manifest["retrieved_row_count"]), columns,
                             manifest.get("selected_source_columns") or columns, landed_header=landed_header)
    for name in scope_counters(scope):
        records.append(zero_check(
            f"scope.{name}", "scope", _title(name), "CRITICAL", F.col(f"scope__{name}"), rows,
            "Records match the authoritative scope.",
            "Reject or re-ingest the raw run; do not clean across scope boundaries."))
    for c in columns:
        severity, action = missing_policy(c, F.col(f"{c}__null"))
        records.append(zero_check(
            f"missingness.{c}", "missingness", f"Missing {c}", severity, F.col(f"{c}__null"), rows,
            f"Nulls of {c} were measured and kept.", action))
        sentinels = F.col(f"{c}__empty") + F.col(f"{c}__blank") + F.col(f"{c}__null_like")
        records.append(zero_check(
            f"null_like.{c}", "category", f"Blank or null-like {c}", "WARNING", sentinels, rows,
            "Text sentinels are kept apart from nulls.",
            "Review and map only approved null-equivalent values in Step 7."))
    for c in rules.timestamp_columns:
        records.append(zero_check(
            f"timestamp.{c}", "timestamp", f"Parseable {c}", "CRITICAL" if c == "created_date" else "ERROR",
            F.col(f"ts__{c}"), rows, "Present timestamps can be read as UTC.",
            "Quarantine invalid timestamp rows; do not guess or overwrite values."))
    for f, m, severity in geography.METRICS:
        if m != "parseable":
            records.append(zero_check(
                f"geography.{f}.{m}", "geography", f"{f} {m}", severity, F.col(f"geo__{f}__{m}"), rows,
                "Geographic quality was measured, not corrected.",
                "Preserve complaint and apply an approved feature-level policy in Step 7."))
    if unchanged is not None:
        records.append(check(
            "boundary.raw_immutable", "boundary", "Raw file immutable", "CRITICAL", unchanged,
            "unchanged" if unchanged else "changed", "unchanged", F.lit(0) if unchanged else rows, rows,
            "Validation leaves the raw run as it was.",
            "Restore or recreate the immutable raw run before proceeding."))
    tables = [check_rows(one, records), _key_checks(found.keys), _value_checks(value_counts(found.cells, rules.category_columns))]
    result = tables[0]
    for t in tables[1:]:
        result = result.unionByName(t)
    return result.select(*CHECK_COLUMNS)


def _key_checks(one: DataFrame) -> DataFrame:
    """Duplicate and chronology checks, both of which count keys, from the key totals."""
    rows = F.col("all_rows")
    records = [
        zero_check(f"duplicate.{m}", "duplicate", _title(m), severity, F.col(m), rows,
                   "Duplicates are reported and none is removed.",
                   "Apply a deterministic approved duplicate rule in Step 7.")
        for m, severity in (("missing_unique_key_rows", "CRITICAL"), ("redundant_exact_duplicate_rows", "WARNING"),
                            ("conflicting_duplicate_keys", "ERROR"))
    ]
    for n, (severity, action) in CHRONOLOGY_RULES.items():
        seen = F.col(f"{n}__rows")
        records.append(check(
            f"chronology.{n}", "chronology", _title(n), severity, seen == 0, seen, "0", F.col(f"{n}__keys"), rows,
            "Timestamps follow the governed order.",
            F.when(seen == 0, "No chronology action required.").otherwise(action)))
    optional = [f"chronology.{n}" for n in OPTIONAL_CHRONOLOGY]
    return check_rows(one, records).where(~(F.col("check_id").isin(optional) & (F.col("status") == "PASS")))


def _value_checks(counts: DataFrame) -> DataFrame:
    """Formatting variants and unexpected statuses, from one set of value counts."""
    known = list(ALLOWED_STATUSES + EXCLUDED_STATUSES)
    is_status = F.col("column_name") == "status"
    unexpected = is_status & ~holds(comparison_form(F.col("value")).isin(known))
    statuses = counts.agg(
        total(F.when(is_status, F.col("row_count"))).alias("all_rows"),
        total(F.when(unexpected, F.col("row_count"))).alias("status_rows"),
    ).withColumn("_one", F.lit(1))
    variants = variant_totals(counts).withColumn("_one", F.lit(1))
    one = statuses.join(F.broadcast(variants), "_one")
    rows = F.col("all_rows")
    return check_rows(one, [
        check("category.formatting_variants", "category", "Formatting variant groups", "WARNING",
              F.col("groups") == 0, F.col("groups"), "0", F.col("variant_rows"), rows,
              "Some values differ only in case or whitespace.",
              "Normalize only verified equivalent variants in Step 7."),
        zero_check("status.unexpected", "status", "Unexpected statuses", "ERROR", F.col("status_rows"), rows,
                   "Statuses belong to the allowed or the excluded policy.",
                   "Obtain a governance decision; do not silently map the status."),
    ])


def ordered_checks(checks: DataFrame) -> DataFrame:
    """Most severe first, then by id."""
    return checks.orderBy(severity_rank(F.col("severity")), "check_id")


def severity_rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))]), severity)


def validation_verdict(checks: DataFrame, *, fail_on_error: bool = False, fail_on_warning: bool = False) -> DataFrame:
    """Highest failed severity, findings per severity and the gate code."""
    failed = F.col("status") != "PASS"
    counts = {s: F.count_if(failed & (F.col("severity") == s)) for s in SEVERITY_RANK}
    one = checks.agg(F.count(F.lit(1)).alias("check_count"),
                     *[c.alias(f"{s.lower()}_findings") for s, c in counts.items()])
    c = F.col
    overall = (
        F.when(c("critical_findings") > 0, "CRITICAL").when(c("error_findings") > 0, "ERROR")
        .when(c("warning_findings") > 0, "WARNING").when(c("info_findings") > 0, "INFO").otherwise("PASS")
    )
    code = F.when(c("critical_findings") > 0, 2)
    if fail_on_warning:
        code = code.when((c("error_findings") > 0) | (c("warning_findings") > 0), 1)
    if fail_on_error:
        code = code.when(c("error_findings") > 0, 1)
    return one.withColumn("overall_status", overall).withColumn("gate_code", code.otherwise(0))


def proposed_actions(checks: DataFrame) -> DataFrame:
    """Recommendations for findings that touch rows; none of them changes data."""
    parts = F.split("check_id", r"\.")
    area = F.col("area")
    governed = area.isin("category", "status")
    source = (
        F.when(area.isin("missingness", "timestamp") | F.col("check_id").startswith("null_like."),
               F.element_at(parts, -1))
        .when((area == "geography") & (F.size(parts) > 2), F.element_at(parts, 2))
        .when(area == "status", "status").when(area == "duplicate", "unique_key").otherwise("")
    )
    return checks.where((F.col("status") != "PASS") & (F.col("affected_rows") > 0)).select(
        F.col("check_id").alias("issue_id"), area.alias("validation_area"), source.alias("source_column"),
        F.col("message").alias("issue_description"), "affected_rows", "severity",
        F.col("recommended_step_7_action").alias("proposed_action"),
        F.when(governed, "GOVERNANCE_REVIEW").otherwise("STEP_7_RULE").alias("action_type"),
        governed.alias("requires_governance_approval"), F.col("check_name").alias("source_rule"))
