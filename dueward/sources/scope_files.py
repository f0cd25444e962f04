"""The selected-scope authority: two one-row CSV tables that must agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from dueward.config import Scope

# Required fields and the statuses that may be ingested.
AUTHORITY_FIELDS = (
    "decision_status", "selected_agency", "selected_complaint_type", "selected_start_date",
    "selected_end_date", "extraction_timestamp",
)
METADATA_FIELDS = ("source", "dataset_identifier", "extraction_timestamp")
APPROVED_STATUSES = ("APPROVED", "APPROVED_WITH_LIMITATIONS")


class ScopeRejected(ValueError):
    """The scope authority is missing, contradictory or not approved."""


def _only_row(table: DataFrame, fields: Sequence[str], what: str) -> dict[str, str]:
    rows = table.limit(2).collect()
    if len(rows) != 1:
        raise ScopeRejected(f"{what}: one row was expected, {len(rows)} or more were found.")
    values = {k: ("" if v is None else str(v).strip()) for k, v in rows[0].asDict().items()}
    blank = [f for f in fields if not values.get(f)]
    if blank:
        raise ScopeRejected(f"{what} requires {blank}.")
    return values


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def scope_from_tables(authority: DataFrame, metadata: DataFrame) -> Scope:
    row = _only_row(authority, AUTHORITY_FIELDS, "Selected-scope authority")
    extra = _only_row(metadata, METADATA_FIELDS, "Extraction metadata")
    for field, chosen in (("agency", row["selected_agency"]), ("complaint_type", row["selected_complaint_type"])):
        if field in extra and extra[field] != chosen:
            raise ScopeRejected(f"Extraction metadata {field} disagrees with the scope authority.")
    try:
        Scope.of("-", "-", row["selected_start_date"], row["selected_end_date"], extra["extraction_timestamp"])
        return Scope.of(
            row["selected_agency"], row["selected_complaint_type"], row["selected_start_date"],
            row["selected_end_date"], row["extraction_timestamp"], row["decision_status"])
    except ValueError as error:
        raise ScopeRejected(str(error)) from error


def read_scope(spark: SparkSession, authority_path: str, metadata_path: str) -> Scope:
    return scope_from_tables(_csv(spark, authority_path), _csv(spark, metadata_path))


def approved(scope: Scope, statuses: Sequence[str] = APPROVED_STATUSES) -> Scope:
    """Only an approved scope may be ingested."""
    if scope.decision_status not in statuses:
        raise ScopeRejected(f"{scope.decision_status!r} does not allow an ingestion.")
    return scope
