"""Provisional target readiness: governed flags, with a wider conflict test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueward.config import MATERIAL_COLUMNS, Scope
from dueward.functions.numbers import ratio, total
from dueward.functions.shape import rows_from
from dueward.operators.eligibility import (
    SIGNATURE_TEXTS, SIGNATURE_TIMES, split_redundant, exclusion_reason, exclusion_reasons, row_flags,
    target_eligible,
)
from dueward.operators.keyed import MISSING, key_groups, row_signature

# Rules in report order; an is_ rule passes when it is false.
READINESS_RULES = (
    "has_created_date", "has_due_date", "has_closed_date", "valid_due_chronology",
    "valid_closed_chronology", "status_allowed", "outcome_mature",
    "is_conflicting_duplicate", "candidate_target_eligible",
)
LOCAL_FLAGS = (
    "within_selected_scope", "outside_scope", "has_created_date", "has_due_date", "has_closed_date",
    "valid_due_chronology", "valid_closed_chronology", "status_allowed", "outcome_mature",
)


def readiness_cube(typed: DataFrame, scope: Scope) -> DataFrame:
    """Row counts per flag combination; statuses without a policy count as excluded.

    A group conflicts when the six parsed target inputs differ or any of the
    nine raw material columns does. Rows are flagged by key after counting, so
    no row-level join takes place.
    """
    flagged = row_flags(typed, scope, on_unknown="exclude")
    raw_parts = [F.coalesce(F.col(c), F.lit(MISSING)) for c in MATERIAL_COLUMNS]
    groups = key_groups(flagged, LOCAL_FLAGS, {
        "target_conflict": row_signature(SIGNATURE_TIMES, SIGNATURE_TEXTS),
        "material_conflict": (F.xxhash64(*raw_parts), F.xxhash64(F.lit(1), *raw_parts)),
    })
    cube = split_redundant(groups, "target_conflict").groupBy(
        *LOCAL_FLAGS, "is_exact_duplicate", "target_conflict", "material_conflict"
    ).agg(total("rows").alias("rows"))
    governed = cube.withColumn("target_eligible", target_eligible("target_conflict"))
    newly = F.col("material_conflict") & F.col("target_eligible")
    return governed.withColumns({
        "is_conflicting_duplicate": F.col("target_conflict") | F.col("material_conflict"),
        "candidate_target_eligible": F.col("target_eligible") & ~F.col("material_conflict"),
        "candidate_exclusion_reason": F.when(newly, "conflicting_duplicate_unique_key").otherwise(
            exclusion_reason("target_conflict")),
    })


def target_readiness(cube: DataFrame) -> DataFrame:
    one = cube.agg(total("rows").alias("all_rows"), *[
        total(F.when(F.col(r), F.col("rows"))).alias(r) for r in READINESS_RULES])
    rows = []
    for r in READINESS_RULES:
        true, false = F.col(r), F.col("all_rows") - F.col(r)
        passed, failed = (false, true) if r.startswith("is_") else (true, false)
        rows.append({"readiness_rule": r, "true_count": true, "false_count": false, "pass_count": passed,
                     "fail_count": failed, "pass_rate": ratio(passed, F.col("all_rows")), "provisional": True})
    return rows_from(one, rows)


def candidate_exclusions(cube: DataFrame) -> DataFrame:
    return exclusion_reasons(cube, "candidate_exclusion_reason")
