"""Governed eligibility: flags, one exclusion reason and a nullable label per row."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueward.config import ALLOWED_STATUSES, EXCLUDED_STATUSES, EXCLUSION_ORDER, Scope
from dueward.functions.numbers import holds, ratio, total
from dueward.functions.shape import rows_from, whole_table
from dueward.functions.text import fold
from dueward.functions.time import at, in_days
from dueward.operators.keyed import (
    KEY, attach_key_facts, differs, key_groups, repeated_keys, row_signature, text_hash,
)
from dueward.schemas import ROW_ID, require_columns

NEEDED = ("unique_key", "created_ts", "due_ts", "closed_ts", "agency", "complaint_type", "status")
SIGNATURE_TIMES = ("created_ts", "due_ts", "closed_ts")
SIGNATURE_TEXTS = ("agency", "complaint_type", "status")
TARGET = "missed_resolution_target"

# Order of the rule table; an is_ rule passes when it is false.
RULES = (
    "within_selected_scope", "has_created_date", "has_due_date", "has_closed_date",
    "valid_due_chronology", "valid_closed_chronology", "status_allowed",
    "is_exact_duplicate", "is_conflicting_duplicate", "outcome_mature", "target_eligible",
)
ROW_FLAGS = (
    "within_selected_scope", "has_created_date", "has_due_date", "has_closed_date",
    "valid_due_chronology", "valid_closed_chronology", "status_normalized", "status_allowed",
    "is_cancelled", "is_open", "status_closed_date_inconsistent", "outcome_mature",
    "outside_scope", "closed_late",
)
KEY_FLAGS = ("is_exact_duplicate", "is_conflicting_duplicate")


def status_policy(allowed: Iterable[str] | None = None, excluded: Iterable[str] | None = None):
    """Normalised allowed and excluded statuses, which must not overlap."""
    allow = {s.strip().lower() for s in (ALLOWED_STATUSES if allowed is None else allowed)}
    deny = {s.strip().lower() for s in (EXCLUDED_STATUSES if excluded is None else excluded)}
    if allow & deny:
        raise ValueError(f"Allowed and excluded statuses overlap: {sorted(allow & deny)}")
    return sorted(allow), sorted(deny)


def unrecognized_statuses(typed: DataFrame, allowed=None, excluded=None) -> DataFrame:
    """Normalised statuses no policy names."""
    allow, deny = status_policy(allowed, excluded)
    status = fold(F.col("status"))
    return typed.select(status.alias("status")).where(
        F.col("status").isNotNull() & ~F.col("status").isin(allow + deny)
    ).distinct()


def row_flags(typed: DataFrame, scope: Scope, *, allowed=None, excluded=None, on_unknown: str = "error") -> DataFrame:
    """Flags that depend on one row alone.

    ``on_unknown`` says what a status outside the policy does: ``error`` fails
    the job, ``exclude`` treats it as not allowed.
    """
    require_columns(typed.columns, NEEDED, "Target eligibility")
    if scope.start >= scope.end:
        raise ValueError("The scope holds no day: its start is not before its end.")
    if scope.complaint_type is None:
        raise ValueError("Governed eligibility needs one complaint type.")
    allow, deny = status_policy(allowed, excluded)
    status = fold(F.col("status"))
    if on_unknown == "error":
        status = F.when(status.isNull() | status.isin(allow + deny), status).otherwise(
            F.raise_error(F.concat(F.lit("Status needs a policy: "), status)).cast("string")
        )
    created, due, closed = F.col("created_ts"), F.col("due_ts"), F.col("closed_ts")
    agency_match = holds(F.col("agency") == scope.agency)
    type_match = holds(F.col("complaint_type") == scope.complaint_type)
    within = agency_match & type_match & holds(in_days(created, scope.start, scope.end_exclusive))
    is_closed = holds(F.col("status_normalized") == "closed")
    return (
        typed.withColumn("status_normalized", status)
        .withColumns({
            "within_selected_scope": within,
            # A missing creation time alone does not place a matching row outside.
            "outside_scope": ~within & (~agency_match | ~type_match | created.isNotNull()),
            "has_created_date": created.isNotNull(),
            "has_due_date": due.isNotNull(),
            "has_closed_date": closed.isNotNull(),
            "valid_due_chronology": ~holds(due < created),
            "valid_closed_chronology": ~holds(closed < created),
            "status_allowed": holds(F.col("status_normalized").isin(allow)),
            "is_cancelled": holds(F.col("status_normalized") == "cancelled"),
            "is_open": closed.isNull() | ~is_closed,
            "status_closed_date_inconsistent": is_closed != closed.isNotNull(),
            "outcome_mature": holds(due <= at(scope.extracted_at)),
            "closed_late": holds(closed > due),
        })
    )


def target_eligible(conflict: str = "is_conflicting_duplicate") -> Column:
    wanted = [F.col(c) for c in (
        "within_selected_scope", "has_created_date", "has_due_date", "has_closed_date",
        "valid_due_chronology", "valid_closed_chronology", "status_allowed", "outcome_mature",
    )] + [~F.col("is_exact_duplicate"), ~F.col(conflict)]
    return reduce(and_, wanted)


def exclusion_reason(conflict: str = "is_conflicting_duplicate") -> Column:
    """The first reason in policy order that applies, or ``eligible``."""
    applies = {
        "outside_selected_scope": F.col("outside_scope"),
        "missing_created_date": ~F.col("has_created_date"),
        "missing_due_date": ~F.col("has_due_date"),
        "missing_closed_date": ~F.col("has_closed_date"),
        "due_before_created": ~F.col("valid_due_chronology"),
        "closed_before_created": ~F.col("valid_closed_chronology"),
        "excluded_status": ~F.col("status_allowed"),
        "conflicting_duplicate_unique_key": F.col(conflict),
        "exact_duplicate_unique_key": F.col("is_exact_duplicate"),
        "outcome_not_mature": ~F.col("outcome_mature"),
    }
    found = [F.when(applies[reason], F.lit(reason)) for reason in EXCLUSION_ORDER]
    return F.coalesce(*found, F.lit("eligible"))


def missed_target(eligible: Column, late: Column) -> Column:
    """1 late, 0 on or before due, NULL when not eligible."""
    return F.when(eligible, late.cast("int")).cast("byte")


def target_key_facts(typed: DataFrame) -> DataFrame:
    """Per repeated key: does any of the six target inputs differ, and which row stands for the group."""
    first, second = row_signature(SIGNATURE_TIMES, SIGNATURE_TEXTS)
    prepared = typed.select(KEY, ROW_ID, first.alias("_s1"), second.alias("_s2"))
    return repeated_keys(prepared, {"conflicting": differs("_s1") | differs("_s2")}, canonical=True)


def evaluate_eligibility(typed: DataFrame, scope: Scope, *, allowed=None, excluded=None,
                         on_unknown: str = "error") -> DataFrame:
    """Every input row with its flags, reason and label; no row is dropped or changed."""
    flagged = row_flags(typed, scope, allowed=allowed, excluded=excluded, on_unknown=on_unknown)
    joined = attach_key_facts(flagged, target_key_facts(typed))
    conflict = holds(F.col("key_facts.conflicting"))
    redundant = holds(~F.col("key_facts.conflicting") & (F.col(ROW_ID) != F.col("key_facts.canonical_id")))
    return (
        joined.withColumn("is_conflicting_duplicate", conflict)
        .withColumn("is_exact_duplicate", redundant)
        .drop("key_facts")
        .withColumn("target_eligible", target_eligible())
        .withColumn("primary_exclusion_reason", exclusion_reason())
        .withColumn(TARGET, missed_target(F.col("target_eligible"), F.col("closed_late")))
    )


def build_target(df: DataFrame, eligibility_column: str = "target_eligible") -> DataFrame:
    """Add the label to rows that already carry an eligibility flag.

    An eligible row without both typed dates fails the job.
    """
    require_columns(df.columns, (eligibility_column, "closed_ts", "due_ts"), "Target construction")
    eligible = holds(F.col(eligibility_column))
    late = F.when(
        F.col("closed_ts").isNull() | F.col("due_ts").isNull(),
        F.raise_error(F.lit("Eligible rows need a readable closed_date and due_date.")).cast("boolean"),
    ).otherwise(F.col("closed_ts") > F.col("due_ts"))
    return df.withColumn(TARGET, missed_target(eligible, late))


def invariant_violations(governed: DataFrame) -> DataFrame:
    """Three counts that must be zero: flag against reason, NULL keys and repeated keys among eligible rows."""
    mismatch = F.col("target_eligible") != (F.col("primary_exclusion_reason") == "eligible")
    keys = governed.groupBy(KEY).agg(
        F.count_if(mismatch).alias("mismatch"), F.count_if("target_eligible").alias("eligible")
    )
    return keys.agg(
        total("mismatch").alias("flag_reason_mismatch"),
        total(F.when(F.col(KEY).isNull(), F.col("eligible"))).alias("eligible_null_keys"),
        F.count_if(F.col(KEY).isNotNull() & (F.col("eligible") > 1)).alias("eligible_repeated_keys"),
    )


# ---- the governed cube ------------------------------------------------------

def split_redundant(groups: DataFrame, conflict: str) -> DataFrame:
    """Turn a group of equal rows into its one canonical row and the redundant rest."""
    redundant = F.col(KEY).isNotNull() & ~F.col(conflict) & (F.col("key_rows") > 1)
    parts = F.when(redundant, F.array(
        F.struct(F.lit(1).cast("bigint").alias("rows"), F.lit(False).alias("is_exact_duplicate")),
        F.struct((F.col("rows") - 1).alias("rows"), F.lit(True).alias("is_exact_duplicate")),
    )).otherwise(F.array(F.struct("rows", F.lit(False).alias("is_exact_duplicate"))))
    kept = [c for c in groups.columns if c != "rows"]
    return groups.select(*kept, F.inline(parts))


def eligibility_cube(typed: DataFrame, scope: Scope, *, allowed=None, excluded=None,
                     on_unknown: str = "error") -> DataFrame:
    """Row counts per combination of flags, status and reason.

    Equal target inputs mean equal flags, so no row-level join is needed: the
    rows are counted by (key, flags), resolved per key, and counted again. The
    result has a few hundred rows at any scale and feeds every summary table.
    """
    flagged = row_flags(typed, scope, allowed=allowed, excluded=excluded, on_unknown=on_unknown)
    groups = key_groups(flagged, ROW_FLAGS, {
        "is_conflicting_duplicate": row_signature(SIGNATURE_TIMES, SIGNATURE_TEXTS),
    })
    split = split_redundant(groups, "is_conflicting_duplicate")
    cube = split.groupBy(*ROW_FLAGS, *KEY_FLAGS).agg(total("rows").alias("rows"))
    return (
        cube.withColumn("target_eligible", target_eligible())
        .withColumn("primary_exclusion_reason", exclusion_reason())
        .withColumn(TARGET, missed_target(F.col("target_eligible"), F.col("closed_late")))
    )


def _count(condition: Column) -> Column:
    return total(F.when(condition, F.col("rows")))


def target_summary(cube: DataFrame, scope: Scope) -> DataFrame:
    """One row of headline counts; an empty eligible population fails the job."""
    eligible, missed = F.col("target_eligible_rows"), F.col("missed_count")
    base = cube.agg(
        total("rows").alias("total_selected_rows"),
        _count(F.col("target_eligible")).alias("target_eligible_rows"),
        _count(F.col(TARGET) == 1).alias("missed_count"),
        _count(F.col(TARGET) == 0).alias("on_time_count"),
        _count(F.col("is_open")).alias("open_count"),
        _count(F.col("is_cancelled")).alias("cancelled_count"),
        _count(F.col("is_exact_duplicate")).alias("exact_duplicate_count"),
        _count(F.col("is_conflicting_duplicate")).alias("conflicting_duplicate_count"),
        _count(~F.col("valid_due_chronology")).alias("invalid_due_chronology_count"),
        _count(~F.col("valid_closed_chronology")).alias("invalid_closed_chronology_count"),
        _count(F.col("has_due_date") & ~F.col("outcome_mature")).alias("outcome_immature_count"),
    )
    checked = F.when(eligible > 0, eligible).otherwise(
        F.raise_error(F.lit("No eligible rows in the selected scope.")).cast("bigint")
    )
    return base.select(
        F.lit(scope.agency).alias("selected_agency"),
        F.lit(scope.complaint_type).alias("selected_complaint_type"),
        F.lit(scope.start.isoformat()).alias("selected_start_date"),
        F.lit(scope.end.isoformat()).alias("selected_end_date"),
        F.lit(scope.extracted_at.isoformat()).alias("extraction_timestamp"),
        "total_selected_rows",
        checked.alias("target_eligible_rows"),
        (F.col("total_selected_rows") - eligible).alias("target_ineligible_rows"),
        ratio(eligible, F.col("total_selected_rows")).alias("eligibility_rate"),
        "missed_count", "on_time_count",
        ratio(missed, eligible).alias("missed_target_rate"),
        "open_count", "cancelled_count", "exact_duplicate_count", "conflicting_duplicate_count",
        "invalid_due_chronology_count", "invalid_closed_chronology_count", "outcome_immature_count",
    )


def target_distribution(cube: DataFrame) -> DataFrame:
    one = cube.agg(
        _count(F.col(TARGET) == 0).alias("on_time"), _count(F.col(TARGET) == 1).alias("missed")
    )
    both = F.col("on_time") + F.col("missed")
    return rows_from(one, [
        {"target_value": value, "target_label": label, "row_count": F.col(label),
         "row_share": ratio(F.col(label), both)}
        for value, label in ((0, "on_time"), (1, "missed"))
    ])


def rule_pass_counts(cube: DataFrame) -> DataFrame:
    one = cube.agg(total("rows").alias("all_rows"), *[
        _count(~F.col(r) if r.startswith("is_") else F.col(r)).alias(r) for r in RULES
    ])
    return rows_from(one, [
        {"rule_name": r, "pass_count": F.col(r), "fail_count": F.col("all_rows") - F.col(r),
         "pass_rate": ratio(F.col(r), F.col("all_rows"))}
        for r in RULES
    ])


def exclusion_reasons(cube: DataFrame, reason: str = "primary_exclusion_reason") -> DataFrame:
    """Rows per reason and their share; the shares sum to one."""
    counts = cube.groupBy(reason).agg(total("rows").alias("row_count"))
    # At most eleven rows reach this window.
    return counts.withColumn("row_share", ratio(F.col("row_count"), F.sum("row_count").over(whole_table())))


def status_analysis(cube: DataFrame) -> DataFrame:
    """Coverage, maturity and treatment per normalised status."""
    grouped = cube.groupBy("status_normalized").agg(
        total("rows").alias("row_count"),
        _count(F.col("has_created_date")).alias("created"),
        _count(F.col("has_due_date")).alias("due"),
        _count(F.col("has_closed_date")).alias("closed"),
        _count(F.col("outcome_mature")).alias("outcome_mature_count"),
        _count(F.col("target_eligible")).alias("target_eligible_count"),
    )
    status = F.coalesce("status_normalized", F.lit("<MISSING>"))
    # Treatment texts.
    treatment = (
        F.when(status.isin(list(ALLOWED_STATUSES)), "include when all other rules pass")
        .when(status.isin(list(EXCLUDED_STATUSES)), "exclude")
        .otherwise("exclude pending governance review")
    )
    rows = F.col("row_count")
    return grouped.select(
        status.alias("status"), "row_count",
        ratio(rows, F.sum("row_count").over(whole_table())).alias("row_share"),
        ratio(F.col("created"), rows).alias("created_date_coverage"),
        ratio(F.col("due"), rows).alias("due_date_coverage"),
        ratio(F.col("closed"), rows).alias("closed_date_coverage"),
        "outcome_mature_count", "target_eligible_count",
        treatment.alias("proposed_treatment"), treatment.alias("final_treatment"),
    )


def timestamp_violations(cube: DataFrame) -> DataFrame:
    one = cube.agg(
        _count(~F.col("valid_due_chronology")).alias("due_before_created"),
        _count(~F.col("valid_closed_chronology")).alias("closed_before_created"),
        _count(F.col("status_closed_date_inconsistent")).alias("status_closed_date_inconsistent"),
    )
    return rows_from(one, [{"violation": c, "row_count": F.col(c)} for c in one.columns])


def maturity_summary(cube: DataFrame) -> DataFrame:
    one = cube.agg(
        total("rows").alias("all_rows"),
        _count(F.col("outcome_mature")).alias("mature"),
        _count(F.col("has_due_date") & ~F.col("outcome_mature")).alias("not_mature"),
        _count(~F.col("has_due_date")).alias("missing_due_date"),
        _count(F.col("outcome_mature") & F.col("is_open")).alias("mature_open"),
    )
    return rows_from(one, [
        {"outcome_maturity": c, "row_count": F.col(c), "row_share": ratio(F.col(c), F.col("all_rows"))}
        for c in ("mature", "not_mature", "missing_due_date", "mature_open")
    ])


def open_breakdown(cube: DataFrame) -> DataFrame:
    keys = ("status_normalized", "outcome_mature", "primary_exclusion_reason")
    return cube.where(F.col("is_open") & F.col("status_normalized").isNotNull()).groupBy(*keys).agg(
        total("rows").alias("row_count"))


def cancelled_breakdown(cube: DataFrame) -> DataFrame:
    keys = ("status_normalized", "has_closed_date", "primary_exclusion_reason")
    return cube.where(F.col("is_cancelled")).groupBy(*keys).agg(total("rows").alias("row_count"))


# ---- duplicate tables of the label step -------------------------------------

def duplicate_overview(typed: DataFrame) -> DataFrame:
    """Group and row counts of repeated keys under the six-column signature."""
    first, second = row_signature(SIGNATURE_TIMES, SIGNATURE_TEXTS)
    facts = repeated_keys(
        typed.select(KEY, first.alias("_s1"), second.alias("_s2")),
        {"conflicting": differs("_s1") | differs("_s2")},
    )
    rows, conflict = F.col("group_rows"), F.col("conflicting")
    one = facts.agg(
        F.count(F.lit(1)).alias("duplicate_unique_key_groups"),
        total("group_rows").alias("rows_in_duplicate_groups"),
        total(F.when(~conflict, rows - 1)).alias("redundant_exact_duplicate_rows"),
        F.count_if(conflict).alias("conflicting_duplicate_groups"),
        total(F.when(conflict, rows)).alias("rows_in_conflicting_groups"),
    )
    return rows_from(one, [{"metric": c, "row_count": F.col(c)} for c in one.columns])


def _target_conflicts(typed: DataFrame) -> DataFrame:
    """Repeated keys with the target inputs that differ, compared after parsing."""
    names = ("created_date", "due_date", "closed_date", "agency", "complaint_type", "status")
    columns = [F.coalesce(F.unix_micros(F.col(t)), F.lit(-(2**63) + 1)) for t in SIGNATURE_TIMES]
    columns += [text_hash(t) for t in SIGNATURE_TEXTS]
    prepared = typed.select(KEY, *[c.alias(f"_{n}") for n, c in zip(names, columns)])
    facts = repeated_keys(prepared, {n: differs(f"_{n}") for n in names})
    changed = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
    return facts.select(KEY, "group_rows", F.array_join(changed, "|").alias("conflicting_fields"))


def exact_duplicate_summary(typed: DataFrame) -> DataFrame:
    facts = _target_conflicts(typed).where(F.col("conflicting_fields") == "")
    return facts.select(KEY, (F.col("group_rows") - 1).alias("redundant_row_count"))


def conflicting_duplicate_summary(typed: DataFrame) -> DataFrame:
    facts = _target_conflicts(typed).where(F.col("conflicting_fields") != "")
    return facts.select(KEY, F.col("group_rows").alias("row_count"), "conflicting_fields")


def conflicting_records(governed: DataFrame) -> DataFrame:
    """Rows of conflicting groups with their target inputs and reason."""
    return governed.where("is_conflicting_duplicate").select(
        KEY, "created_ts", "due_ts", "closed_ts", "agency", "complaint_type", "status",
        "primary_exclusion_reason",
    )
