"""Can the label be built: date coverage, the eligibility funnel and the blocker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueward.functions.numbers import ratio_or_null, share_pct
from dueward.functions.shape import rows_from, whole_table
from dueward.operators.scope import basic_eligibility
from dueward.operators.silver import TYPED

TARGET_DATES = ("created_date", "closed_date", "due_date")


def timestamp_parse_summary(typed: DataFrame, columns: Sequence[str] = TARGET_DATES) -> DataFrame:
    """Source gaps and parse failures kept apart."""
    one = typed.agg(F.count(F.lit(1)).alias("all_rows"), *[
        a for c in columns for a in (F.count(c).alias(f"{c}__raw"), F.count(TYPED[c]).alias(f"{c}__ts"))])
    rows = []
    for c in columns:
        raw, parsed = F.col(f"{c}__raw"), F.col(f"{c}__ts")
        rows.append({
            "column_name": c, "total_rows": F.col("all_rows"), "raw_non_null_count": raw,
            "raw_missing_count": F.col("all_rows") - raw, "parsed_non_null_count": parsed,
            "parsed_missing_count": F.col("all_rows") - parsed, "parse_failure_count": raw - parsed,
            "parse_failure_pct_of_raw_non_null": share_pct(raw - parsed, raw)})
    return rows_from(one, rows)


def field_coverage(typed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null share per field, dates after parsing."""
    one = typed.agg(F.count(F.lit(1)).alias("all_rows"), *[
        F.count(TYPED.get(c, c)).alias(c) for c in columns])
    return rows_from(one, [
        {"column_name": c, "total_rows": F.col("all_rows"), "non_null_count": F.col(c),
         "missing_count": F.col("all_rows") - F.col(c),
         "coverage_pct": share_pct(F.col(c), F.col("all_rows")),
         "missing_pct": share_pct(F.col("all_rows") - F.col(c), F.col("all_rows"))} for c in columns])


def eligibility_funnel(typed: DataFrame) -> DataFrame:
    created, closed, due = (F.col(TYPED[c]).isNotNull() for c in TARGET_DATES)
    one = typed.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(created).alias("has_created_date"), F.count_if(closed).alias("has_closed_date"),
        F.count_if(due).alias("has_due_date"), F.count_if(closed & due).alias("has_closed_and_due_date"),
        F.count_if(created & closed & due).alias("fully_target_eligible"))
    return rows_from(one, [
        {"metric": c, "record_count": F.col(c), "percentage_of_total": share_pct(F.col(c), F.col("total_records"))}
        for c in one.columns])


def basic_reasons(typed: DataFrame) -> DataFrame:
    """Rows per basic eligibility reason; the reasons partition the table."""
    counts = basic_eligibility(typed).groupBy("target_exclusion_reason").agg(F.count(F.lit(1)).alias("record_count"))
    return counts.withColumn("percentage_of_total", share_pct(
        F.col("record_count"), F.sum("record_count").over(whole_table())))  # five rows


def coverage_by(typed: DataFrame, key: Column, name: str) -> DataFrame:
    """Date and eligibility coverage per group, the NULL group kept."""
    created, closed, due = (F.col(TYPED[c]) for c in TARGET_DATES)
    grouped = typed.groupBy(key.alias(name)).agg(
        F.count(F.lit(1)).alias("record_count"), F.count(created).alias("created_date_count"),
        F.count(closed).alias("closed_date_count"), F.count(due).alias("due_date_count"),
        F.count_if(created.isNotNull() & closed.isNotNull() & due.isNotNull()).alias("target_eligible_count"))
    rows = F.col("record_count")
    return grouped.withColumns({
        "created_date_coverage_pct": share_pct(F.col("created_date_count"), rows),
        "closed_date_coverage_pct": share_pct(F.col("closed_date_count"), rows),
        "due_date_coverage_pct": share_pct(F.col("due_date_count"), rows),
        "target_eligible_pct": share_pct(F.col("target_eligible_count"), rows),
    })


def coverage_headline(coverage: DataFrame) -> DataFrame:
    """How many groups have any due date or eligible record, and the best coverage."""
    return coverage.agg(
        F.count(F.lit(1)).alias("group_count"),
        F.count_if(F.col("due_date_count") > 0).alias("groups_with_due_dates"),
        F.count_if(F.col("target_eligible_count") > 0).alias("groups_with_eligible_records"),
        F.coalesce(F.max("due_date_coverage_pct"), F.lit(0.0)).alias("maximum_due_date_coverage_pct"))


def timestamp_checks(typed: DataFrame) -> DataFrame:
    """Pair comparisons, each over the rows that have both values; no such row means not evaluable."""
    created, closed, due = (F.col(TYPED[c]) for c in TARGET_DATES)
    pairs = {
        "closed_date_before_created_date": (closed, created, closed < created),
        "due_date_before_created_date": (due, created, due < created),
        "closed_date_after_due_date": (closed, due, closed > due),
        "closed_date_equal_to_due_date": (closed, due, closed == due),
    }
    one = typed.agg(*[
        a for n, (left, right, match) in pairs.items() for a in (
            F.count_if(left.isNotNull() & right.isNotNull()).alias(f"{n}__pairs"),
            F.count_if(match).alias(f"{n}__hits"))])
    return rows_from(one, [
        {"check_name": n, "evaluable_row_count": F.col(f"{n}__pairs"),
         "matching_or_violation_count": F.col(f"{n}__hits"),
         "percentage_of_evaluable_rows": 100.0 * ratio_or_null(F.col(f"{n}__hits"), F.col(f"{n}__pairs")),
         "evaluation_status": F.when(F.col(f"{n}__pairs") > 0, "evaluated").otherwise("not_evaluable")}
        for n in pairs])


def violation_rate_ratio(typed: DataFrame, agency: str) -> DataFrame:
    """One agency's closed-before-created rate against the whole table, in one scan.

    The agency rate is over rows with both dates, the baseline over all rows.
    """
    hit = F.col("closed_ts") < F.col("created_ts")
    both = F.col("closed_ts").isNotNull() & F.col("created_ts").isNotNull()
    mine = F.col("agency") == agency
    one = typed.agg(
        F.count_if(mine & hit).alias("agency_violations"), F.count_if(mine & both).alias("agency_evaluable"),
        F.count_if(hit).alias("baseline_violations"), F.count(F.lit(1)).alias("baseline_rows"))
    agency_pct = 100.0 * ratio_or_null(F.col("agency_violations"), F.col("agency_evaluable"))
    baseline_pct = 100.0 * ratio_or_null(F.col("baseline_violations"), F.col("baseline_rows"))
    return one.select(
        F.lit(agency).alias("agency"), "agency_violations", "agency_evaluable", "baseline_violations",
        "baseline_rows", agency_pct.alias("agency_pct"), baseline_pct.alias("baseline_pct"),
        ratio_or_null(agency_pct, baseline_pct).alias("rate_ratio"),
        (100.0 * ratio_or_null(F.col("agency_violations"), F.col("baseline_violations"))).alias("share_of_violations"))


def target_classes(typed: DataFrame) -> DataFrame:
    """Basic label counts; both classes are listed even when one is empty."""
    late = F.col("missed_resolution_target")
    one = basic_eligibility(typed).agg(
        F.count_if(late == 0).alias("c0"), F.count_if(late == 1).alias("c1"))
    everything = F.col("c0") + F.col("c1")
    return rows_from(one, [
        {"target_class": k, "record_count": F.col(f"c{k}"),
         "percentage_of_eligible": share_pct(F.col(f"c{k}"), everything)} for k in (0, 1)])


def feasibility_decision(typed: DataFrame, agency: str) -> DataFrame:
    """Counts, the first blocker that applies and the resulting status for one agency."""
    rows = typed.where(F.col("agency") == agency)
    created, closed, due = (F.col(TYPED[c]) for c in TARGET_DATES)
    one = rows.agg(
        F.count(F.lit(1)).alias("total_record_count"), F.count(due).alias("due_date_non_null_count"),
        F.count(closed).alias("closed_date_non_null_count"),
        F.count_if(created.isNotNull() & closed.isNotNull() & due.isNotNull()).alias("eligible_record_count"))
    n, eligible = F.col("total_record_count"), F.col("eligible_record_count")
    # Blocker texts.
    blocker = (
        F.when(F.col("due_date_non_null_count") == 0, "No usable due_date values")
        .when(F.col("closed_date_non_null_count") == 0, "No usable closed_date values")
        .when(eligible == 0, "Required timestamps do not coexist on any record")
        .otherwise("Further semantic and population review required")
    )
    return one.select(
        F.lit(agency).alias("agency"), "total_record_count", "due_date_non_null_count",
        share_pct(F.col("due_date_non_null_count"), n).alias("due_date_coverage_pct"),
        "closed_date_non_null_count",
        share_pct(F.col("closed_date_non_null_count"), n).alias("closed_date_coverage_pct"),
        "eligible_record_count", share_pct(eligible, n).alias("eligible_record_pct"),
        F.when(eligible > 0, "created").otherwise("not_created").alias("target_creation_status"),
        F.when(eligible > 0, "REQUIRES_FURTHER_REVIEW").otherwise("NOT_FEASIBLE").alias("feasibility_status"),
        blocker.alias("primary_blocker"))
