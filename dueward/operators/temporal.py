"""Month-by-month evidence for candidate date ranges, and the choice among them.

One scan counts the scope by creation day. A day table has as many rows as the
calendar has days, so every range, month and year below is cheap after it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dueward.config import Period, StabilityLimits
from dueward.functions.numbers import all_hold, clip01, holds, ratio, ratio_or_null, total
from dueward.functions.shape import whole_table
from dueward.functions.text import joined_reasons
from dueward.functions.time import at, in_days
from dueward.operators.silver import in_months
from dueward.schemas import require_columns

COUNTS = (
    "total_records", "due_date_present_count", "closed_date_present_count",
    "outcome_mature_count", "mature_open_count", "invalid_timestamp_count",
    "eligible_records", "missed_count",
)

def outcome_maturity(typed: DataFrame, extracted_at: datetime) -> DataFrame:
    """Basic eligibility, maturity and label: a due date at or before the extraction instant is mature."""
    require_columns(typed.columns, ("created_ts", "closed_ts", "due_ts"), "Temporal analysis")
    complete = F.col("created_ts").isNotNull() & F.col("closed_ts").isNotNull() & F.col("due_ts").isNotNull()
    return (
        typed.withColumn("outcome_mature", holds(F.col("due_ts") <= at(extracted_at)))
        .withColumn("eligible_for_target", complete)
        .withColumn("analysis_eligible", F.col("eligible_for_target") & F.col("outcome_mature"))
        .withColumn("missed_resolution_target", F.when(
            F.col("analysis_eligible"), (F.col("closed_ts") > F.col("due_ts")).cast("byte")))
    )


def scope_rows(typed: DataFrame, agency: str | None = None, complaint_type: str | None = None) -> DataFrame:
    rows = typed
    if agency is not None:
        rows = rows.where(F.col("agency") == agency)
    if complaint_type is not None:
        rows = rows.where(F.col("complaint_type") == complaint_type)
    return rows


def daily_counts(typed: DataFrame, periods: Sequence[Period], extracted_at: datetime) -> DataFrame:
    """Counts per creation day inside the union of the ranges."""
    first, last = min(p.start for p in periods), max(p.end for p in periods)
    pruned = in_months(typed, first, last).where(in_days(F.col("created_ts"), first, last + timedelta(days=1)))
    rows = outcome_maturity(pruned, extracted_at)
    created, due, closed = F.col("created_ts"), F.col("due_ts"), F.col("closed_ts")
    return rows.groupBy(created.cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count(due).alias("due_date_present_count"),
        F.count(closed).alias("closed_date_present_count"),
        F.count_if("outcome_mature").alias("outcome_mature_count"),
        F.count_if(F.col("outcome_mature") & closed.isNull()).alias("mature_open_count"),
        (F.count_if(due < created) + F.count_if(closed < created)).alias("invalid_timestamp_count"),
        F.count_if("analysis_eligible").alias("eligible_records"),
        F.count_if(F.col("missed_resolution_target") == 1).alias("missed_count"),
    )


def period_days(spark, periods: Sequence[Period]) -> DataFrame:
    """One row per (candidate, calendar day): an equality key in place of a range join."""
    rows = [(p.name, p.start, p.end, p.complete_years) for p in periods]
    table = spark.createDataFrame(
        rows, "candidate_name string, start_date date, end_date date, complete_calendar_years int"
    )
    return table.withColumn("day", F.explode(F.sequence("start_date", "end_date")))


def monthly_metrics(typed: DataFrame, periods: Sequence[Period], extracted_at: datetime) -> DataFrame:
    """Every month of every candidate range, months without a record included."""
    if len({p.name for p in periods}) != len(periods):
        raise ValueError("Candidate names must differ.")
    days = period_days(typed.sparkSession, periods)
    daily = daily_counts(typed, periods, extracted_at)
    months = (
        days.join(daily, "day", "left")
        .groupBy("candidate_name", "start_date", "end_date", "complete_calendar_years",
                 F.trunc("day", "MM").alias("month"))
        .agg(*[total(c).alias(c) for c in COUNTS])
    )
    records, eligible = F.col("total_records"), F.col("eligible_records")
    due = F.col("due_date_present_count")
    return months.withColumns({
        "outcome_immature_count": due - F.col("outcome_mature_count"),
        "eligible_rate": ratio(eligible, records),
        "due_date_coverage": ratio(due, records),
        "closed_date_coverage": ratio(F.col("closed_date_present_count"), records),
        "outcome_maturity_rate": ratio(F.col("outcome_mature_count"), due),
        "on_time_count": eligible - F.col("missed_count"),
        # Unknown, not zero, when a month has no eligible record.
        "missed_target_rate": ratio_or_null(F.col("missed_count"), eligible),
    })


def yearly_metrics(monthly: DataFrame) -> DataFrame:
    """Monthly evidence summed per year; here a rate without eligible records is zero."""
    require_columns(monthly.columns, (
        "month", "total_records", "due_date_present_count", "closed_date_present_count",
        "eligible_records", "missed_count"), "Monthly metrics")
    keys = [c for c in ("candidate_name",) if c in monthly.columns]
    years = monthly.groupBy(*keys, F.year("month").alias("year")).agg(
        total("total_records").alias("total_records"),
        total("eligible_records").alias("yearly_eligible_volume"),
        total("due_date_present_count").alias("due_date_present_count"),
        total("closed_date_present_count").alias("closed_date_present_count"),
        total("missed_count").alias("missed_count"),
    )
    return years.withColumns({
        "yearly_due_date_coverage": ratio(F.col("due_date_present_count"), F.col("total_records")),
        "yearly_closed_date_coverage": ratio(F.col("closed_date_present_count"), F.col("total_records")),
        "yearly_missed_target_rate": ratio(F.col("missed_count"), F.col("yearly_eligible_volume")),
    })


def stability_metrics(monthly: DataFrame) -> DataFrame:
    """Volume, coverage and rate stability per candidate over its active months."""
    in_order = Window.partitionBy("candidate_name").orderBy("month")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    stepped = monthly.withColumn(
        "rate_step",
        # The previous known rate: months without eligible records are skipped.
        F.abs(F.col("missed_target_rate") - F.last("missed_target_rate", ignorenulls=True).over(earlier)),
    )
    active = F.col("eligible_records") > 0
    volume = F.when(active, F.col("eligible_records").cast("double"))
    rate = F.col("missed_target_rate")

    def zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    base = stepped.groupBy("candidate_name", "start_date", "end_date", "complete_calendar_years").agg(
        *[total(c).alias(c) for c in COUNTS],
        F.count_if(active).alias("active_months"),
        F.count(F.lit(1)).alias("expected_months"),
        F.coalesce(F.min(volume), F.lit(0)).cast("bigint").alias("minimum_monthly_eligible_volume"),
        F.coalesce(F.max(volume), F.lit(0)).cast("bigint").alias("maximum_monthly_eligible_volume"),
        zero(F.avg(volume)).alias("mean_monthly_eligible_volume"),
        zero(F.stddev_pop(volume)).alias("monthly_volume_standard_deviation"),
        zero(F.min(rate)).alias("minimum_monthly_missed_target_rate"),
        zero(F.max(rate)).alias("maximum_monthly_missed_target_rate"),
        zero(F.max(rate) - F.min(rate)).alias("monthly_target_rate_range"),
        zero(F.stddev_pop(rate)).alias("monthly_target_rate_standard_deviation"),
        zero(F.max("rate_step")).alias("largest_absolute_month_to_month_target_rate_change"),
    )
    records, eligible, due = F.col("total_records"), F.col("eligible_records"), F.col("due_date_present_count")
    return base.withColumns({
        "eligible_rate": ratio(eligible, records),
        "due_date_coverage": ratio(due, records),
        "closed_date_coverage": ratio(F.col("closed_date_present_count"), records),
        "outcome_maturity_rate": ratio(F.col("outcome_mature_count"), due),
        "outcome_immature_count": due - F.col("outcome_mature_count"),
        "on_time_count": eligible - F.col("missed_count"),
        "missed_target_rate": ratio(F.col("missed_count"), eligible),
        "missing_months": F.col("expected_months") - F.col("active_months"),
        "monthly_volume_coefficient_of_variation": ratio(
            F.col("monthly_volume_standard_deviation"), F.col("mean_monthly_eligible_volume")),
        "invalid_timestamp_rate": ratio(F.col("invalid_timestamp_count"), records),
    })


GATES = (
    "passes_eligible_record_count", "passes_due_date_coverage", "passes_closed_date_coverage",
    "passes_target_class_balance", "passes_month_continuity", "passes_monthly_eligible_volume",
    "passes_active_months", "passes_outcome_maturity", "passes_timestamp_consistency",
    "passes_complete_calendar_years",
)


def evaluate_candidates(monthly: DataFrame, limits: StabilityLimits = StabilityLimits()) -> DataFrame:
    """Feasibility gates, volatility levels and a status per candidate."""
    m = stability_metrics(monthly)
    c = F.col
    gates = {
        "passes_eligible_record_count": c("eligible_records") >= limits.minimum_eligible_records,
        "passes_due_date_coverage": c("due_date_coverage") >= limits.minimum_due_date_coverage,
        "passes_closed_date_coverage": c("closed_date_coverage") >= limits.minimum_closed_date_coverage,
        "passes_target_class_balance": c("missed_target_rate").between(
            limits.minimum_target_rate, limits.maximum_target_rate),
        "passes_month_continuity": c("missing_months") == 0,
        "passes_monthly_eligible_volume":
            c("minimum_monthly_eligible_volume") >= limits.minimum_monthly_eligible_volume,
        "passes_active_months": c("active_months") >= limits.minimum_active_months,
        "passes_outcome_maturity": c("outcome_maturity_rate") >= limits.minimum_outcome_maturity_rate,
        "passes_timestamp_consistency": c("invalid_timestamp_rate") <= limits.maximum_invalid_timestamp_rate,
        "passes_complete_calendar_years":
            c("complete_calendar_years") >= limits.minimum_complete_calendar_years,
    }
    spread, deviation = c("monthly_target_rate_range"), c("monthly_target_rate_standard_deviation")
    step = c("largest_absolute_month_to_month_target_rate_change")
    severe = (
        (spread >= limits.severe_target_rate_range)
        | (deviation >= limits.severe_target_rate_standard_deviation)
        | (step >= limits.severe_month_to_month_change)
        | (c("monthly_volume_coefficient_of_variation")
           >= limits.severe_monthly_volume_coefficient_of_variation)
    )
    warning = (
        c("severe_temporal_volatility")
        | (spread >= limits.warning_target_rate_range)
        | (deviation >= limits.warning_target_rate_standard_deviation)
        | (step >= limits.warning_month_to_month_change)
    )
    return (
        m.withColumns(gates)
        .withColumn("severe_temporal_volatility", severe)
        .withColumn("temporal_volatility_warning", warning)
        .withColumn("core_data_feasibility", all_hold([c(g) for g in GATES]))
        .withColumn("decision_status", F.when(~c("core_data_feasibility"), "NOT_FEASIBLE")
                    .when(c("temporal_volatility_warning"), "APPROVED_WITH_LIMITATIONS")
                    .otherwise("APPROVED"))
        .withColumn("decision_reasons", joined_reasons([(~c(g), g) for g in GATES]))
    )


def containing_stable_candidates(evaluated: DataFrame, limits: StabilityLimits = StabilityLimits()) -> DataFrame:
    """Severely volatile candidates that hold a feasible, calmer range with enough of their volume.

    The inputs are candidate rows, a handful, so the inequality join is a plain
    nested loop over them.
    """
    wide = evaluated.where("severe_temporal_volatility").alias("wide")
    calm = evaluated.where(F.col("core_data_feasibility") & ~F.col("severe_temporal_volatility")).alias("calm")
    inside = (
        (F.col("calm.start_date") >= F.col("wide.start_date"))
        & (F.col("calm.end_date") <= F.col("wide.end_date"))
        & (F.col("calm.eligible_records")
           >= F.col("wide.eligible_records") * limits.better_candidate_minimum_eligible_fraction)
    )
    return wide.join(calm, inside, "left_semi").select("candidate_name")


def compare_candidates(evaluated: DataFrame, limits: StabilityLimits = StabilityLimits()) -> DataFrame:
    """Narrow severe ranges, score every candidate and select at most one."""
    narrower = containing_stable_candidates(evaluated, limits).withColumn("_better", F.lit(True))
    c = F.col
    latest_year_end = F.max(F.when((F.month("end_date") == 12) & (F.dayofmonth("end_date") == 31), c("end_date")))
    joined = evaluated.join(narrower, "candidate_name", "left").withColumn(
        "better_stable_candidate_exists", holds(c("_better"))
    ).drop("_better").withColumn(
        "_latest_end", F.coalesce(latest_year_end.over(whole_table()), F.max("end_date").over(whole_table()))
    )
    narrowed = c("better_stable_candidate_exists")
    first_start, last_start = F.min("start_date").over(whole_table()), F.max("start_date").over(whole_table())
    scored = joined.withColumns({
        # Status and reason texts, here and in the rejections below.
        "decision_status": F.when(narrowed, "REQUIRES_NARROWER_RANGE").otherwise(c("decision_status")),
        "decision_reasons": F.when(
            narrowed,
            "Severe temporal volatility and a feasible, more stable contained candidate exists",
        ).otherwise(c("decision_reasons")),
        "recent_period_relevance_score":
            F.datediff("start_date", first_start) / F.greatest(F.datediff(last_start, first_start), F.lit(1)),
        "_largest": F.greatest(F.max("eligible_records").over(whole_table()), F.lit(1)).cast("double"),
    })
    at_latest = c("end_date") == c("_latest_end")
    scored = scored.withColumn(
        "selection_score",
        0.30 * (1.0 - clip01(c("monthly_target_rate_range")))
        + 0.20 * (1.0 - clip01(c("monthly_target_rate_standard_deviation")))
        + 0.15 * (1.0 - clip01(c("monthly_volume_coefficient_of_variation")))
        + 0.15 * (c("eligible_records") / c("_largest"))
        + 0.15 * at_latest.cast("double")
        + 0.05 * c("recent_period_relevance_score"),
    )
    preferred = c("core_data_feasibility") & ~c("severe_temporal_volatility") & at_latest
    any_preferred = F.coalesce(F.bool_or(preferred).over(whole_table()), F.lit(False))
    scored = scored.withColumn(
        "_pool", F.when(any_preferred, preferred).otherwise(c("core_data_feasibility"))
    )
    order = whole_table().orderBy(F.desc("_pool"), F.desc("selection_score"), F.desc("eligible_records"),
                               "start_date", "end_date")
    return scored.withColumn("selected", c("_pool") & (F.row_number().over(order) == 1)).drop(
        "_pool", "_latest_end", "_largest"
    )


def temporal_rejections(compared: DataFrame) -> DataFrame:
    """Candidates not selected, each with the reasons its evidence supports."""
    c = F.col
    year_end = (F.month("end_date") == 12) & (F.dayofmonth("end_date") == 31)
    recorded = F.when(F.trim("decision_reasons") != "", c("decision_reasons"))
    labels = F.array_distinct(F.array_compact(F.array(
        recorded,
        F.when(~year_end, F.lit("Includes an incomplete calendar year")),
        F.when(c("outcome_immature_count") > 0, F.lit("Contains outcome-immature records")),
        F.when(c("temporal_volatility_warning") & ~c("severe_temporal_volatility"),
               F.lit("Passes core feasibility gates but is materially less stable")),
    )))
    text = F.when(F.size(labels) > 0, F.array_join(labels, " | ")).otherwise(
        "Rejected by volatility-aware temporal analysis")
    return compared.where(~c("selected")).withColumn("rejection_reason", text)


def regime_changes(monthly: DataFrame, candidate: str, top: int = 10) -> DataFrame:
    """The months with the largest jump of the missed rate against the calendar month before."""
    in_order = Window.partitionBy("candidate_name").orderBy("month")
    c = F.col
    changed = monthly.where(c("candidate_name") == candidate).select(
        "month", "eligible_records", "missed_target_rate",
        F.abs(c("missed_target_rate") - F.lag("missed_target_rate").over(in_order))
        .alias("absolute_target_rate_change"),
        "due_date_coverage",
        (c("due_date_coverage") - F.lag("due_date_coverage").over(in_order)).alias("due_coverage_change"),
        ratio_or_null(c("eligible_records") - F.lag("eligible_records").over(in_order),
                      F.lag("eligible_records").over(in_order)).alias("eligible_volume_change_rate"),
    )
    return changed.where(c("absolute_target_rate_change").isNotNull()).orderBy(
        F.desc("absolute_target_rate_change"), "month").limit(top)


def descriptor_yearly(typed: DataFrame) -> DataFrame:
    """Records per descriptor and creation year, with the share inside the year."""
    counts = typed.groupBy(
        F.year("created_ts").alias("year"), F.coalesce("descriptor", F.lit("<MISSING>")).alias("descriptor_label")
    ).agg(F.count(F.lit(1)).alias("record_count"))
    in_year = Window.partitionBy("year")
    return counts.withColumn(
        "year_share", ratio(F.col("record_count"), F.sum("record_count").over(in_year)))
