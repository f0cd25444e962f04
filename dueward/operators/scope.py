"""Agency, complaint-type and date-range selection over one monthly partial aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, replace
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueward.config import (
    DIAGNOSTIC_CONFLICT_COLUMNS, SCORE_WEIGHTS, Period, ScopeLimits,
)
from dueward.functions.numbers import (
    all_hold, balance_score, clip01, holds, ratio, total, volume_score,
)
from dueward.functions.shape import rows_from, whole_table
from dueward.functions.text import joined_reasons, strip
from dueward.functions.time import in_days, month_of, month_start
from dueward.operators.keyed import KEY, differs, repeated_keys, text_hash
from dueward.operators.silver import in_months
from dueward.schemas import require_columns

AGENCY = ("agency", "agency_name")
TYPE = AGENCY + ("complaint_type",)
SUMS = (
    "total_records", "created_date_present_count", "due_date_present_count",
    "closed_date_present_count", "eligible_target_count", "missed_target_count",
    "invalid_due_sequence_count", "invalid_closed_sequence_count",
)


def latest_complete_month_end(extracted_at: datetime) -> date:
    """Last day of the month before the extraction month."""
    return month_start(extracted_at.date()) - timedelta(days=1)


def recent_cutoff(extracted_at: datetime, months: int = 12) -> date:
    """First day counted as recent: the day after the last complete month's end, shifted back."""
    end = latest_complete_month_end(extracted_at)
    first = _months_back(end, months)
    following = _months_back(first, -1)
    return min(first.replace(day=min(end.day, 28)) if end.day <= 28 else
               first + timedelta(days=end.day - 1), following - timedelta(days=1)) + timedelta(days=1)


def up_to_latest(typed: DataFrame) -> DataFrame:
    """Rows no newer than the newest creation time, which is a scalar subquery of the same plan."""
    newest = typed.agg(F.max("created_ts")).scalar()
    return typed.where(F.col("created_ts") <= newest)


def up_to_complete_month(months: DataFrame, extracted_at: datetime, newest: DataFrame | None = None) -> DataFrame:
    """Rows of ``created_month`` no later than the latest complete month; rows without a month go.

    The month before the extraction is the last one that can be complete. ``newest`` is a one-row table whose first
    column is the newest creation time: months after it hold nothing yet. It becomes a scalar subquery, so stored months
    are pruned by it without a round trip.
    """
    last = F.lit(month_start(latest_complete_month_end(extracted_at)))
    if newest is None:
        return months.where(F.col("created_month") <= last)
    seen = newest.select(F.trunc(F.col(newest.columns[0]), "MM")).scalar()
    return months.where((F.col("created_month") <= last) & (F.col("created_month") <= seen))


def basic_eligibility(typed: DataFrame) -> DataFrame:
    """Three dates present, one reason otherwise, and the label."""
    created, closed, due = (F.col(c).isNotNull() for c in ("created_ts", "closed_ts", "due_ts"))
    reason = (
        F.when(~created, "missing_created_date")
        .when(closed & ~due, "has_closed_date_missing_due_date")
        .when(~closed & due, "missing_closed_date_only")
        .when(~closed & ~due, "missing_closed_and_due_date")
        .otherwise("eligible")
    )
    return (
        typed.withColumn("eligible_for_target", created & closed & due)
        .withColumn("target_exclusion_reason", reason)
        .withColumn("missed_resolution_target", F.when(
            F.col("eligible_for_target"), (F.col("closed_ts") > F.col("due_ts")).cast("byte")))
    )


def partial_counts() -> list[Column]:
    created, due, closed = F.col("created_ts"), F.col("due_ts"), F.col("closed_ts")
    complete = created.isNotNull() & due.isNotNull() & closed.isNotNull()
    return [
        F.count(F.lit(1)).alias("total_records"),
        F.count(created).alias("created_date_present_count"),
        F.count(due).alias("due_date_present_count"),
        F.count(closed).alias("closed_date_present_count"),
        F.count_if(complete).alias("eligible_target_count"),
        F.count_if(complete & (closed > due)).alias("missed_target_count"),
        F.count_if(due < created).alias("invalid_due_sequence_count"),
        F.count_if(closed < created).alias("invalid_closed_sequence_count"),
    ]


def scope_monthly(typed: DataFrame) -> DataFrame:
    """The gold table: counts per agency, name, type and creation month (NULL month kept)."""
    return typed.groupBy(*TYPE, month_of(F.col("created_ts")).alias("created_month")).agg(
        *partial_counts(),
        F.min("created_ts").alias("first_created_date"),
        F.max("created_ts").alias("last_created_date"),
    )


def repeated_key_rows(typed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows beyond the first per key inside each group; NULL keys count as one key."""
    per_key = typed.groupBy(*by, KEY).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy(*by).agg(total(F.col("n") - 1).alias("duplicate_unique_key_count"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match, keeping the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def agency_summary(typed: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """Coverage, target, chronology and volume per agency, from the rows themselves."""
    return agency_totals(scope_monthly(typed) if gold is None else gold, repeated_key_rows(typed, AGENCY))


def agency_totals(gold: DataFrame, repeated_rows: DataFrame) -> DataFrame:
    """The same from the gold table and ``(agency, name, duplicate_unique_key_count)``; agencies absent there have none."""
    sums = gold.groupBy(*AGENCY).agg(
        *[total(c).alias(c) for c in SUMS],
        F.min("first_created_date").alias("first_created_date"),
        F.max("last_created_date").alias("last_created_date"),
        F.count_distinct("created_month").alias("active_months"),
        F.count_distinct("complaint_type").alias("complaint_type_count"),
    )
    joined = null_safe_join(sums, repeated_rows, AGENCY).na.fill({"duplicate_unique_key_count": 0})
    return _with_rates(joined).withColumn(
        "created_date_coverage", ratio(F.col("created_date_present_count"), F.col("total_records")))


def _with_rates(df: DataFrame) -> DataFrame:
    records, eligible = F.col("total_records"), F.col("eligible_target_count")
    missed = F.col("missed_target_count")
    return df.withColumns({
        "due_date_coverage": ratio(F.col("due_date_present_count"), records),
        "closed_date_coverage": ratio(F.col("closed_date_present_count"), records),
        "eligible_target_rate": ratio(eligible, records),
        "on_time_count": eligible - missed,
        "missed_target_rate": ratio(missed, eligible),
    })


def type_summary(gold: DataFrame, recent_from: date | None = None) -> DataFrame:
    """Counts and monthly volume per complaint type, from the gold table alone."""
    dated = F.col("created_month").isNotNull()
    volume = F.when(dated, F.col("total_records"))
    recent = F.col("created_month") >= F.lit(recent_from) if recent_from else dated
    sums = gold.groupBy(*TYPE).agg(
        *[total(c).alias(c) for c in SUMS],
        F.min("first_created_date").alias("first_created_date"),
        F.max("last_created_date").alias("last_created_date"),
        F.count(volume).alias("active_months"),
        F.coalesce(F.median(volume), F.lit(0.0)).alias("median_monthly_volume"),
        F.coalesce(F.min(volume), F.lit(0)).alias("minimum_monthly_volume"),
        F.coalesce(F.max(volume), F.lit(0)).alias("maximum_monthly_volume"),
        total(F.when(recent, F.col("total_records"))).alias("recent_period_record_count"),
    )
    return _with_rates(sums).withColumn(
        "invalid_timestamp_count",
        F.col("invalid_due_sequence_count") + F.col("invalid_closed_sequence_count"))


# ---- rules ------------------------------------------------------------------

def agency_discovery(agencies: DataFrame, limits: ScopeLimits, recent_from: date) -> DataFrame:
    """Which agencies hold enough evidence for a look at their types.

    Agency-wide coverage stays a diagnostic; it does not veto.
    """
    c = F.col
    ruled = agencies.withColumn("invalid_timestamp_rate", ratio(
        c("invalid_due_sequence_count") + c("invalid_closed_sequence_count"), c("total_records"))
    ).withColumns({
        "passes_eligible_volume": c("eligible_target_count") >= limits.minimum_candidate_eligible_records,
        "passes_due_date_coverage": c("due_date_coverage") >= limits.minimum_due_date_coverage,
        "passes_closed_date_coverage": c("closed_date_coverage") >= limits.minimum_closed_date_coverage,
        "passes_temporal_coverage": c("active_months") >= limits.minimum_active_months,
        "passes_data_consistency": c("invalid_timestamp_rate") <= limits.maximum_invalid_timestamp_rate,
        "passes_target_balance": (c("eligible_target_count") > 0) & c("missed_target_rate").between(
            limits.minimum_target_rate, limits.maximum_target_rate),
        "passes_recent_activity": holds(c("last_created_date") >= F.lit(recent_from).cast("timestamp")),
    }).withColumns({
        "passes_agency_wide_coverage": c("passes_due_date_coverage") & c("passes_closed_date_coverage"),
        "has_target_evidence": c("passes_eligible_volume"),
        "proceed_to_complaint_type_review":
            c("passes_eligible_volume") & c("passes_temporal_coverage") & c("passes_data_consistency"),
    })
    # Reason texts of the report contract, here and in the gates below.
    return ruled.withColumns({
        "agency_discovery_reasons": joined_reasons([
            (~c("has_target_evidence"), "Insufficient absolute target evidence"),
            (~c("passes_temporal_coverage"), "Insufficient historical coverage"),
            (~c("passes_data_consistency"), "Excessive invalid timestamp sequences"),
            (~c("passes_recent_activity"), "No recent activity"),
        ]),
        "agency_wide_diagnostics": joined_reasons([
            (c("eligible_target_count") == 0, "No target-eligible records"),
            (~c("passes_eligible_volume"), "Insufficient eligible records"),
            (~c("passes_due_date_coverage"), "Low due-date coverage"),
            (~c("passes_closed_date_coverage"), "Low closed-date coverage"),
            (~c("passes_target_balance"), "Target rate outside configured range"),
            (~c("passes_temporal_coverage"), "Insufficient active months"),
            (~c("passes_data_consistency"), "Excessive invalid timestamp sequences"),
            (~c("passes_recent_activity"), "No recent activity"),
        ]),
    })


TYPE_RULES = (
    ("passes_eligible_volume", "Insufficient eligible records"),
    ("passes_due_date_coverage", "Low due-date coverage"),
    ("passes_closed_date_coverage", "Low closed-date coverage"),
    ("passes_target_balance", "Target rate outside configured range"),
    ("passes_temporal_coverage", "Insufficient active months"),
    ("passes_monthly_volume", "Low median monthly volume"),
    ("passes_recent_activity", "Inactive in recent period"),
    ("passes_data_consistency", "Excessive invalid timestamp rate"),
)


def _limit(limits: ScopeLimits, name: str) -> Column:
    """A limit from the settings, or from a column of that name when scenarios vary it."""
    return F.lit(getattr(limits, name))


def type_decision(types: DataFrame, limits: ScopeLimits, limit=None) -> DataFrame:
    """Include, Review or Exclude per complaint type, judged without its agency's percentages."""
    value = limit or (lambda name: _limit(limits, name))
    c = F.col
    ruled = types.withColumn(
        "invalid_timestamp_rate", ratio(c("invalid_timestamp_count"), c("total_records"))
    ).withColumns({
        "passes_eligible_volume": c("eligible_target_count") >= value("minimum_complaint_type_eligible_records"),
        "passes_due_date_coverage": c("due_date_coverage") >= value("minimum_due_date_coverage"),
        "passes_closed_date_coverage": c("closed_date_coverage") >= value("minimum_closed_date_coverage"),
        "passes_target_balance": (c("eligible_target_count") > 0) & c("missed_target_rate").between(
            value("minimum_target_rate"), value("maximum_target_rate")),
        "passes_temporal_coverage": c("active_months") >= value("minimum_active_months"),
        "passes_monthly_volume": c("median_monthly_volume") >= value("minimum_median_monthly_volume"),
        "passes_recent_activity": c("recent_period_record_count") > 0,
        "passes_data_consistency": c("invalid_timestamp_rate") <= value("maximum_invalid_timestamp_rate"),
    })
    return ruled.withColumns({
        "scope_status": F.when(all_hold([c(r) for r, _ in TYPE_RULES]), "Include")
        .when(c("eligible_target_count") > 0, "Review").otherwise("Exclude"),
        "inclusion_or_rejection_reasons": joined_reasons([(~c(r), label) for r, label in TYPE_RULES]),
    })


def with_viable_population(agencies: DataFrame, types: DataFrame) -> DataFrame:
    """Flag agencies that own at least one included complaint type."""
    viable = types.where(F.col("scope_status") == "Include").select("agency").distinct().withColumn("_v", F.lit(True))
    return agencies.join(viable, "agency", "left").withColumn(
        "has_viable_complaint_type_population", holds(F.col("_v"))).drop("_v")


# Gates and their reasons.
CANDIDATE_GATES = (
    ("passes_eligible_volume", "Insufficient candidate eligible records"),
    ("passes_due_date_coverage", "Candidate due-date coverage below threshold"),
    ("passes_closed_date_coverage", "Candidate closed-date coverage below threshold"),
    ("passes_target_balance", "Candidate target rate outside configured range"),
    ("passes_temporal_coverage", "Insufficient candidate active months"),
    ("has_included_complaint_types", "Candidate contains no included complaint types"),
    ("passes_month_continuity", "Candidate has missing months"),
    ("passes_data_consistency", "Candidate has an excessive invalid timestamp rate"),
)


def candidate_gates(candidates: DataFrame, limits: ScopeLimits, limit=None) -> DataFrame:
    """Critical gates on a candidate's own population, with ordered rejection reasons."""
    value = limit or (lambda name: _limit(limits, name))
    c = F.col
    gated = candidates.withColumns({
        "passes_eligible_volume": c("eligible_target_count") >= value("minimum_candidate_eligible_records"),
        "passes_due_date_coverage": c("due_date_coverage") >= value("minimum_due_date_coverage"),
        "passes_closed_date_coverage": c("closed_date_coverage") >= value("minimum_closed_date_coverage"),
        "passes_target_balance": c("missed_target_rate").between(
            value("minimum_target_rate"), value("maximum_target_rate")),
        "passes_temporal_coverage": c("active_months") >= value("minimum_active_months"),
        "has_included_complaint_types": c("complaint_type_count") > 0,
        "passes_month_continuity": c("missing_month_count") == 0,
        "passes_data_consistency": c("invalid_timestamp_rate") <= value("maximum_invalid_timestamp_rate"),
    })
    return gated.withColumns({
        "passes_critical_gates": all_hold([c(g) for g, _ in CANDIDATE_GATES]),
        "gate_rejection_reasons": joined_reasons([(~holds(c(g)), label) for g, label in CANDIDATE_GATES]),
    })


def candidate_scores(candidates: DataFrame, limits: ScopeLimits) -> DataFrame:
    """Bounded, weighted score of a candidate; it ranks, the gates decide."""
    if not 0 <= limits.operational_relevance_score <= 1:
        raise ValueError("operational_relevance_score lies outside [0, 1].")
    c = F.col
    missing_share = ratio(c("missing_month_count"), c("active_months") + c("missing_month_count"))
    scored = candidates.withColumns({
        "due_date_score": clip01(c("due_date_coverage")),
        "closed_date_score": clip01(c("closed_date_coverage")),
        "eligible_volume_score": volume_score(
            c("eligible_target_count"), F.lit(limits.minimum_candidate_eligible_records)),
        "target_balance_score": balance_score(c("missed_target_rate")),
        "data_consistency_score": clip01(
            1.0 - 0.7 * clip01(c("invalid_timestamp_rate")) - 0.3 * missing_share),
        "operational_relevance_score": F.lit(float(limits.operational_relevance_score)),
    })
    score = None
    for name, weight in SCORE_WEIGHTS.items():
        term = c(name) * F.lit(weight)
        score = term if score is None else score + term
    return scored.withColumn("scope_score", clip01(score))


def decision_status(passes: Column, *, limitations_remain: bool) -> Column:
    # Decision texts.
    approved = "Approved with limitations" if limitations_remain else "Approved"
    return F.when(holds(passes), approved).otherwise("Requires review")


def check_selected_scope(declared_types: int, total_records: int, selected_types: Sequence[str]) -> None:
    """Reject a scope whose declared type count contradicts its list."""
    if declared_types != len(selected_types):
        raise ValueError("The declared complaint-type count differs from the selected list.")
    if total_records > 0 and declared_types == 0:
        raise ValueError("A non-empty scope needs at least one complaint type.")


# ---- date ranges ------------------------------------------------------------

def _period_table(spark, periods: Sequence[Period]) -> DataFrame:
    return spark.createDataFrame(
        [(p.name, p.start, p.end, p.months) for p in periods],
        "candidate_name string, start_date date, end_date date, expected_months int",
    )


def date_range_summary(typed: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """Counts per inclusive range, from one count per (day, type); empty ranges keep a row."""
    first, last = min(p.start for p in periods), max(p.end for p in periods)
    daily = in_months(typed, first, last).where(in_days(F.col("created_ts"), first, last + timedelta(days=1))).groupBy(
        F.col("created_ts").cast("date").alias("day"), "complaint_type").agg(*partial_counts())
    days = _period_table(typed.sparkSession, periods).withColumn(
        "day", F.explode(F.sequence("start_date", "end_date")))
    inside = days.join(daily, "day")
    monthly = inside.groupBy("candidate_name", F.trunc("day", "MM").alias("month")).agg(
        *[total(c).alias(c) for c in SUMS])
    return _range_rollup(monthly, inside, periods, typed.sparkSession)


def _range_rollup(monthly: DataFrame, inside: DataFrame, periods: Sequence[Period], spark) -> DataFrame:
    rolled = monthly.groupBy("candidate_name").agg(
        *[total(c).alias(c) for c in SUMS],
        F.count(F.lit(1)).alias("active_months"),
        F.median("eligible_target_count").alias("median_monthly_eligible_records"),
        F.min("eligible_target_count").alias("minimum_monthly_eligible_records"),
    )
    types = inside.groupBy("candidate_name").agg(F.count_distinct("complaint_type").alias("complaint_type_count"))
    table = _period_table(spark, periods).join(rolled, "candidate_name", "left").join(types, "candidate_name", "left")
    zeros = {c: 0 for c in SUMS + ("active_months", "minimum_monthly_eligible_records", "complaint_type_count")}
    filled = table.na.fill({**zeros, "median_monthly_eligible_records": 0.0})
    return _with_rates(filled).withColumns({
        "missing_month_count": F.greatest(F.col("expected_months") - F.col("active_months"), F.lit(0)),
        "invalid_timestamp_rate": ratio(
            F.col("invalid_due_sequence_count") + F.col("invalid_closed_sequence_count"),
            F.col("total_records")),
    })


def monthly_range_summary(gold: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """The same per range on whole months, from the gold table."""
    spark = gold.sparkSession
    months = _period_table(spark, periods).withColumn("created_month", F.explode(F.sequence(
        F.trunc("start_date", "MM"), F.trunc("end_date", "MM"), F.expr("interval 1 month"))))
    inside = months.join(gold, "created_month")
    monthly = inside.groupBy("candidate_name", "created_month").agg(*[total(c).alias(c) for c in SUMS])
    return _range_rollup(monthly, inside, periods, spark)


def selected_types_gold(gold: DataFrame, decided: DataFrame, agency: str) -> DataFrame:
    """Gold rows of one agency's included complaint types."""
    included = decided.where((F.col("scope_status") == "Include") & (F.col("agency") == agency))
    return gold.where(F.col("agency") == agency).join(
        included.select("complaint_type").distinct(), "complaint_type", "left_semi")


def general_candidates(gold: DataFrame, decided: DataFrame, agency: str, periods: Sequence[Period],
                       limits: ScopeLimits) -> DataFrame:
    """Candidate ranges rebuilt from the included types, scored and gated."""
    unique = list({(p.start, p.end): p for p in reversed(periods)}.values())[::-1]
    summary = monthly_range_summary(selected_types_gold(gold, decided, agency), unique)
    named = summary.withColumn("agency", F.lit(agency)).withColumn("candidate_id", F.concat(
        F.lit("C"), F.element_at(
            F.create_map(*[x for i, p in enumerate(unique, 1) for x in (F.lit(p.name), F.lit(str(i)))]),
            F.col("candidate_name"))))
    return candidate_gates(candidate_scores(named, limits), limits)


def selected_monthly(gold: DataFrame, decided: DataFrame, agency: str, period: Period) -> DataFrame:
    """Months of the selected range that hold at least one record."""
    rows = selected_types_gold(gold, decided, agency).where(
        F.col("created_month").between(F.lit(period.start), F.lit(period.end)))
    return _with_rates(rows.groupBy("created_month").agg(
        *[total(c).alias(c) for c in SUMS],
        F.count_distinct("complaint_type").alias("complaint_type_count")))


def selected_yearly(monthly: DataFrame) -> DataFrame:
    return _with_rates(monthly.groupBy(F.year("created_month").alias("year")).agg(
        *[total(c).alias(c) for c in SUMS]))


def monthly_stability(monthly: DataFrame, expected_months: int, limits: ScopeLimits,
                      volatility_flag_threshold: float = 0.30) -> DataFrame:
    """Continuity and volatility of the given months, every one of them counted."""
    in_order = whole_table().orderBy("created_month")  # one row per calendar month
    stepped = monthly.withColumn(
        "_step", F.abs(F.col("missed_target_rate") - F.lag("missed_target_rate").over(in_order)))
    volume = F.col("eligible_target_count")

    def spread(column: str) -> Column:
        return F.coalesce(F.max(column) - F.min(column), F.lit(0.0))

    one = stepped.agg(
        F.count(F.lit(1)).alias("active_months"),
        F.greatest(F.lit(expected_months) - F.count(F.lit(1)), F.lit(0)).alias("missing_month_count"),
        ratio(F.stddev_pop(volume), F.avg(volume)).alias("monthly_volume_coefficient_of_variation"),
        F.coalesce(F.min(volume), F.lit(0)).alias("minimum_monthly_eligible_volume"),
        F.coalesce(F.max(volume), F.lit(0)).alias("maximum_monthly_eligible_volume"),
        spread("missed_target_rate").alias("target_rate_range"),
        F.coalesce(F.max("_step"), F.lit(0.0)).alias("largest_month_to_month_target_rate_change"),
        spread("due_date_coverage").alias("due_date_coverage_range"),
        spread("closed_date_coverage").alias("closed_date_coverage_range"),
        F.count_if(volume < limits.minimum_median_monthly_volume).alias("months_below_minimum_volume"),
        F.count_if((F.col("due_date_coverage") < limits.minimum_due_date_coverage)
                   | (F.col("closed_date_coverage") < limits.minimum_closed_date_coverage))
        .alias("months_below_required_coverage"),
    )
    return one.withColumn("target_rate_volatility_flag", F.col("target_rate_range") >= volatility_flag_threshold)


# ---- sensitivity ------------------------------------------------------------

def _shift_years(day: date, years: int) -> date:
    try:
        return day.replace(year=day.year + years)
    except ValueError:
        return day.replace(year=day.year + years, day=28)


def default_scenarios(period: Period, limits: ScopeLimits) -> list[tuple[str, Period, ScopeLimits]]:
    """Fifteen one-at-a-time variations around the configured limits."""
    scenarios = []
    scale = limits.minimum_candidate_eligible_records
    for value in (scale // 2, scale, scale * 2):
        scenarios.append((f"minimum_candidate_eligible_records_{value}", period,
                          replace(limits, minimum_candidate_eligible_records=value)))
    for value in (0.60, 0.70, 0.80):
        scenarios.append((f"minimum_due_date_coverage_{value:.0%}", period,
                          replace(limits, minimum_due_date_coverage=value)))
    for value in (0.70, 0.80, 0.90):
        scenarios.append((f"minimum_closed_date_coverage_{value:.0%}", period,
                          replace(limits, minimum_closed_date_coverage=value)))
    base = limits.minimum_complaint_type_eligible_records
    for value in (base // 2, base, base * 5 // 2):
        scenarios.append((f"minimum_complaint_type_eligible_records_{value}", period,
                          replace(limits, minimum_complaint_type_eligible_records=value)))
    for label, shift in (("selected_start_date", 0), ("one_year_earlier", -1), ("one_year_later", 1)):
        start = _shift_years(period.start, shift)
        scenarios.append((f"start_date_{label}", Period.of(start.isoformat(), period.end.isoformat()), limits))
    return scenarios


def sensitivity(gold: DataFrame, agency: str, period: Period, limits: ScopeLimits,
                scenarios: Sequence[tuple[str, Period, ScopeLimits]] | None = None) -> DataFrame:
    """Reselect types and rebuild the candidate under every scenario, in one job.

    The scenarios, a fixed list, are fanned out over the agency's gold rows, and
    all later steps group by scenario.
    """
    listed = [("", period, limits)] + list(scenarios or default_scenarios(period, limits))
    literal_rows = []
    for name, span, lim in listed:
        recent = span.start if span.months < 12 else _months_back(span.end, 11)
        fields = {
            "scenario_name": F.lit(name), "start_date": F.lit(span.start), "end_date": F.lit(span.end),
            "expected_months": F.lit(span.months), "recent_from": F.lit(month_start(recent)),
            **{f"limit_{k}": F.lit(float(v)) for k, v in asdict(lim).items()},
        }
        literal_rows.append(F.struct(*[v.alias(k) for k, v in fields.items()]))
    scenario_array = F.array(*literal_rows)
    limit_columns = [f"limit_{k}" for k in asdict(limits)]
    fixed = ["scenario_name", "start_date", "end_date", "expected_months", "recent_from", *limit_columns]

    def limit(name: str) -> Column:
        return F.col(f"limit_{name}")

    spark = gold.sparkSession
    scenario_table = spark.range(1).select(F.inline(scenario_array))
    scoped = gold.where((F.col("agency") == agency) & F.col("created_month").isNotNull()).select(
        *gold.columns, F.inline(scenario_array)
    ).where(
        (F.col("created_month") >= F.trunc("start_date", "MM")) & (F.col("created_month") <= F.col("end_date")))
    types = _with_rates(scoped.groupBy(*fixed, *TYPE).agg(
        *[total(c).alias(c) for c in SUMS],
        F.count_distinct("created_month").alias("active_months"),
        F.median("total_records").alias("median_monthly_volume"),
        total(F.when(F.col("created_month") >= F.col("recent_from"), F.col("total_records")))
        .alias("recent_period_record_count"),
    )).withColumn("invalid_timestamp_count",
                  F.col("invalid_due_sequence_count") + F.col("invalid_closed_sequence_count"))
    included = type_decision(types, limits, limit).where(F.col("scope_status") == "Include").select(
        "scenario_name", "complaint_type").distinct()
    names = included.groupBy("scenario_name").agg(
        F.array_join(F.array_sort(F.collect_list("complaint_type")), " | ").alias("included_complaint_types"),
        F.count(F.lit(1)).alias("complaint_type_count"))
    population = scoped.join(included, ["scenario_name", "complaint_type"], "left_semi").groupBy("scenario_name").agg(
        *[total(c).alias(c) for c in SUMS],
        F.count_distinct("created_month").alias("active_months"))
    joined = scenario_table.join(names, "scenario_name", "left").join(population, "scenario_name", "left")
    filled = joined.na.fill({
        **{c: 0 for c in SUMS + ("active_months", "complaint_type_count")}, "included_complaint_types": ""})
    candidates = _with_rates(filled).withColumns({
        "missing_month_count": F.greatest(F.col("expected_months") - F.col("active_months"), F.lit(0)),
        "invalid_timestamp_rate": ratio(
            F.col("invalid_due_sequence_count") + F.col("invalid_closed_sequence_count"), F.col("total_records")),
    })
    gated = candidate_gates(candidates, limits, limit)
    everything = whole_table()  # one row per scenario

    def baseline(column: str) -> Column:
        return F.max(F.when(F.col("scenario_name") == "", F.col(column))).over(everything)

    changed = (
        (F.col("included_complaint_types") != baseline("included_complaint_types"))
        | (F.col("start_date") != baseline("start_date"))
        | (F.col("passes_critical_gates") != baseline("passes_critical_gates"))
    )
    return gated.withColumn("selection_changed", changed).where(F.col("scenario_name") != "").select(
        "scenario_name", F.lit(agency).alias("agency"),
        F.col("complaint_type_count").alias("included_complaint_type_count"),
        "included_complaint_types", "start_date", "end_date", "eligible_target_count",
        "due_date_coverage", "closed_date_coverage", "missed_target_rate", "passes_critical_gates",
        decision_status(F.col("passes_critical_gates"), limitations_remain=True).alias("decision_status"),
        "selection_changed",
    )


def _months_back(day: date, months: int) -> date:
    index = day.year * 12 + day.month - 1 - months
    return date(index // 12, index % 12 + 1, 1)


# ---- whole-table facts ------------------------------------------------------

def target_population(agencies: DataFrame) -> DataFrame:
    """Weighted totals over the agency table, with the exclusion split it supports."""
    one = agencies.agg(
        total("total_records").alias("total_records"),
        total("eligible_target_count").alias("eligible_records"),
        total("missed_target_count").alias("missed_target_count"),
        total("on_time_count").alias("on_time_count"),
        total(F.greatest(F.col("closed_date_present_count") - F.col("eligible_target_count"), F.lit(0)))
        .alias("has_closed_date_missing_due_date"),
        total(F.greatest(F.col("total_records") - F.greatest(
            F.col("closed_date_present_count"), F.col("due_date_present_count")), F.lit(0)))
        .alias("missing_closed_and_due_date"),
    )
    return one.withColumns({
        "ineligible_records": F.col("total_records") - F.col("eligible_records"),
        "eligibility_rate": ratio(F.col("eligible_records"), F.col("total_records")),
        "missed_target_rate": ratio(F.col("missed_target_count"), F.greatest(F.col("eligible_records"), F.lit(1))),
    })


def diagnostic_counters() -> list[Column]:
    """What the diagnostics count on rows; sums of them over months are the table's."""
    def unreadable(raw: str, ts: str) -> Column:
        return F.count_if(F.col(raw).isNotNull() & F.col(ts).isNull() & (strip(F.col(raw)) != ""))  # few texts are stripped

    return [
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col(KEY).isNull()).alias("missing_unique_key_count"),
        unreadable("created_date", "created_ts").alias("created_date_parsing_failure_count"),
        unreadable("closed_date", "closed_ts").alias("closed_date_parsing_failure_count"),
        unreadable("due_date", "due_ts").alias("due_date_parsing_failure_count"),
        F.count_if(F.col("due_ts") < F.col("created_ts")).alias("invalid_due_sequence_count"),
        F.count_if(F.col("closed_ts") < F.col("created_ts")).alias("invalid_closed_sequence_count"),
    ]


def diagnostic_hashes() -> dict[str, Column]:
    """The compared columns as 64-bit values; NULL is a value, so a NULL and a value conflict."""
    times = {"created_date": "created_ts", "closed_date": "closed_ts", "due_date": "due_ts"}
    return {
        n: F.coalesce(F.unix_micros(F.col(times[n])), F.lit(-(2**63) + 1)) if n in times else text_hash(n)
        for n in DIAGNOSTIC_CONFLICT_COLUMNS
    }


def scope_diagnostics(typed: DataFrame) -> DataFrame:
    """Nine counts about the input of scope selection; a NULL and a value conflict."""
    require_columns(typed.columns, (KEY,) + DIAGNOSTIC_CONFLICT_COLUMNS, "Scope-selection input")
    prepared = typed.select(KEY, *[c.alias(n) for n, c in diagnostic_hashes().items()])
    conflict = None
    for n in DIAGNOSTIC_CONFLICT_COLUMNS:
        conflict = differs(n) if conflict is None else conflict | differs(n)
    return diagnostics_of(typed.agg(*diagnostic_counters()), repeated_keys(prepared, {"conflicting": conflict}))


def diagnostics_of(counts: DataFrame, repeated: DataFrame) -> DataFrame:
    """The nine counts from a one-row table of counters and ``(group_rows, conflicting)`` per repeated key."""
    keys = repeated.agg(
        total(F.col("group_rows") - 1).alias("repeated_rows"),
        F.count_if("conflicting").alias("conflicting_groups"))
    facts = rows_from(counts, [{"metric": c, "value": F.col(c)} for c in counts.columns]).unionByName(
        rows_from(keys, [{"metric": c, "value": F.col(c)} for c in keys.columns]))

    def pick(metric: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col("value")))

    missing = pick("missing_unique_key_count")
    return facts.agg(
        pick("total_records").alias("total_records"),
        missing.alias("missing_unique_key_count"),
        # NULL keys after the first count as repeats too.
        (pick("repeated_rows") + F.greatest(missing - 1, F.lit(0))).alias("duplicate_unique_key_count"),
        pick("conflicting_groups").alias("conflicting_duplicate_unique_key_count"),
        *[pick(c).alias(c) for c in counts.columns if c not in ("total_records", "missing_unique_key_count")],
    )
