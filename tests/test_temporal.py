import pytest

from dueward.config import Period, Scope, StabilityLimits
from dueward.operators import reconcile, temporal
from dueward.operators.silver import typed_requests

AT = Scope.of("a", "b", "2024-01-01", "2024-12-31", "2025-06-01").extracted_at


def months(requests, plan, period):
    """``plan`` lists (month, on-time rows, late rows)."""
    changes = []
    for month, on_time, late in plan:
        for i in range(on_time + late):
            changes.append({
                "created_date": f"2024-{month:02d}-05", "due_date": f"2024-{month:02d}-10",
                "closed_date": f"2024-{month:02d}-{'09' if i < on_time else '12'}"})
    return temporal.monthly_metrics(typed_requests(requests(changes)), [period], AT)


def test_missing_month_stays_visible(requests):
    table = months(requests, [(1, 3, 1)], Period.of("2024-01-01", "2024-02-29")).orderBy("month").collect()
    assert [r["total_records"] for r in table] == [4, 0]
    assert table[0]["missed_target_rate"] == 0.25 and table[1]["missed_target_rate"] is None
    found = temporal.stability_metrics(months(requests, [(1, 3, 1)], Period.of("2024-01-01", "2024-02-29"))).first()
    assert (found["expected_months"], found["active_months"], found["missing_months"]) == (2, 1, 1)


def test_largest_step_skips_empty_months(requests):
    plan = [(1, 8, 2), (2, 2, 8), (4, 5, 5)]
    found = temporal.stability_metrics(months(requests, plan, Period.of("2024-01-01", "2024-04-30"))).first()
    assert found["largest_absolute_month_to_month_target_rate_change"] == pytest.approx(0.6)
    assert found["monthly_target_rate_range"] == pytest.approx(0.6)


def test_volume_variation_is_population_based(requests):
    found = temporal.stability_metrics(
        months(requests, [(1, 10, 0), (2, 20, 0)], Period.of("2024-01-01", "2024-02-29"))).first()
    assert found["monthly_volume_coefficient_of_variation"] == pytest.approx(1 / 3)


def test_range_bounds_are_inclusive_days(requests):
    typed = typed_requests(requests([{"created_date": "2024-01-31T23:59:59"}, {"created_date": "2024-02-01T00:00:00"}]))
    table = temporal.monthly_metrics(typed, [Period.of("2024-01-15", "2024-01-31")], AT).collect()
    assert [r["total_records"] for r in table] == [1]


LIMITS = StabilityLimits(
    minimum_eligible_records=1, minimum_active_months=1, minimum_monthly_eligible_volume=1,
    minimum_complete_calendar_years=0, minimum_target_rate=0.0, maximum_target_rate=1.0)


def test_severe_range_yields_to_a_calm_part(requests):
    plan = [(1, 1, 9), (2, 9, 1), (3, 5, 5), (4, 5, 5), (5, 5, 5)]
    changes = []
    for month, on_time, late in plan:
        for i in range(on_time + late):
            changes.append({"created_date": f"2024-{month:02d}-05", "due_date": f"2024-{month:02d}-10",
                            "closed_date": f"2024-{month:02d}-{'09' if i < on_time else '12'}"})
    periods = [Period.of("2024-01-01", "2024-05-31", "wide"), Period.of("2024-03-01", "2024-05-31", "calm")]
    monthly = temporal.monthly_metrics(typed_requests(requests(changes)), periods, AT)
    compared = temporal.compare_candidates(temporal.evaluate_candidates(monthly, LIMITS), LIMITS)
    found = {r["candidate_name"]: r for r in compared.collect()}
    assert found["wide"]["decision_status"] == "REQUIRES_NARROWER_RANGE" and not found["wide"]["selected"]
    assert found["calm"]["decision_status"] == "APPROVED" and found["calm"]["selected"]
    reasons = temporal.temporal_rejections(compared).collect()
    assert [r["candidate_name"] for r in reasons] == ["wide"]
    assert "Includes an incomplete calendar year" in reasons[0]["rejection_reason"]


def test_nothing_feasible_selects_nothing(requests):
    monthly = months(requests, [(1, 3, 1)], Period.of("2024-01-01", "2024-01-31"))
    row = temporal.compare_candidates(temporal.evaluate_candidates(monthly)).first()
    assert row["decision_status"] == "NOT_FEASIBLE" and not row["selected"]
    assert "passes_eligible_record_count" in row["decision_reasons"]


def test_reconciliation(spark):
    general = spark.createDataFrame(
        [("A", "2024-01-01", "2024-12-31", 10, 8, 0.5, 0.9, 0.8)],
        "agency string, start_date string, end_date string, total_records long, eligible_target_count long, "
        "missed_target_rate double, due_date_coverage double, closed_date_coverage double")
    columns = ("start_date string, end_date string, total_records long, eligible_records long, missed_target_rate double, "
               "due_date_coverage double, closed_date_coverage double, selected string")
    good = spark.createDataFrame([("2024-01-01", "2024-12-31", 10, 8, 0.5, 0.9, 0.8, "True"),
                                  ("2023-01-01", "2024-12-31", 1, 1, 0.1, 0.1, 0.1, "false")], columns)
    reconcile.enforce_reconciled(reconcile.scope_reconcile(general, good, "A"))
    bad = spark.createDataFrame([("2024-01-01", "2024-12-31", 10, 7, 0.6, 0.9, 0.8, "true")], columns)
    row = reconcile.scope_reconcile(general, bad, "A").first()
    assert row["mismatched_columns"] == "eligible_records|missed_target_rate" and not row["is_reconciled"]
    with pytest.raises(reconcile.ScopeMismatch):
        reconcile.enforce_reconciled(reconcile.scope_reconcile(general, bad, "A"))
