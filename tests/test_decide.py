"""The decision and label pipeline on files."""

import tempfile

from dueward.config import Period, Scope, ScopeLimits, StabilityLimits
from dueward.operators.silver import typed_requests
from dueward.plans.decide import decide_range, selected_scope, write_label
from dueward.sources.report_tables import LABEL_TABLES

LIMITS = StabilityLimits(
    minimum_eligible_records=1, minimum_active_months=1, minimum_monthly_eligible_volume=1,
    minimum_complete_calendar_years=0, minimum_target_rate=0.0, maximum_target_rate=1.0)


def test_range_then_label(spark, requests):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    typed = typed_requests(requests([
        {}, {"closed_date": "2024-01-11"}, {"status": "Open", "closed_date": None},
        {"unique_key": "d"}, {"unique_key": "d", "closed_date": "2024-01-20"}, {"due_date": None}]))
    at = Scope.of("x", "y", "2024-01-01", "2024-01-02", "2024-06-01").extracted_at
    tables = decide_range(typed, "DSNY", "Graffiti", [Period.of("2024-01-01", "2024-01-31")], at, LIMITS)
    scope = selected_scope(tables["temporal_stability_summary"], "DSNY", "Graffiti", at)
    assert (scope.start.isoformat(), scope.end.isoformat()) == ("2024-01-01", "2024-01-31")
    assert tables["selected_scope_monthly_metrics"].count() == 1
    write_label(typed, scope, root)
    summary = spark.read.parquet(f"{root}/parquet/target_summary").first()
    assert (summary["target_eligible_rows"], summary["missed_count"]) == (2, 1)
    conflicts = spark.read.parquet(f"{root}/parquet/conflicting_duplicate_summary").first()
    assert conflicts["conflicting_fields"] == "closed_date"
    assert all(spark.read.parquet(f"{root}/parquet/{name}") is not None for name in LABEL_TABLES)
    assert spark.read.parquet(f"{root}/governed").count() == 6
