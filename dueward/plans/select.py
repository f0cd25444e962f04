"""The request store to every table of the scope selection."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from dueward.config import Period, ScopeLimits
from dueward.operators import scope
from dueward.operators.silver import in_months
from dueward.sources import store
from dueward.sources.report_tables import write_tables

#: The tables that the selection writes.
SELECTION_TABLES = (
    "agency_summary", "type_summary", "type_decision", "agency_discovery", "general_candidates",
    "selected_monthly", "selected_yearly", "sensitivity", "target_population",
)


def complete_months(spark: SparkSession, root: str, extracted_at: datetime, first: date | None = None, last: date | None = None) -> DataFrame:
    """Stored gold up to the latest complete month, and within ``first`` and ``last`` if they are given."""
    gold = store.read(spark, root, "gold")
    bounded = gold if first is None or last is None else in_months(gold, first, last)
    newest = store.read(spark, root, "gold").selectExpr("max(last_created_date)")
    return scope.up_to_complete_month(bounded, extracted_at, newest)


def select_scope(spark: SparkSession, root: str, agency: str, periods: Sequence[Period], selected: Period, extracted_at: datetime,
                 limits: ScopeLimits = ScopeLimits()) -> dict[str, DataFrame]:
    """Every table from the store at ``root``; no source row is read.

    Agencies and types are judged on all stored months, date ranges on months that are complete at ``extracted_at``.
    Decisions and candidates are written first and read back, so later tables do not repeat them.
    """
    gold, complete = store.read(spark, root, "gold"), complete_months(spark, root, extracted_at)
    cutoff = scope.recent_cutoff(extracted_at, limits.recent_activity_months)

    def written(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        write_tables(tables, (), root)
        return {name: spark.read.parquet(f"{root}/parquet/{name}") for name in tables}

    done = written({"agency_summary": store.agency_summary(spark, root), "type_summary": scope.type_summary(gold, cutoff)})
    done |= written({"type_decision": scope.type_decision(done["type_summary"], limits)})
    agencies, decided = done["agency_summary"], done["type_decision"]
    done |= written({
        "agency_discovery": scope.with_viable_population(scope.agency_discovery(agencies, limits, cutoff), decided),
        "general_candidates": scope.general_candidates(complete, decided, agency, periods, limits),
        "selected_monthly": scope.selected_monthly(complete, decided, agency, selected),
        "sensitivity": scope.sensitivity(complete, agency, selected, limits),
        "target_population": scope.target_population(agencies),
    })
    return done | written({"selected_yearly": scope.selected_yearly(done["selected_monthly"])})
