"""Two independent scope analyses must name the same range with the same numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueward.functions.numbers import holds
from dueward.functions.shape import rows_from
from dueward.functions.text import truth
from dueward.operators.temporal import temporal_rejections
from dueward.schemas import require_columns

# Compared columns and tolerances.
COUNTS = ("total_records", "eligible_records")
RATES = ("missed_target_rate", "due_date_coverage", "closed_date_coverage")
IDENTIFIERS = (
    "selected_agency", "selected_complaint_type", "selected_start_date", "selected_end_date", "extraction_timestamp",
)
RELATIVE, ABSOLUTE = 1e-9, 1e-12
GENERAL_NAMES = {"total_records": "total_records", "eligible_records": "eligible_target_count"}


class ScopeMismatch(ValueError):
    """Scope artifacts contradict one another."""


def close(left: Column, right: Column) -> Column:
    return F.abs(left.cast("double") - right.cast("double")) <= ABSOLUTE + RELATIVE * F.abs(right.cast("double"))


def scope_reconcile(general: DataFrame, temporal: DataFrame, agency: str) -> DataFrame:
    """The temporal pick beside its general candidate, with every column that disagrees.

    One row when both sides are sound; ``selected_rows`` and ``matching_candidates``
    say when they are not.
    """
    require_columns(general.columns, ("agency", "start_date", "end_date", "eligible_target_count") + RATES, "General candidates")
    require_columns(temporal.columns, ("start_date", "end_date", "selected") + COUNTS + RATES, "Temporal candidates")
    chosen = temporal.where(truth(F.col("selected"))).select(
        F.lit(agency).alias("agency"), F.col("start_date").cast("date").alias("start_date"),
        F.col("end_date").cast("date").alias("end_date"), *[F.col(c).alias(f"t_{c}") for c in COUNTS + RATES])
    candidate = general.select(
        "agency", F.col("start_date").cast("date").alias("start_date"), F.col("end_date").cast("date").alias("end_date"),
        *[F.col(GENERAL_NAMES[c]).alias(f"g_{c}") for c in COUNTS], *[F.col(c).alias(f"g_{c}") for c in RATES],
        F.lit(1).alias("matched"))
    joined = chosen.join(candidate, ["agency", "start_date", "end_date"], "left")
    wrong = [F.when(~holds(F.col(f"g_{c}") == F.col(f"t_{c}")), F.lit(c)) for c in COUNTS]
    wrong += [F.when(~holds(close(F.col(f"g_{c}"), F.col(f"t_{c}"))), F.lit(c)) for c in RATES]
    compared = joined.withColumn("mismatches", F.array_join(F.array_compact(F.array(*wrong)), "|"))
    return compared.groupBy("agency", "start_date", "end_date").agg(
        F.count("matched").alias("matching_candidates"), F.max("mismatches").alias("mismatched_columns"),
        *[F.max(f"t_{c}").alias(c) for c in COUNTS]
    ).withColumn("is_reconciled", (F.col("matching_candidates") == 1) & (F.col("mismatched_columns") == ""))


def enforce_reconciled(reconciled: DataFrame) -> None:
    """Exactly one selected range, matched once, without a mismatch."""
    rows = reconciled.limit(2).collect()
    if len(rows) != 1:
        raise ScopeMismatch("The temporal comparison must select exactly one candidate.")
    row = rows[0]
    if row["matching_candidates"] != 1:
        raise ScopeMismatch("The temporal selection must match exactly one general candidate.")
    if row["mismatched_columns"]:
        raise ScopeMismatch(f"Selected-scope mismatch: {row['mismatched_columns']}")


def scope_outputs_check(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two one-row scope summaries compared field by field; any other number of rows is an error."""
    needed = IDENTIFIERS + COUNTS + RATES
    tables = []
    for df, tag in ((first, "a"), (second, "b")):
        require_columns(df.columns, needed, "Scope summary")
        if len(df.select(needed[0]).limit(2).collect()) != 1:
            raise ScopeMismatch("A scope summary must have exactly one row.")
        tables.append(df.select(*[F.col(c).cast("string").alias(f"{tag}_{c}") for c in needed]).withColumn("_one", F.lit(1)))
    both = tables[0].join(tables[1], "_one")

    def same(c: str) -> Column:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        if c in ("selected_start_date", "selected_end_date"):
            return holds(a.cast("date") == b.cast("date"))
        if c in COUNTS:
            return holds(a.cast("bigint") == b.cast("bigint"))
        return holds(close(a, b)) if c in RATES else holds(a == b)

    return rows_from(both, [
        {"field": c, "first_value": F.col(f"a_{c}"), "second_value": F.col(f"b_{c}"), "agrees": same(c)}
        for c in needed])


def general_rejections(general: DataFrame, compared: DataFrame) -> DataFrame:
    """General candidates that the temporal comparison did not choose, with its reasons; each needs exactly one.

    A candidate without temporal evidence fails the job.
    """
    evidence = temporal_rejections(compared).select(
        F.col("start_date").cast("date").alias("start_date"), F.col("end_date").cast("date").alias("end_date"),
        F.lit(False).alias("chosen"), "decision_status", F.col("rejection_reason").alias("rejection_reasons"))
    chosen = compared.where(truth(F.col("selected"))).select(
        F.col("start_date").cast("date").alias("start_date"), F.col("end_date").cast("date").alias("end_date"),
        F.lit(True).alias("chosen"), "decision_status", F.lit("").alias("rejection_reasons"))
    once = evidence.unionByName(chosen).groupBy("start_date", "end_date").agg(
        F.count(F.lit(1)).alias("n"), F.max("chosen").alias("chosen"), F.first("decision_status").alias("decision_status"),
        F.first("rejection_reasons").alias("rejection_reasons"))
    joined = general.join(once, ["start_date", "end_date"], "left").where(~holds(F.col("chosen")))
    checked = F.when(F.col("n") == 1, F.col("decision_status")).otherwise(
        F.raise_error(F.lit("A rejected candidate needs exactly one row of temporal evidence.")).cast("string"))
    return joined.select(
        "candidate_id", "candidate_name", "agency",
        F.concat(F.col("start_date").cast("string"), F.lit(" to "), F.col("end_date").cast("string")).alias("date_range"),
        "complaint_type_count", "eligible_target_count", "due_date_coverage", "closed_date_coverage",
        "missed_target_rate", checked.alias("decision_status"), "rejection_reasons", "scope_score")
