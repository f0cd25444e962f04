"""Raw validation, column by column: structure, missing values and timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dueward.config import TIMESTAMP_COLUMNS, Scope, ValidationRules
from dueward.functions.numbers import holds, ratio, total
from dueward.functions.shape import evidence, rows_from
from dueward.functions.text import is_blank, is_null_like
from dueward.functions.time import at, is_zoned, iso_text
from dueward.operators.keyed import KEY
from dueward.operators.roles import role_of
from dueward.operators.silver import TYPED
from dueward.schemas import DEFAULT_SEMANTIC_TYPE, RAW_COLUMNS, ROW_ID, ROW_PLACE, SEMANTIC_TYPES


# ---- structure --------------------------------------------------------------

def schema_table(df: DataFrame, required: Sequence[str] = RAW_COLUMNS,
                 selected: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """One row per stored column, from the schema alone."""
    rows = [
        (f.name, i, f.dataType.simpleString(), f.name in required, f.name in selected,
         SEMANTIC_TYPES.get(f.name, DEFAULT_SEMANTIC_TYPE), "PASS" if f.name in selected else "WARN")
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, position int, raw_dtype string, required boolean, "
              "selected_in_metadata boolean, semantic_type string, status string")


def column_profile(cells: DataFrame, rows: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Counts, distinct values, the first three values and parseability per column.

    From the distinct cells of ``rows``, which stand under two hashes with the first place of each. Only the texts that
    are shown are fetched: three rows a column at most, by place.
    """
    own = cells.where(F.col("column_name").isin(list(columns)))
    known = F.col("h1").isNotNull()
    counts = own.groupBy("column_name").agg(
        total(F.when(known, F.col("n"))).alias("non_null_count"),
        total(F.when(~known, F.col("n"))).alias("null_count"),
        F.count_if(known).alias("distinct_count"),
        total(F.when(known & F.col("readable"), F.col("n"))).alias("parseable_count"))
    first = Window.partitionBy("column_name").orderBy("first_place", "h1")
    shown = own.where(known).withColumn("place", F.row_number().over(first)).where("place <= 3").select(
        "column_name", "h1", "first_place", "place")
    at = F.col(ROW_PLACE if ROW_PLACE in rows.columns else ROW_ID)
    fetched = rows.withColumn("_at", at).join(F.broadcast(shown), F.col("_at") == F.col("first_place"))
    value = F.element_at(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]), F.col("column_name"))
    texts = fetched.select("column_name", "place", "h1", value.alias("value")).where(F.xxhash64("value") == F.col("h1")).distinct()
    samples = texts.groupBy("column_name").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]), " | ").alias("sample_values"))
    fixed = rows.sparkSession.createDataFrame(
        [(c, rows.schema[c].dataType.simpleString(), SEMANTIC_TYPES.get(c, DEFAULT_SEMANTIC_TYPE)) for c in columns],
        "column_name string, raw_dtype string, expected_semantic_type string")
    joined = fixed.join(counts, "column_name", "left").join(samples, "column_name", "left").na.fill(
        {"non_null_count": 0, "null_count": 0, "distinct_count": 0, "parseable_count": 0, "sample_values": ""})
    failures = F.col("non_null_count") - F.col("parseable_count")
    return joined.select(
        "column_name", "raw_dtype", "non_null_count", "null_count", "distinct_count", "sample_values", "expected_semantic_type",
        "parseable_count", failures.alias("parse_failure_count"),
        F.when(failures == 0, "PASS").otherwise("WARN").alias("validation_status"),
    )


# ---- scope ------------------------------------------------------------------

def scope_counters(scope: Scope) -> dict[str, Column]:
    """Rows outside the authoritative scope; a NULL agency or type is outside."""
    created = F.col("created_ts")
    return {
        "out_of_scope_agency": F.count_if(~holds(F.col("agency") == scope.agency)),
        "out_of_scope_complaint_type": F.count_if(~holds(F.col("complaint_type") == scope.complaint_type)),
        "before_start": F.count_if(created < at(scope.start)),
        "after_end": F.count_if(created >= at(scope.end_exclusive)),
        "unparseable_created_date": F.count_if(created.isNull()),
    }


def scope_expectations(scope: Scope) -> dict[str, str]:
    return {
        "out_of_scope_agency": scope.agency,
        "out_of_scope_complaint_type": scope.complaint_type or "",
        "before_start": scope.start.isoformat(),
        "after_end": scope.end.isoformat(),
        "unparseable_created_date": "0",
    }


def scope_validation(typed: DataFrame, scope: Scope) -> DataFrame:
    one = typed.agg(F.count(F.lit(1)).alias("all_rows"), *[c.alias(n) for n, c in scope_counters(scope).items()])
    return rows_from(one, [
        {"scope_rule": name, "affected_row_count": F.col(name),
         "affected_row_rate": ratio(F.col(name), F.col("all_rows")), "expected_value": expected,
         "status": F.when(F.col(name) == 0, "PASS").otherwise("FAIL"), "severity": "CRITICAL"}
        for name, expected in scope_expectations(scope).items()
    ])


# ---- missing values ---------------------------------------------------------

MISSING_KINDS = ("null", "empty", "blank", "null_like")


def missing_counters(columns: Sequence[str], words: Sequence[str]) -> dict[str, Column]:
    """NULL, empty, blank and null-like counts per column: disjoint, and one scan for all."""
    counters = {}
    for c in columns:
        text = F.col(c).cast("string")
        counters[f"{c}__null"] = F.count_if(text.isNull())
        counters[f"{c}__empty"] = F.count_if(text == "")
        counters[f"{c}__blank"] = F.count_if(is_blank(text))
        counters[f"{c}__null_like"] = F.count_if(is_null_like(text, words))
    return counters


def missing_kind(text: Column, words: Sequence[str]) -> Column:
    """The place in ``MISSING_KINDS`` of a value, NULL for any other value."""
    return F.when(text.isNull(), 0).when(text == "", 1).when(is_blank(text), 2).when(is_null_like(text, words), 3)


def missing_of(values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The :func:`missing_counters` as one row, from ``(column_name, kind, n)`` of distinct values."""
    counts = values.where(F.col("column_name").isin(list(columns)) & F.col("kind").isNotNull()).groupBy("column_name", "kind").agg(
        total("n").alias("n"))
    return counts.agg(*[total(F.when((F.col("column_name") == c) & (F.col("kind") == k), F.col("n"))).alias(f"{c}__{name}")
                        for c in columns for k, name in enumerate(MISSING_KINDS)])


def missing_policy(column: str, nulls: Column) -> tuple[Column, Column]:
    """Severity and recommended action, by column and role."""
    role = role_of(column)
    # Severities and action texts of the report contract.
    if column in ("unique_key", "created_date"):
        found = "CRITICAL", "Quarantine affected rows; do not synthesize identifiers or creation time."
    elif column == "due_date":
        found = "ERROR", "Preserve rows and mark target-ineligible; do not impute due dates."
    elif column == "closed_date":
        found = "WARNING", "Preserve rows and mark target-ineligible; do not impute closure time."
    elif column in ("latitude", "longitude", "incident_zip"):
        found = "WARNING", "Preserve complaint; handle the geographic feature as missing."
    elif role in ("POST_CREATION_FIELD", "CONDITIONAL_FEATURE"):
        found = "WARNING", "Preserve nulls until an explicit Step 7 field policy is approved."
    else:
        found = "INFO", "Preserve source nulls unless Step 7 approves a deterministic rule."
    none = nulls == 0
    return (F.when(none, "INFO").otherwise(found[0]),
            F.when(none, "No missing-value action required.").otherwise(found[1]))


def missingness(df: DataFrame, columns: Sequence[str] = RAW_COLUMNS,
                rules: ValidationRules = ValidationRules()) -> DataFrame:
    return missingness_of(df.agg(F.count(F.lit(1)).alias("all_rows"),
                                 *[c.alias(n) for n, c in missing_counters(columns, rules.null_like).items()]), columns)


def missingness_of(one: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """The missing-value table from its counter row."""
    rows = []
    for c in columns:
        nulls = F.col(f"{c}__null")
        severity, action = missing_policy(c, nulls)
        rows.append({
            "column_name": c, "column_role": role_of(c), "row_count": F.col("all_rows"),
            "non_null_count": F.col("all_rows") - nulls, "null_count": nulls,
            "null_rate": ratio(nulls, F.col("all_rows")),
            "empty_string_count": F.col(f"{c}__empty"), "whitespace_only_count": F.col(f"{c}__blank"),
            "null_like_string_count": F.col(f"{c}__null_like"),
            "missingness_severity": severity, "recommended_step_7_action": action,
        })
    return rows_from(one, rows)


# ---- timestamps -------------------------------------------------------------

def timestamp_profile(typed: DataFrame, columns: Sequence[str] = TIMESTAMP_COLUMNS) -> DataFrame:
    """Parse success, offset kind, bounds and the first five bad values per column."""
    counters = []
    for c in columns:
        raw, ts = F.col(c), F.col(TYPED[c])
        counters += [
            F.count(raw).alias(f"{c}__present"),
            F.count(ts).alias(f"{c}__parsed"),
            F.count_if(ts.isNotNull() & is_zoned(raw)).alias(f"{c}__aware"),
            F.min(ts).alias(f"{c}__min"), F.max(ts).alias(f"{c}__max"),
        ]
    one = typed.agg(*counters)
    table = rows_from(one, [
        {"column_name": c,
         "non_null_count": F.col(f"{c}__present"), "parse_success_count": F.col(f"{c}__parsed"),
         "parse_failure_count": F.col(f"{c}__present") - F.col(f"{c}__parsed"),
         "parse_success_rate": F.when(F.col(f"{c}__present") == 0, 1.0).otherwise(
             ratio(F.col(f"{c}__parsed"), F.col(f"{c}__present"))),
         "timezone_aware_count": F.col(f"{c}__aware"),
         "timezone_naive_count": F.col(f"{c}__parsed") - F.col(f"{c}__aware"),
         "minimum_timestamp": iso_text(F.col(f"{c}__min")), "maximum_timestamp": iso_text(F.col(f"{c}__max"))}
        for c in columns
    ])
    examples = invalid_timestamps(typed, columns, limit=5).groupBy("column_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "raw_value"))),
                                 lambda s: s["raw_value"]), " | ").alias("invalid_value_examples"))
    return table.join(examples, "column_name", "left").na.fill({"invalid_value_examples": ""})


def invalid_timestamps(typed: DataFrame, columns: Sequence[str] = TIMESTAMP_COLUMNS, limit: int = 10) -> DataFrame:
    """The first unreadable values of each column, in source order, as examples."""
    bad = evidence(typed, (KEY, ROW_ID), [
        (F.col(c).isNotNull() & F.col(TYPED[c]).isNull(), {"column_name": c, "raw_value": F.col(c)})
        for c in columns
    ])
    order = Window.partitionBy("column_name").orderBy(ROW_ID)
    return bad.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select(
        "column_name", KEY, "raw_value", "place")


# ---- chronology -------------------------------------------------------------

# Severity and action per rule; the last two appear only when violated.
CHRONOLOGY_RULES = {
    "due_before_created": (
        "ERROR", "Retain as excluded/quarantine evidence; do not repair automatically."),
    "closed_before_created": (
        "ERROR", "Retain as excluded/quarantine evidence; do not repair automatically."),
    "resolution_action_before_created": (
        "WARNING", "Review source timing; do not use the post-creation field as a feature."),
    "closed_present_created_invalid": (
        "ERROR", "Quarantine row because chronology cannot be established."),
    "due_present_created_invalid": (
        "ERROR", "Quarantine row because chronology cannot be established."),
}


def chronology_conditions() -> dict[str, Column]:
    created = F.col("created_ts")
    return {
        "due_before_created": F.col("due_ts") < created,
        "closed_before_created": F.col("closed_ts") < created,
        "resolution_action_before_created": F.col("updated_ts") < created,
        "closed_present_created_invalid": F.col("closed_date").isNotNull() & created.isNull(),
        "due_present_created_invalid": F.col("due_date").isNotNull() & created.isNull(),
    }


def chronology_violations(typed: DataFrame) -> DataFrame:
    """One evidence row per (request, violated rule), with the raw values."""
    raw = [F.col(c).alias(f"{c}_raw") for c in
           ("created_date", "due_date", "closed_date", "resolution_action_updated_date")]
    return evidence(typed, (KEY, *raw), [
        (condition, {"violation_type": name, "severity": CHRONOLOGY_RULES[name][0],
                     "recommended_step_7_action": CHRONOLOGY_RULES[name][1]})
        for name, condition in chronology_conditions().items()
    ])


