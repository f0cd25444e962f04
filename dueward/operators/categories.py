"""Raw category values, their formatting variants and the status policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dueward.config import ALLOWED_STATUSES, EXCLUDED_STATUSES, PROFILE_CATEGORY_COLUMNS, ValidationRules
from dueward.functions.numbers import holds, ratio, total
from dueward.functions.shape import column_values
from dueward.functions.text import (
    collapse, comparison_form, has_leading_space, has_trailing_space, is_blank, strip,
)
from dueward.operators.profile import chronology_conditions


def value_counts(df: DataFrame, columns: Sequence[str] = PROFILE_CATEGORY_COLUMNS) -> DataFrame:
    """(column, value, rows), NULL a value of its own; one scan for all columns.

    Map-side combining leaves one buffer per distinct value and task, so a value
    shared by a third of the rows costs nothing extra.
    """
    return column_values(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("row_count"))


def category_profile(counts: DataFrame, rules: ValidationRules = ValidationRules()) -> DataFrame:
    """Every value of each column with its formatting facts; a limit keeps the most frequent ones of each column."""
    per_column = counts.groupBy("column_name").agg(
        total("row_count").alias("all_rows"), F.count("value").alias("column_distinct_count"))
    kept = counts
    if rules.maximum_profile_values_per_column is not None:
        ranked = Window.partitionBy("column_name").orderBy(F.desc("row_count"), F.asc_nulls_first("value"))
        kept = counts.withColumn("place", F.row_number().over(ranked)).where(
            F.col("place") <= rules.maximum_profile_values_per_column)
    # One row per profiled column, so this side is as small as the configuration.
    joined = kept.join(F.broadcast(per_column), "column_name")
    value, missing = F.col("value"), F.col("value").isNull()
    form = F.coalesce(comparison_form(value), F.lit("<NULL>"))
    words = [w.strip().lower() for w in rules.null_like] + [""]
    return joined.select(
        "column_name", F.coalesce(value, F.lit("<NULL>")).alias("raw_value"),
        form.alias("normalised_comparison_value"), "row_count",
        ratio(F.col("row_count"), F.col("all_rows")).alias("row_share"),
        holds(has_leading_space(value)).alias("has_leading_whitespace"),
        holds(has_trailing_space(value)).alias("has_trailing_whitespace"),
        holds(value == "").alias("is_empty"),
        holds(is_blank(value)).alias("is_whitespace_only"),
        (~missing & form.isin(words)).alias("is_null_like_string"),
        form.alias("case_variant_group"),
        (F.col("row_count") <= rules.rare_category_max_rows).alias("is_rare_category"),
        "column_distinct_count",
        (F.col("column_distinct_count") > rules.high_cardinality_threshold).alias("is_high_cardinality"),
    )


def category_variants(counts: DataFrame) -> DataFrame:
    """Spellings that share their comparison form with another one, one row per spelling."""
    value, form = F.col("value"), Window.partitionBy("column_name", "form")
    forms = counts.where(value.isNotNull()).withColumn("form", comparison_form(value)).select(
        "column_name", "form", "value", F.col("row_count").alias("variant_rows"),
        F.count(F.lit(1)).over(form).alias("raw_variant_count"), F.sum("row_count").over(form).alias("row_count"),
        (F.min(strip(value)).over(form) == F.max(strip(value)).over(form)).alias("one_stripped"),
        (F.min(collapse(value)).over(form) == F.max(collapse(value)).over(form)).alias("one_collapsed"),
    ).where("raw_variant_count > 1")
    kind = (
        F.when(F.col("one_stripped"), "whitespace").when(F.col("one_collapsed"), "repeated_whitespace")
        .otherwise("case")
    )
    return forms.select(
        "column_name", F.col("form").alias("normalised_comparison_value"), "raw_variant_count",
        F.col("value").alias("raw_variant"), "variant_rows", "row_count",
        kind.alias("variant_type"))


def variant_totals(counts: DataFrame) -> DataFrame:
    """Number of forms with several spellings, and the rows behind them, as one row."""
    value = F.col("value")
    forms = counts.where(value.isNotNull()).groupBy("column_name", comparison_form(value).alias("form")).agg(
        F.count(F.lit(1)).alias("spellings"), total("row_count").alias("row_count")).where("spellings > 1")
    return forms.agg(F.count(F.lit(1)).alias("groups"), total("row_count").alias("variant_rows"))


def status_validation(typed: DataFrame) -> DataFrame:
    """Coverage, chronology and policy per raw status."""
    rules = chronology_conditions()
    wrong = holds(rules["due_before_created"]) | holds(rules["closed_before_created"])
    grouped = typed.groupBy("status").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("due_ts").alias("due"), F.count("closed_ts").alias("closed"), F.count("created_ts").alias("created"),
        F.count_if(wrong).alias("chronology_violation_count"))
    form = F.coalesce(comparison_form(F.col("status")), F.lit("<MISSING>"))
    allowed, excluded = form.isin(list(ALLOWED_STATUSES)), form.isin(list(EXCLUDED_STATUSES))
    rows = F.col("row_count")
    # Raw statuses may be many; their total is one row beside them.
    everything = grouped.agg(F.sum("row_count").alias("all_rows")).withColumn("_one", F.lit(1))
    return grouped.withColumn("_one", F.lit(1)).join(F.broadcast(everything), "_one").select(
        F.coalesce("status", F.lit("<NULL>")).alias("status_raw"),
        form.alias("status_comparison_normalised"), "row_count",
        ratio(rows, F.col("all_rows")).alias("row_share"),
        ratio(F.col("due"), rows).alias("due_date_coverage"),
        ratio(F.col("closed"), rows).alias("closed_date_coverage"),
        ratio(F.col("created"), rows).alias("created_date_coverage"),
        "chronology_violation_count",
        F.when(allowed, "ALLOWED").when(excluded, "EXCLUDED").otherwise("UNEXPECTED").alias("step_4_policy"),
        (allowed | excluded).alias("is_expected"),
        # Action texts.
        F.when(allowed, "Preserve; apply governed status normalization only in Step 7.")
        .when(excluded, "Preserve row and keep target-ineligible under Step 4 policy.")
        .otherwise("Obtain governance decision before mapping or target construction.")
        .alias("recommended_step_7_action"),
    )
