"""Exact copies and conflicting keys, reported without removing a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueward.config import MATERIAL_COLUMNS, OVERVIEW_CONFLICT_COLUMNS
from dueward.functions.numbers import percentage, total
from dueward.functions.shape import rows_from
from dueward.operators.keyed import (
    KEY, differs, present_hash, repeated_keys, row_signature, text_hash,
)
from dueward.schemas import RAW_COLUMNS, ROW_ID


def material_facts(raw: DataFrame, columns: Sequence[str] = MATERIAL_COLUMNS, *, canonical: bool = False) -> DataFrame:
    """Repeated keys with the raw columns that differ inside each group.

    Columns are compared by a 64-bit hash of their text, NULL being a value, so
    the shuffle carries two longs per column however long the text.
    """
    keep = (ROW_ID,) if canonical else ()
    prepared = raw.select(KEY, *keep, *[text_hash(c).alias(c) for c in columns])
    facts = repeated_keys(prepared, {f"{c}__differs": differs(c) for c in columns}, canonical=canonical)
    changed = F.array_compact(F.array(*[F.when(F.col(f"{c}__differs"), F.lit(c)) for c in columns]))
    return facts.select(
        KEY, "group_rows", F.array_join(changed, "|").alias("conflicting_fields"),
        *(["canonical_id"] if canonical else []),
    )


def full_row_duplicates(raw: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Rows in groups equal in every column (NULLs equal), and the groups."""
    return _repeated_rows(_whole_rows(raw, columns))


def _repeated_rows(groups: DataFrame) -> DataFrame:
    return groups.where("n > 1").agg(
        F.count(F.lit(1)).alias("duplicate_groups"), total("n").alias("duplicate_rows"),
        total(F.col("n") - 1).alias("excess_rows"))


def _whole_rows(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per distinct row. Two 64-bit hashes stand for the row, so no text is shuffled."""
    first, second = row_signature((), columns)
    return raw.select(first.alias("h1"), second.alias("h2")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))


def duplicate_summary(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """The seven duplicate metrics, from the key totals and rows per distinct row."""
    whole = _repeated_rows(groups).select(F.lit("duplicate_full_rows").alias("metric"), F.col("duplicate_rows").alias("row_count"))
    metrics = ("duplicate_unique_key_groups", "rows_in_duplicate_key_groups", "redundant_exact_duplicate_rows",
               "conflicting_duplicate_keys", "rows_in_conflicting_groups", "missing_unique_key_rows")
    return whole.unionByName(rows_from(keys, [{"metric": c, "row_count": F.col(c)} for c in metrics]))


def exact_duplicates(raw: DataFrame) -> DataFrame:
    """Members of groups without a conflict; exactly one per group is canonical.

    The inner join meets repeated keys only, so a runtime filter can drop all other rows before they are shuffled.
    """
    facts = material_facts(raw, canonical=True).where("conflicting_fields = ''")
    return raw.select(KEY, ROW_ID).join(facts, KEY).select(
        KEY, F.col("group_rows").alias("duplicate_group_size"), (F.col(ROW_ID) == F.col("canonical_id")).alias("canonical_row"), ROW_ID)


def conflicting_duplicates(raw: DataFrame) -> DataFrame:
    """Members of conflicting groups with their raw values and the fields in conflict."""
    facts = material_facts(raw).where("conflicting_fields <> ''")
    return raw.select(KEY, ROW_ID, *MATERIAL_COLUMNS).join(facts, KEY).select(
        KEY, F.col("group_rows").alias("duplicate_group_size"), "conflicting_fields", ROW_ID, *MATERIAL_COLUMNS)


# ---- the source audit's view ------------------------------------------------

def duplicate_groups(raw: DataFrame) -> DataFrame:
    """Keys held by more than one row."""
    return repeated_keys(raw.select(KEY), {}).select(KEY, F.col("group_rows").alias("record_count"))


def conflicting_keys(raw: DataFrame, columns: Sequence[str] = OVERVIEW_CONFLICT_COLUMNS) -> DataFrame:
    """Repeated keys with more than one known value in a field; a NULL never conflicts here."""
    prepared = raw.select(KEY, *[present_hash(c).alias(c) for c in columns])
    facts = repeated_keys(prepared, {f"{c}__differs": differs(c) for c in columns})
    fields = F.array_compact(F.array(*[F.when(F.col(f"{c}__differs"), F.lit(c)) for c in columns]))
    return facts.withColumn("fields", fields).where(F.size("fields") > 0).select(
        F.col(KEY).alias("duplicate_unique_key"), F.col("group_rows").alias("record_count"),
        F.size("fields").alias("conflicting_field_count"),
        F.array_join("fields", ", ").alias("conflicting_fields"))


def audit_duplicates(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """The audit's eight duplicate rows, from the key totals and rows per distinct row; senseless shares are NULL."""
    counts = {
        "null_unique_key": "missing_unique_key_rows", "duplicated_unique_key_groups": "duplicate_unique_key_groups",
        "rows_in_duplicate_id_groups": "rows_in_duplicate_key_groups", "excess_duplicate_id_rows": "excess_duplicate_rows",
        "maximum_records_for_one_unique_key": "most_rows_of_a_key", "conflicting_duplicate_ids": "audit_conflicting_keys",
    }
    unshared = ("duplicated_unique_key_groups", "maximum_records_for_one_unique_key", "conflicting_duplicate_ids")
    first = rows_from(keys, [
        {"check_name": name, "status": "computed", "affected_count": F.col(c),
         "affected_percentage": F.lit(None).cast("double") if name in unshared else percentage(F.col(c), F.col("all_rows"))}
        for name, c in counts.items()
    ])
    by_row = groups.agg(
        total("n").alias("all_rows"),
        total(F.when(F.col("n") > 1, F.col("n"))).alias("exact_duplicate_rows"),
        total(F.when(F.col("n") > 1, F.col("n") - 1)).alias("excess_exact_duplicate_rows"))
    second = rows_from(by_row, [
        {"check_name": c, "status": "computed", "affected_count": F.col(c),
         "affected_percentage": percentage(F.col(c), F.col("all_rows"))}
        for c in ("exact_duplicate_rows", "excess_exact_duplicate_rows")
    ])
    return first.unionByName(second)
