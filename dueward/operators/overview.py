"""Whole-table overview: volume, distributions, date coverage and small previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dueward.config import SAMPLE_ROWS_PER_YEAR, TIMESTAMP_COLUMNS
from dueward.functions.numbers import ratio, share_pct, total
from dueward.functions.shape import column_values, rows_from, whole_table
from dueward.functions.text import nested_text
from dueward.functions.time import iso_text, month_of
from dueward.operators.keyed import KEY
from dueward.operators.silver import TYPED
from dueward.schemas import RAW_COLUMNS, ROW_ID

MISSING_LABEL = "<MISSING>"

# The eight distributions.
DISTRIBUTIONS = {
    "agency": ("agency", "agency_name"),
    "type": ("complaint_type",),
    "descriptor": ("descriptor",),
    "type_descriptor": ("complaint_type", "descriptor"),
    "status": ("status",),
    "borough": ("borough",),
    "channel": ("open_data_channel_type",),
    "location": ("location_type",),
}


def dataset_scope(typed: DataFrame) -> DataFrame:
    """Row count and creation bounds."""
    return typed.agg(
        F.count(F.lit(1)).alias("row_count"),
        iso_text(F.min("created_ts")).alias("minimum_created_date"),
        iso_text(F.max("created_ts")).alias("maximum_created_date"))


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and percentage per value combination, missing values labelled.

    The total comes from the grouped counts, themselves the result's own rows,
    through a second aggregation over them rather than a second scan.
    """
    counts = df.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL)).alias(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("record_count"))
    rows = counts.agg(total("record_count").alias("_all")).withColumn("_one", F.lit(1))
    # A one-row side, broadcast by nature of a global aggregate.
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(rows), "_one").select(
        *columns, "record_count", share_pct(F.col("record_count"), F.col("_all")).alias("record_percentage"))


def by_year(typed: DataFrame) -> DataFrame:
    """Volume per creation year; the newest year is partial unless its last second is covered."""
    years = typed.where(F.col("created_ts").isNotNull()).groupBy(F.year("created_ts").alias("created_year")).agg(
        F.count(F.lit(1)).alias("record_count"), F.max("created_ts").alias("_latest"))
    everything = whole_table()  # one row per year
    newest = F.max("created_year").over(everything)
    last_second = F.make_timestamp(F.col("created_year"), F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(59))
    return years.select(
        "created_year", "record_count",
        share_pct(F.col("record_count"), F.sum("record_count").over(everything)).alias("record_percentage"),
        ((F.col("created_year") == newest) & (F.col("_latest") < last_second)).alias("is_partial_year"))


def by_month(typed: DataFrame) -> DataFrame:
    return typed.where(F.col("created_ts").isNotNull()).groupBy(
        month_of(F.col("created_ts")).alias("created_month")).agg(F.count(F.lit(1)).alias("record_count"))


def date_coverage(typed: DataFrame, columns: Sequence[str] = TIMESTAMP_COLUMNS) -> DataFrame:
    """Bounds and presence of every date column, one scan."""
    one = typed.agg(F.count(F.lit(1)).alias("all_rows"), *[
        a for c in columns for a in (
            F.min(TYPED[c]).alias(f"{c}__min"), F.max(TYPED[c]).alias(f"{c}__max"), F.count(c).alias(f"{c}__n"))])
    missing = {c: F.col("all_rows") - F.col(f"{c}__n") for c in columns}
    return rows_from(one, [
        {"column_name": c, "minimum_date": iso_text(F.col(f"{c}__min")), "maximum_date": iso_text(F.col(f"{c}__max")),
         "non_null_count": F.col(f"{c}__n"), "missing_count": missing[c],
         "missing_percentage": share_pct(missing[c], F.col("all_rows"))} for c in columns])


def yearly_sample(typed: DataFrame, per_year: int = SAMPLE_ROWS_PER_YEAR) -> DataFrame:
    """The first rows of each creation year by (created, key), with a rank limit before the shuffle."""
    order = Window.partitionBy(F.year("created_ts")).orderBy("created_ts", KEY, ROW_ID)
    return typed.where(F.col("created_ts").isNotNull()).withColumn(
        "sample_rank", F.row_number().over(order)).where(F.col("sample_rank") <= per_year)


def canonical_text(df: DataFrame, column: str) -> Column:
    """Nested values as JSON text with keys in order, so that they can be counted and compared."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.VariantType):
        return F.to_json(F.col(column))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(F.to_variant_object(F.col(column)))
    return nested_text(F.col(column).cast("string"))


def sample_columns(sample: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Completeness and distinct values per column of a sample."""
    texts = sample.select(*[canonical_text(sample, c).alias(c) for c in columns])
    cells = column_values(texts, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    non_null = total(F.when(F.col("value").isNotNull(), F.col("n")))
    return cells.groupBy("column_name").agg(
        non_null.alias("non_null_count"), (total("n") - non_null).alias("missing_count"),
        share_pct(total("n") - non_null, total("n")).alias("missing_percentage"),
        F.count("value").alias("unique_count"))


def seeded_preview(df: DataFrame, rows: int = 5, seed: int = 42) -> DataFrame:
    """A repeatable handful of example rows."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), ROW_ID)), ROW_ID).limit(rows)


def head_preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.orderBy("created_date", KEY, ROW_ID).limit(rows)


def page_slice(df: DataFrame, limit: int, offset: int = 0, maximum: int = 50_000) -> DataFrame:
    """One ordered page for a preview; scans never page."""
    if not 1 <= limit <= maximum:
        raise ValueError(f"limit must be between 1 and {maximum}.")
    if offset < 0:
        raise ValueError("offset must not be negative.")
    return in_source_order(df).offset(offset).limit(limit)


def in_source_order(df: DataFrame) -> DataFrame:
    """Creation text, then key: a range-partitioned sort."""
    return df.orderBy(F.asc_nulls_first("created_date"), F.asc_nulls_first(KEY))


def table_facts(df: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(columns)).alias("column_count"))


def column_inventory(df: DataFrame, counters: DataFrame | None = None, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Position, name, storage type and filled rows of each column; ``counters`` is an audit's counter row, if there is one."""
    if counters is None:
        counters = df.agg(F.count(F.lit(1)).alias("all_rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing__{c}") for c in columns])
    return rows_from(counters, [
        {"column_position": i, "column_name": c, "storage_type": df.schema[c].dataType.simpleString(),
         "non_null_count": F.col("all_rows") - F.col(f"missing__{c}"), "missing_count": F.col(f"missing__{c}")}
        for i, c in enumerate(columns, 1)])


def overview_facts(typed: DataFrame) -> DataFrame:
    """The numbers behind the overview's questions, in one row.

    Distinct values are counted from (column, value) groups, so the five distinct
    counts do not multiply the rows.
    """
    columns = ("agency", "complaint_type", "descriptor", "status", "borough", "open_data_channel_type")
    groups = column_values(typed, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    per_column = groups.groupBy("column_name").agg(F.count(F.lit(1)).alias("values"))

    def values(c: str) -> Column:
        return F.max(F.when(F.col("column_name") == c, F.col("values")))

    distinct = per_column.agg(*[values(c).alias(f"{c}_values") for c in columns])
    bounds = typed.agg(F.count(F.lit(1)).alias("row_count"), F.min("created_ts").alias("lo"),
                       F.max("created_ts").alias("hi"))
    # Two one-row aggregates side by side.
    both = distinct.withColumn("_one", F.lit(1)).join(F.broadcast(bounds.withColumn("_one", F.lit(1))), "_one")
    hi = F.col("hi")
    year_end = F.make_timestamp(F.year(hi), F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(59))
    return both.select(
        "row_count", F.date_format("lo", "yyyy-MM-dd").alias("first_created_day"),
        F.date_format("hi", "yyyy-MM-dd").alias("last_created_day"),
        *[f"{c}_values" for c in columns],
        (hi < year_end).alias("latest_year_is_partial"),
        F.when((F.col("agency_values") > 1) & (F.col("complaint_type_values") > 1), "broad")
        .otherwise("narrow").alias("source_breadth"))


def extraction_metadata(typed: DataFrame, source: str, extracted_at: str, page_size: int) -> DataFrame:
    """One provenance row: counts, bounds, ordering and the pages a download would take."""
    return typed.agg(
        F.count(F.lit(1)).alias("row_count"),
        iso_text(F.min("created_ts")).alias("minimum_created_date"),
        iso_text(F.max("created_ts")).alias("maximum_created_date"),
    ).select(
        F.lit(source).alias("source"), F.lit(extracted_at).alias("extraction_timestamp"), "row_count",
        "minimum_created_date", "maximum_created_date",
        F.lit("created_date ASC, unique_key ASC").alias("ordering"), F.lit(page_size).alias("page_size"),
        F.ceil(ratio(F.col("row_count"), F.lit(page_size))).cast("bigint").alias("page_count"))
