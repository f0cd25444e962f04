"""Typed columns beside the untouched raw text."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from dueward.config import TIMESTAMP_COLUMNS
from dueward.functions.shape import computed_once
from dueward.functions.time import month_of, month_start, parse_timestamp
from dueward.schemas import RAW_COLUMNS, ROW_ID, ROW_PLACE

#: Rows of one stored file: about 128 MB of typed requests.
ROWS_PER_FILE = 1_000_000
#: Rows that one task reads of a stored table.
ROWS_PER_TASK = 500_000
KEY = "unique_key"
TYPED = {
    "created_date": "created_ts",
    "closed_date": "closed_ts",
    "due_date": "due_ts",
    "resolution_action_updated_date": "updated_ts",
}


def typed_requests(raw: DataFrame) -> DataFrame:
    """Add one UTC timestamp per timestamp column; raw columns stay as they came.

    Parsing text cannot be pushed into a Parquet scan, so a run is written once
    in this form and later filters work on the typed columns.
    """
    return computed_once(raw, {
        TYPED[c]: parse_timestamp(F.col(c)) for c in TIMESTAMP_COLUMNS if c in raw.columns
    })


def stored_names(df: DataFrame) -> list[str]:
    """The columns a run came with: without its row identity and what was derived here."""
    return [c for c in df.columns if c not in (*TYPED.values(), ROW_ID, ROW_PLACE, "created_month")]


def with_placeholders(typed: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Absent columns as NULLs of their type, so that every check can run and the schema check can report them."""
    absent = {c: F.lit(None).cast("string") for c in columns if c not in typed.columns}
    absent |= {t: F.lit(None).cast("timestamp") for c, t in TYPED.items() if c in columns and t not in typed.columns}
    return typed.withColumns(absent) if absent else typed


def by_creation_month(raw: DataFrame) -> DataFrame:
    """The typed form with the month that its stored layout is partitioned by; unreadable creation times have none."""
    return typed_requests(raw).withColumn("created_month", month_of(F.col("created_ts")))


def write_silver(silver: DataFrame, path: str, *, mode: str = "errorifexists", rows_per_file: int = ROWS_PER_FILE,
                 rows: int | None = None) -> None:
    """Store :func:`by_creation_month` rows, clustered so that a month has about ``its rows / rows_per_file`` files.

    Rows are dealt by ranges of (month, key hash): a task holds few months, a month few tasks, and a large month is split
    by its keys. ``overwrite`` replaces the months that occur in ``silver`` and no other. ``rows`` saves the count.
    """
    rows = silver.count() if rows is None else rows
    tasks = max(1, -(-rows // rows_per_file))
    spread = F.xxhash64(*(c for c in (KEY, ROW_ID) if c in silver.columns))
    ranged = silver.withColumn("_spread", spread).repartitionByRange(tasks, F.col("created_month"), F.col("_spread"))
    ranged.sortWithinPartitions("created_month", "_spread").drop("_spread").write.mode(mode).option(
        "partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy("created_month").parquet(path)


def read_by_month(spark: SparkSession, path: str) -> DataFrame:
    """A table stored by ``created_month``, which is a date also where every row lacks one."""
    rows = spark.read.parquet(path)
    if rows.schema["created_month"].dataType == DateType():
        return rows
    return rows.withColumn("created_month", F.col("created_month").cast("date"))


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    return read_by_month(spark, path)


def in_few_tasks(rows: DataFrame, count: int) -> DataFrame:
    """Stored rows read by tasks of about ``ROWS_PER_TASK`` rows, however many small files hold them; no row moves.

    A task groups what it reads before it shuffles, so the groups shuffled follow the rows and not the files.
    """
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // ROWS_PER_TASK)))


def in_months(rows: DataFrame, first: date, last: date) -> DataFrame:
    """Prune stored creation months; a table without that column passes unchanged."""
    if "created_month" not in rows.columns:
        return rows
    return rows.where(F.col("created_month").between(F.lit(month_start(first)), F.lit(last)))


def with_row_id(df: DataFrame) -> DataFrame:
    """Name each stored row by file and position, which a re-run reproduces, and number it in that order.

    Files count by the number in their name, others by a hash of their path.
    """
    if ROW_ID in df.columns:
        return df
    path, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    numbered = F.regexp_extract(path, r"part-(\d{1,7})[^/]*$", 1)
    file_number = F.when(numbered != "", numbered.cast("bigint")).otherwise(F.pmod(F.xxhash64(path), F.lit(1 << 23)))
    return df.select(
        *df.columns, F.concat_ws("#", path, at.cast("string")).alias(ROW_ID),
        (F.shiftleft(file_number, 40) + at).alias(ROW_PLACE),
    )
