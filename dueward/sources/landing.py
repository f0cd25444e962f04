"""Landed source pages: JSON arrays, or one JSON object per line; positions are kept either way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dueward.schemas import RAW_COLUMNS, RAW_SCHEMA, ROW_ID, ROW_PLACE

PAGE = ("page_number", "offset", "requested_limit")
PAGE_COLUMNS = (*PAGE, "pos")
#: A JSON array cannot be split, so a larger one must be landed as lines.
MAX_ARRAY_BYTES = 64 << 20
LINES = (".jsonl", ".ndjson")


class LandingRejected(RuntimeError):
    """Landed files that must not be read."""


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length, by_line)`` of every page file, from the listing alone; no content is read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    by_line = F.lit(False)
    for ending in LINES:
        by_line = by_line | F.col("path").endswith(ending)
    return files.withColumn("by_line", by_line)


def guard_sizes(spark: SparkSession, folder: str, limit: int = MAX_ARRAY_BYTES) -> None:
    """Reject arrays beyond ``limit`` before any row is read."""
    large = landed_files(spark, folder).where(~F.col("by_line") & (F.col("length") > limit))
    found = [f"{r.path} ({r.length} bytes)" for r in large.orderBy(F.desc("length")).limit(5).collect()]
    if found:
        raise LandingRejected(f"Pages beyond {limit} bytes must be landed as lines: " + ", ".join(found))


def _array_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page, pos, record) of pages that are one JSON array; their size is bounded by the guard."""
    pages = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    return pages.select(*[F.col(c).cast("bigint") for c in PAGE], F.posexplode(F.from_json("value", "array<string>")).alias("pos", "record"))


def _line_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page, pos, record) of pages with a JSON object per line; a large file is read in blocks by many tasks.

    A block's rows are numbered as they are read. Counts per block, few rows, give each block its first position, so no
    page is gathered or sorted.
    """
    text = spark.read.option("pathGlobFilter", "*{" + ",".join(LINES) + "}").text(folder)
    rows = text.select(*[F.col(c).cast("bigint") for c in PAGE], F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_seq"), F.col("value").alias("record")).where(F.trim("record") != "")
    blocks = rows.groupBy(*PAGE, "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first"))
    before = Window.partitionBy(*PAGE).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*PAGE, "_block", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, [*PAGE, "_block"]).select(*PAGE, (F.col("_start") + F.col("_seq") - F.col("_first")).alias("pos"), "record")


def read_landed(spark: SparkSession, folder: str, columns: Sequence[str] = RAW_COLUMNS, max_array_bytes: int = MAX_ARRAY_BYTES) -> DataFrame:
    """Pages under ``page_number=*/offset=*/requested_limit=*`` as rows.

    A key the source left out and a key it sent as null both become NULL in the declared columns; ``record`` keeps the
    text that tells them apart. Blank lines are no rows.
    """
    guard_sizes(spark, folder, max_array_bytes)
    kinds = {r.by_line for r in landed_files(spark, folder).select("by_line").distinct().collect()}
    rows = _line_pages(spark, folder) if True in kinds else None
    if False in kinds or rows is None:
        arrays = _array_pages(spark, folder)
        rows = arrays if rows is None else arrays.unionByName(rows)
    parsed = rows.withColumn("fields", F.from_json("record", RAW_SCHEMA))
    return parsed.select(
        *PAGE, F.col("pos").cast("bigint").alias("pos"), "record", *[F.col(f"fields.{c}").alias(c) for c in columns],
        F.concat_ws("-", F.lpad(F.col("page_number").cast("string"), 6, "0"), F.lpad(F.col("pos").cast("string"), 6, "0")).alias(ROW_ID),
        (F.shiftleft("page_number", 40) + F.col("pos")).alias(ROW_PLACE),
    )
