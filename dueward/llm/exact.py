"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when their normalised forms are: every run of white space becomes one space. Rows alone in their
length class are settled at once, rows alone in their (length, prefix hash) class after that; only what survives both
enters the grouping by full hash. Each level groups by pre-aggregated counts and hands its survivors on by a
semi-join, so a class with a third of all rows is one counter per task and a join side that adaptive execution splits.
The row digest asked for by the query makes the full hash needed for every row; it is taken in the one scan of the
text, and the text itself is never shuffled.

Null texts count as empty. A null id stays only when its whole group has none. Repeated ids are repeated rows: the
row that stays is the group's smallest id, so rows that share it all stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueward.llm.common import SPACES, documents_of, stored, text_or_empty

PREFIX = 64


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(column), SPACES, " ")


def _repeated(rows: DataFrame, id_column: str, *keys: str) -> DataFrame:
    """Rows that share their keys with another row, dealt out anew: the next level counts a large class in every task."""
    classes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(*keys)
    return rows.join(classes, list(keys), "left_semi").repartition(F.col(id_column), F.col("digest"))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``."""
    rows = stored(
        documents_of(docs, id_column, text_column)
        .select(F.col(id_column), normalised(text_column).alias("norm"))
        .select(
            id_column, F.octet_length("norm").alias("length"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix"),
            F.unhex(F.sha2("norm", 256)).alias("digest"))
    )
    survivors = _repeated(_repeated(rows, id_column, "length"), id_column, "length", "prefix")
    groups = (
        survivors.groupBy("length", "prefix", "digest").agg(F.min(id_column).alias("least"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )
    keep = F.when(F.col("n").isNull(), F.col(id_column)).otherwise(F.col("least"))
    return rows.join(groups, ["length", "prefix", "digest"], "left").select(
        id_column, keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col(id_column)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
