"""The corpus pipeline: each stage applies one operator of ``dueward.llm`` to all that the stage before kept.

Stages take and return the columns of documents; the last adds the mix. Rows are decided one by one, by their number in
the stage's input, so rows without an id and rows that share one have results of their own: of two rows with the same id,
one with a benchmark item and one without, only the first goes. The number of a row is that of the scan of the stored
input, which is the same in every scan of it. Of equal or nearly equal rows the one with the smallest id stays, rows
without an id come last, and of rows with the same id the first in the scan stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dueward.llm import decontaminate, exact, mixing, simhash, toxicity
from dueward.llm.common import dropped, stored, table

ROW = "_pipeline_row"


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def _first_of_each(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Of each class of ``(ROW, class)``, the row with the smallest id."""
    placed = rows.select(ROW, "doc_id").join(classes, ROW)
    return placed.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)).alias("first")).select(f"first.{ROW}")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain scores at one half or more go; it is trained on the labelled rows among ``docs``."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model, score_name="_toxicity", spans_name="_toxic_spans")
    return scored.where("_toxicity < 0.5").drop("_toxicity", "_toxic_spans")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id stays."""
    rows = _numbered(docs)
    groups = exact.exact_groups(rows, id_column=ROW)
    return rows.join(_first_of_each(rows, groups.select(ROW, F.col("keep_id").alias("class"))), ROW, "left_semi").drop(ROW)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest id."""
    rows = _numbered(docs)
    groups = simhash.near_duplicates(rows, id_column=ROW)
    return rows.join(_first_of_each(rows, groups.select(ROW, F.col("component_id").alias("class"))), ROW, "left_semi").drop(ROW)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go."""
    rows = _numbered(docs)
    found = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), id_column=ROW)
    return rows.join(found.select(ROW), ROW, "left_anti").drop(ROW)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it, repeats counted, and the shards that hold them.

    ``taken`` is 0 for what was not drawn. Columns of the mix replace columns of the same name.
    """
    rows = _numbered(docs)
    taken = mixing.mixed(rows, row_column=ROW).drop("doc_id")
    rows = rows.drop(*(c for c in taken.columns if c != ROW))
    return rows.join(taken, ROW).drop(ROW)


STAGES = [
    ("toxicity", drop_toxic), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", drop_contaminated), ("mixing to target weights", mix),
]
#: A conditional random field cannot be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return docs
