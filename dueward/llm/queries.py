"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dueward.llm import decontaminate, exact, lexical, licenses, lines, mixing, nearest, pii, simhash, spelling, suffix, toxicity, urls
from dueward.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, fetched on a day of the year that their id gives, against the derived dated list."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("capture"), "url", (F.col("page_id") * 37 % 365).cast("int").alias("day"))
    return urls.evaluated(pages, urls.derived_entries(pages)).withColumnRenamed("capture", "page_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(licenses.as_files(table(spark, sf_dir, "documents"))).withColumnRenamed("file", "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.without_boilerplate(table(spark, sf_dir, "documents"))
    return cut.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("spans")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_suffix_dedup, op2_exact_dedup, op3_decontaminate, op4_url_filters, op5_license_scan, op6_mixing, op7_line_dedup,
        op8_pii, op9_toxicity, op10_simhash_near_dedup, op11_spelling_variants, op12_ranked_search, op13_exact_top_k)}
