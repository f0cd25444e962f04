"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate and go.

Each line hash has a HyperLogLog sketch of its sites; sketches are built per task and merged, so a line in a third of
all rows is one sketch per task. A line whose estimate is far above the threshold goes, one far below stays; lines
within the sketch's error of the threshold get an exact count of distinct sites. A line is compared without leading,
trailing and repeated white space; blank lines stay and are never counted.

Texts are split once into a stored table of line hashes, which the sketches, the exact counts and the removal read. For the
removal the boilerplate lines stand once for each of ``SALTS`` parts of the rows, so a very common line is many join keys.

Null texts count as empty; a null site is a site of its own. Rows are told apart by (id, text): equal rows lose the same
lines. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueward.llm.common import documents_of, stored, text_or_empty

MIN_SITES = 5
LOG_BUCKETS = 10
SALTS = 16


def tidy(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]+", " "))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, log_buckets: int = LOG_BUCKETS) -> DataFrame:
    """``(line, site)`` hashes to the lines on at least ``min_sites`` distinct sites."""
    error = 3 * 1.04 / math.sqrt(2**log_buckets)
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", log_buckets)).alias("sites"))
    spread = spread.where(F.col("sites") >= math.floor(min_sites * (1 - error)))
    far = spread.where(F.col("sites") > math.ceil(min_sites * (1 + error))).select("line")
    near = spread.where(F.col("sites") <= math.ceil(min_sites * (1 + error))).select("line")
    exact = lines.join(near, "line", "left_semi").distinct().groupBy("line").count().where(F.col("count") >= min_sites).select("line")
    return far.unionByName(exact)


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_column: str = "doc_id", text_column: str = "text",
                        site_column: str = "source") -> DataFrame:
    """``(id, n_lines, n_removed, kept_text)``, one row per row of ``docs``."""
    rows = documents_of(docs, id_column, text_column, site_column).select(
        F.col(id_column).alias("id"), F.col(site_column).alias("site"), text_or_empty(text_column).alias("text"),
        F.xxhash64(id_column, text_column).alias("k1"), F.hash(id_column, text_column).alias("k2"))
    split = F.split("text", "\n", -1)
    lines = rows.select("k1", "k2", F.xxhash64("site", F.col("site").isNull()).alias("site"), F.explode(F.array_distinct(split)).alias("line"))
    lines = stored(lines.withColumn("line", tidy(F.col("line"))).where("line <> ''").withColumn("line", F.xxhash64("line")))
    gone = boilerplate(lines.select("line", "site"), min_sites).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.select("k1", "k2", "line", F.pmod("k2", F.lit(SALTS)).alias("salt"))
    cut = salted.join(gone, ["line", "salt"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("line").alias("gone"))
    kept = F.filter(split, lambda x: ~F.coalesce(F.array_contains("gone", F.xxhash64(tidy(x))), F.lit(False)))
    return rows.join(cut, ["k1", "k2"], "left").withColumn("kept", kept).select(
        F.col("id").alias(id_column), F.size(split).cast("long").alias("n_lines"),
        (F.size(split) - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("kept_text"))
