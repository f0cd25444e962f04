"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dueward.session import shared_folder

# The contracts' white space and words.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors.

    The table goes when the application ends. A cluster without a shared folder is an error.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete what :func:`stored` wrote for ``df``, which must not be read any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def held_on_disk(df: DataFrame) -> DataFrame:
    """Keep a table on the executors' disks until ``unpersist``: for a table that is read a few times and then let go.

    No file is written to the shared folder, so many small partitions cost no more than a few; a lost one is computed again.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def documents_of(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra or clashing ones cannot get in the way."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))
