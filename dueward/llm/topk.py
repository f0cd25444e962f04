"""Top-k lists over an index of shards: a few shards first, whose k-th scores then prune all the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dueward.llm.common import stored

#: Shards of the first wave.
SEED_SHARDS = 4
#: What a search returns: a query's row, the found row with its id, and the score.
FOUND = "query long, id long, row long, score long"


def ranking() -> list[Column]:
    """Highest score first, then the smallest id; rows without an id come last."""
    return [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``found`` with ``rank``, the first ``k`` of each query."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(*ranking()))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def two_waves(index: DataFrame, shards: int, search: Callable[[DataFrame, dict[int, int]], DataFrame], k: int) -> DataFrame:
    """What ``search`` finds in all shards, ``FOUND`` rows.

    ``search`` gets index rows and a floor per query: a score that ``k`` rows are known to reach, so lower ones need not
    be returned. The floors come from ``SEED_SHARDS`` shards, which are searched whole; any ``k`` rows give a valid one.
    A query block bounds the floors on the driver. Shards are dealt anew: they are few and small beside the work each takes.
    """
    seeds = [r.shard for r in index.select("shard").distinct().orderBy("shard").limit(SEED_SHARDS).collect()]
    dealt = index.repartition(max(1, shards), "shard")
    first = stored(search(dealt.where(F.col("shard").isin(seeds)), {}))
    if shards <= len(seeds):
        return first
    floors = {r.query: r.score for r in ranked(first, k).where(F.col("rank") == k).select("query", "score").collect()}
    return first.unionByName(stored(search(dealt.where(~F.col("shard").isin(seeds)), floors)))
