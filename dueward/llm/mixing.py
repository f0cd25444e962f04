"""Mixing sources to target weights by a multivariate hypergeometric splitting tree.

Texts are cut into blocks of words. Each source's blocks are put into one random order (by a hash), and as many words as
its target asks for are drawn from it: whole passes over the source first, then the head of the order, so that draws
are disjoint within a pass. The exact numbers of draws are then split among output shards: at each node of a binary tree
a multivariate hypergeometric draw says how many of each source go left, until every shard knows its quota; a shard
takes the next stretch of each source's order and shuffles it locally by another hash.

The order of a source is never made in one task: blocks fall into ranges of the hash, ranges are counted, and a block's
place is its range's offset plus its place within it. The number of ranges grows with the input. Only per-source
counts go through the tree. Every random choice is a hash or seeded, so reruns agree.

Null texts and texts without words have size 0 and are never taken. Null is a source of its own, ordered last. Rows
count by themselves: repeated ids or rows are taken independently. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dueward.llm.common import WORD, documents_of, stored, text_or_empty

#: Weights of the sources in order, repeating, and the share of all words that the mix takes (fixed by the contract).
WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST = 2
BLOCK_WORDS = 256
#: Above this number of blocks they grow: the tree's draws are exact below 10^9.
MOST_BLOCKS = 300_000_000
RANGE_BLOCKS = 512
DEPTH = 4
SEED = 20_250
SMALL_SOURCES = 100_000


def sizes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
          row_column: str | None = None) -> DataFrame:
    """A row per document; ``row_column`` names the rows, else they are numbered here. It has no part in what is drawn."""
    return docs.select(
        F.col(id_column).alias("doc"), F.col(source_column).cast("string").alias("source"),
        F.regexp_count(text_or_empty(text_column), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(id_column, text_column).alias("draw"),
        (F.col(row_column).cast("long") if row_column else F.monotonically_increasing_id()).alias("row"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)``. The excess over ``most`` times a source's size is shared again by weight.

    Sources fill up in the order of size by weight: a source is full if, with all before it full, its share of the rest
    reaches its limit. One row per source goes through these windows.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    filling = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    per = (
        per.withColumn("asked", F.lit(total) * F.sum("source_size").over(everything))
        .withColumn("rest", F.col("asked") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("full", F.col("limit") * F.sum("weight").over(after) <= F.col("rest") * F.col("weight")))
    held = F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0.0))
    sharing = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("limit")).otherwise((F.col("asked") - held) * F.col("weight") / sharing)
    return per.select("source", "source_size", target.alias("target"))


def _blocks(rows: DataFrame, block_words: int) -> DataFrame:
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_words)))
    return rows.where("size > 0").select("row", "source", "size", "draw", number.alias("block")).select(
        "row", "source", "block", F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words).cast("long").alias("words"),
        F.xxhash64("draw", "block", F.lit(SEED)).alias("place"))


def _placed(blocks: DataFrame, ranges: int) -> DataFrame:
    """With ``before`` (words) and ``rank`` (blocks) ahead of each block in its source's order."""
    bits = max(ranges.bit_length(), 1)
    ranged = blocks.withColumn("range", F.shiftrightunsigned("place", 64 - bits))
    counted = ranged.groupBy("source", "range").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    ahead = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counted.select(
        F.col("source").alias("s"), F.col("range").alias("r"),
        F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"))
    within = W.partitionBy("source", "range").orderBy("place", "row", "block")
    local = ranged.withColumn("w1", F.sum("words").over(within.rowsBetween(W.unboundedPreceding, -1))).withColumn("n1", F.row_number().over(within) - 1)
    return local.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).select(
        "row", "source", "block", "words", "place", (F.col("w0") + F.coalesce("w1", F.lit(0))).alias("before"), (F.col("n0") + F.col("n1")).alias("rank"))


def _split(node: pd.DataFrame) -> pd.DataFrame:
    """One node's quotas to its two children."""
    node = node.sort_values("source", na_position="last")
    left = np.random.Generator(np.random.PCG64([SEED, int(node["node"].iloc[0])])).multivariate_hypergeometric(
        node["quota"].to_numpy(), int(node["quota"].sum()) // 2, method="marginals")
    return pd.concat([node.assign(node=2 * node["node"], quota=left), node.assign(node=2 * node["node"] + 1, quota=node["quota"] - left)])


def quotas(draws: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(source, quota)`` to ``(source, ends)``: where each of the 2^depth shards ends in the source's order of draws."""
    nodes = draws.select("source", F.lit(1).cast("long").alias("node"), F.col("quota").cast("long").alias("quota"))
    for _ in range(depth):
        nodes = nodes.groupBy("node").applyInPandas(_split, "source string, node long, quota long")
    upto = W.partitionBy("source").orderBy("node")
    ends = nodes.withColumn("upto", F.sum("quota").over(upto))
    return ends.groupBy("source").agg(F.array_sort(F.collect_list("upto")).alias("ends"))


def mixture(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, depth: int = DEPTH,
            block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """``sizes`` (stored) to draws ``(row, block, pass, words, shard, position)`` and the sources' targets."""
    found = stored(targets(rows, weights, total, most))
    words, sources = found.agg(F.sum("source_size"), F.count("*")).first()
    block_words = max(block_words, (words or 0) // MOST_BLOCKS)
    plan = found.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn(
        "rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    small = F.broadcast if sources <= SMALL_SOURCES else (lambda df: df)
    blocks = stored(_placed(_blocks(rows, block_words), int((words or 0) // block_words // RANGE_BLOCKS)))
    known = plan.select(F.col("source").alias("s"), "passes", "rest")
    drawn = blocks.join(small(known), F.col("source").eqNullSafe(F.col("s")))
    partial = F.greatest(F.least("words", F.col("rest") - F.col("before")), F.lit(0))
    counted = drawn.groupBy("source").agg(F.sum(F.col("passes") + (partial > 0).cast("long")).alias("quota"), F.count("*").alias("n_blocks"))
    counted = stored(counted)
    shards = quotas(counted, depth).join(counted.select(F.col("source").alias("s2"), "n_blocks"), F.col("source").eqNullSafe(F.col("s2")))
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes")))
    draws = drawn.drop("s").withColumn("pass", passes).withColumn("taken", F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(partial)).where("taken > 0")
    ends = shards.select(F.col("source").alias("s"), "n_blocks", "ends")
    draws = draws.join(small(ends), F.col("source").eqNullSafe(F.col("s"))).withColumn("turn", F.col("pass") * F.col("n_blocks") + F.col("rank"))
    return draws.select(
        "row", "block", "pass", F.col("taken").alias("words"), F.size(F.filter("ends", lambda x: x <= F.col("turn"))).alias("shard"),
        F.xxhash64("place", "pass", F.lit(SEED + 1)).alias("position")), found


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
          row_column: str | None = None, **options: float) -> DataFrame:
    """``(id, size, source_size, target, taken, n_blocks, shards)``, one row per row of ``docs``; its ``row_column`` comes first."""
    rows = stored(sizes(docs, id_column, text_column, source_column, row_column))
    draws, found = mixture(rows, **options)
    taken = draws.groupBy("row").agg(
        F.sum("words").alias("taken"), F.count("*").alias("n_blocks"), F.array_sort(F.collect_set("shard")).alias("shards"))
    named = found.withColumnRenamed("source", "s")
    return rows.join(taken, "row", "left").join(named, F.col("source").eqNullSafe(F.col("s"))).select(
        *([F.col("row").alias(row_column)] if row_column else []), F.col("doc").alias(id_column), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        F.coalesce("n_blocks", F.lit(0).cast("long")).alias("n_blocks"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def shard_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options: float) -> DataFrame:
    """The mix itself: ``(shard, position, id, words)`` with each drawn block's words, to be written by shard and position."""
    whole = documents_of(docs, id_column, text_column, source_column)
    rows = stored(sizes(whole, id_column, text_column, source_column))
    draws, found = mixture(rows, **options)
    block = max(options.get("block_words", BLOCK_WORDS), (found.agg(F.sum("source_size")).first()[0] or 0) // MOST_BLOCKS)
    keyed = draws.join(rows.select("row", "draw", "doc"), "row")
    texts = whole.select(F.xxhash64(id_column, text_column).alias("draw"), F.regexp_extract_all(text_or_empty(text_column), F.lit(WORD), 0).alias("all"))
    part = F.array_join(F.slice("all", (F.col("block") * block + 1).cast("int"), F.col("words").cast("int")), " ")
    return keyed.join(texts.dropDuplicates(["draw"]), "draw").select("shard", "position", F.col("doc").alias(id_column), part.alias("words"))
