"""Exact top-k vectors by inner product, by aggregation of sorted lists without random access.

The index deals vectors by a hash into shards of about ``SHARD_CELLS`` components. A shard keeps one list per component,
sorted by value. For a query, the lists are read from the end that its weight favours, all to the same depth, step by
step; the queries of a block share what is read. It gives every vector a lower bound (unread components at their worst)
and an upper bound (at the last value read). Reading stops when no vector outside the lists' heads can reach the k-th lower
bound, nor all but a few inside; the final scores of those few are then resolved. A first wave over a few shards gives each
query a floor for the others (see ``topk``). Queries go in blocks of at most ``QUERIES_AT_ONCE``; only a block is ever on the driver.

Components are ``floor(256 * x)``, held to 32 bits; scores are held to 64. Vectors that are null or hold a null or
non-finite component take no part. A query meets vectors of its own length only; an empty vector has score 0 with every
other empty one. Rows with equal ids or equal vectors are separate candidates, and a query leaves out its own row only;
equal scores go to the smaller id, rows without an id last. A row without an id is no query. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueward.llm.common import documents_of, stored
from dueward.llm.topk import FOUND, ranked, two_waves

SCALE = 256
SHARD_CELLS = 1 << 19
QUERIES_AT_ONCE = 4_096
#: Steps in which the lists are read, and the first one at which bounds are looked at: earlier ones leave too much unread.
STEPS = 8
FIRST_STEP = 2
#: The share of a shard that may be left for the final scores.
LEFT = 64
#: Queries whose bounds are held at a time.
QUERIES_IN_STEP = 256
_INT32, _INT64 = 2**31 - 1, 2**63 - 1
INDEX = "shard long, dim int, ids array<long>, rows array<long>, places array<int>, sorted array<int>"


def vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(row, id, v)``: the vectors that take part, in integers."""
    x = F.col("x").cast("array<double>")
    good = F.col("x").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(F.least(F.greatest(v, F.lit(-1e12)), F.lit(1e12)) * SCALE),
                                                        F.lit(_INT32)), F.lit(-_INT32)).cast("int"))
    plain = documents_of(table, id_column, vector_column).toDF("id", "x")
    return plain.where(good).select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), whole.alias("v"))


def shards_of(rows: DataFrame, cells: int) -> int:
    total = rows.agg(F.coalesce(F.sum(F.greatest(F.size("v"), F.lit(1))), F.lit(0))).first()[0]
    return -(-total // cells)


def sorted_lists(rows: DataFrame, shards: int) -> DataFrame:
    """The index: a row per shard and vector length, its lists one after another, each from the largest value down."""
    def build(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        v = group.column("v").combine_chunks()
        lengths = np.diff(v.offsets.to_numpy())
        flat = v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py():]
        first = np.cumsum(lengths) - lengths
        ids, own = group.column("id").to_pylist(), group.column("row").to_numpy()
        out = []
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            cells = flat[first[at][:, None] + np.arange(dim)].T
            places = np.argsort(-cells.astype(np.int64), axis=1, kind="stable")
            out.append((shard, int(dim), [ids[k] for k in at], own[at], places.astype(np.int32).ravel(),
                        np.take_along_axis(cells, places, axis=1).ravel()))
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (
            pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())))],
            names=["shard", "dim", "ids", "rows", "places", "sorted"])

    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(max(1, shards))).alias("shard"), "id", "row", "v")
    return dealt.groupBy("shard").applyInArrow(build, INDEX)


class Shard:
    """One shard's lists, read by a block of queries together: at a depth, all queries have read the same list heads."""

    def __init__(self, ids: list, rows: np.ndarray, places: np.ndarray, values: np.ndarray, dim: int):
        self.n, self.dim = len(rows), dim
        self.rows = rows
        self.ids = np.array([_INT64 if k is None else k for k in ids], dtype=np.int64)
        self.named = np.array([k is not None for k in ids])
        self.places = places.reshape(dim, self.n)
        self.values = values.reshape(dim, self.n).astype(np.float64)
        self.largest = np.abs(self.values).max() if values.size else 0.0
        self.cells_read = 0

    def _vectors(self) -> np.ndarray:
        whole = np.empty((self.n, self.dim))
        np.put_along_axis(whole, self.places.T.astype(np.int64), self.values.T, axis=0)
        return whole

    def _heads(self, depth: int, gap: tuple[np.ndarray, np.ndarray], kind: type) -> tuple[np.ndarray, np.ndarray]:
        """What the first ``depth`` entries from either end hold beyond ``gap``, by vector and component; 0 where unread."""
        found = []
        for side, base in zip((slice(0, depth), slice(self.n - depth, None)), gap):
            head = np.zeros((self.n, self.dim), dtype=kind)
            np.put_along_axis(head, self.places.T[side].astype(np.int64), (self.values.T[side] - base).astype(kind), axis=0)
            found.append(head)
        return found[0], found[1]

    def final(self, vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The scores themselves, within 64 bits."""
        if np.abs(q).sum() * self.largest < 2**52:
            return (vectors @ q).astype(np.int64)
        whole = [sum(int(a) * int(b) for a, b in zip(x, q)) for x in vectors]
        return np.array([max(-_INT64, min(_INT64, x)) for x in whole], dtype=np.int64)

    def top(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """Per query, ``(score, place)`` of the best ``k`` that reach its floor, without the query's own row.

        Lists are read from their large end where a query's weight is positive and from their small end where it is
        negative, which gives every vector a lower and an upper bound of its score.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in own]
        whole = self._vectors()
        reach = np.abs(queries).sum(axis=1) * self.largest
        slack = np.where(reach < 2**52, 0.0, reach * 1e-9)  # beyond exact sums of doubles
        kind = np.float32 if len(reach) and reach.max() < 2**23 else np.float64  # sums of integers are exact in it
        up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
        owned = dict(zip(self.rows.tolist(), range(self.n)))
        mine = np.array([owned.get(row, -1) for row in own.tolist()], dtype=np.int64)
        # Without a floor a query needs lower bounds; with one, it waits until no outsider can reach it.
        asking, floorless = np.arange(len(own)), np.isneginf(floors)
        ends = (self.values[:, -1], self.values[:, 0]) if self.n else (np.zeros(self.dim), np.zeros(self.dim))
        left: dict[int, np.ndarray] = {}
        read = 0
        for step in range(FIRST_STEP, STEPS + 1):
            depth = self.n * step // STEPS
            if not depth or not len(asking) or not self.dim:
                continue
            last = (self.values[:, depth - 1], self.values[:, self.n - depth])
            outside = up[asking] @ last[0] + down[asking] @ last[1] + slack[asking]
            bar = floors[asking].copy()
            able = floorless[asking] | (outside < bar)
            self.cells_read += (depth - read) * self.dim * len(asking)
            read = depth
            if self.n - 1 >= k and floorless[asking].any():
                low = self._heads(depth, ends, kind)
                for part in _chunks(np.flatnonzero(floorless[asking])):
                    who = asking[part]
                    least = up[who] @ ends[0] + down[who] @ ends[1]
                    lower = low[0] @ up[who].T + low[1] @ down[who].T + least
                    inside = mine[who] >= 0
                    lower[mine[who][inside], np.flatnonzero(inside)] = -np.inf
                    bar[part] = np.maximum(bar[part], np.partition(lower, self.n - k, axis=0)[self.n - k] - slack[who])
                able &= outside < bar
            if not able.any():
                continue
            high = self._heads(depth, last, kind)
            done = []
            for part in _chunks(np.flatnonzero(able)):
                who = asking[part]
                upper = high[0] @ up[who].T + high[1] @ down[who].T + outside[part]
                alive = upper >= bar[part]
                alive[mine[who][mine[who] >= 0], np.flatnonzero(mine[who] >= 0)] = False
                few = alive.sum(axis=0) <= max(k, self.n // LEFT)
                for column in np.flatnonzero(few | (step == STEPS)):
                    left[int(who[column])] = np.flatnonzero(alive[:, column])
                    done.append(int(who[column]))
            asking = np.setdiff1d(asking, done)
        everyone = np.arange(self.n)
        for query in range(len(own)):
            at = left.get(query, everyone[everyone != mine[query]])
            scores = self.final(whole[at], queries[query])
            order = np.lexsort((self.rows[at], self.ids[at], -scores))[:k]
            found[query] = [(int(scores[o]), int(at[o])) for o in order if scores[o] >= floors[query]]
        return found


def _chunks(at: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(0, len(at), QUERIES_IN_STEP):
        yield at[k:k + QUERIES_IN_STEP]


def search(index: DataFrame, queries: list[tuple[int, np.ndarray]], floors: dict[int, int], k: int) -> DataFrame:
    """``FOUND`` rows: each shard's best for each query of the block."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for dim in {len(q) for _, q in queries}:
        own = [(row, q) for row, q in queries if len(q) == dim]
        by_dim[dim] = (np.array([row for row, _ in own], dtype=np.int64), np.array([q for _, q in own], dtype=np.float64).reshape(len(own), dim),
                       np.array([floors.get(row, -np.inf) for row, _ in own], dtype=np.float64))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(batch.num_rows):
                dim = batch.column("dim")[s].as_py()
                if dim not in by_dim:
                    continue
                shard = Shard(batch.column("ids")[s].as_py(), *(
                    batch.column(c)[s].values.to_numpy(zero_copy_only=False) for c in ("rows", "places", "sorted")), dim)
                rows, asked, least = by_dim[dim]
                out = [(int(row), int(shard.ids[p]) if shard.named[p] else None, int(shard.rows[p]), score)
                       for row, own in zip(rows, shard.top(asked, rows, least, k)) for score, p in own]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out)], names=["query", "id", "row", "score"])

    return index.mapInArrow(found, FOUND)


def nearest(table: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
            shard_cells: int = SHARD_CELLS, queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` vectors with the largest inner product for each query row.

    ``is_query`` is a condition on ``id``; every row is a candidate.
    """
    rows = stored(vectors(table, id_column, vector_column))
    shards = shards_of(rows, shard_cells)
    index = stored(sorted_lists(rows, shards))
    asked = rows.where(is_query)
    blocks = -(-asked.count() // queries_at_once)
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "v").toArrow()
        queries = [(row, np.array(v, dtype=np.int64)) for row, v in zip(own.column(0).to_pylist(), own.column(1).to_pylist())]
        part = two_waves(index, shards, lambda shard, floors, queries=queries: search(shard, queries, floors, k), k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = table.sparkSession.createDataFrame([], FOUND)
    names = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return ranked(found, k).join(names, "query").select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_column), "score")
