"""SimHash near-duplicates: fingerprints, a binary trie self-join within a Hamming budget, components.

Method: equal fingerprints collapse to one trie leaf. Node pairs of the trie are walked together: two nodes whose
prefixes differ in more bits than the budget are pruned with all that is below them. The upper part of the walk is
a re-keying of rows (one row for each surviving node pair that a fingerprint's node takes part in); a node pair that
is small enough becomes one task, a larger one is walked further by the next bits. The lower part of the walk runs
inside the task, on sorted arrays, a bounded number of node pairs at a time.

Null texts count as empty; a text without words has fingerprint zero, which links like any other. Repeated ids are
repeated rows: each is returned. A null id has a fingerprint and a component, but is no component's id as long as
another id is there. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueward.llm.common import documents_of, stored
from dueward.llm.components import connected_components

SEED = 42
BITS = 64
BUDGET = 2
#: Fingerprints of a node pair that one task walks (8 bytes each).
PAIR_ROWS = 1 << 15
#: Node pairs a task holds at once.
FRONTIER = 1 << 20
#: Bits by which the walk goes down between two shuffles.
STEP = 4
WORDS_AT_ONCE = 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint_of(text: bytes, size: int) -> int:
    """Bit k is one if it is one in more than half of the shingles' hashes."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    last = max(len(words) - size + 1, 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, last, WORDS_AT_ONCE):
        part = words[start:min(start + WORDS_AT_ONCE, last) + size - 1]
        shingles = zip(*(part[k:] for k in range(size))) if len(words) >= size else (part,)
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > last).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, fp)``; ``fp`` is the 64-bit fingerprint as a signed long."""
    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint_of((t.as_py() or "").encode("utf-8", "surrogatepass"), size) for t in batch.column(1)),
                dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_column, "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    chosen = documents_of(docs, id_column, text_column)
    return chosen.mapInArrow(fingerprinted, f"`{id_column}` {kind}, fp long")


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _walk(a: np.ndarray, b: np.ndarray, same: bool, depth: int, spent: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted arrays ``a`` and ``b`` (below two nodes at ``depth``) that differ in at most ``budget`` bits."""
    start = tuple(np.array([x], dtype=np.int64) for x in (0, len(a), 0, len(b), spent))
    stack = [(depth, start)]
    ones: dict[tuple[int, int], np.ndarray] = {}

    def before(side: int, values: np.ndarray, bit: int) -> np.ndarray:
        if (side, bit) not in ones:
            found = (values >> np.uint64(bit)) & np.uint64(1)
            ones[side, bit] = np.concatenate(([0], np.cumsum(found.astype(np.int64))))
        return ones[side, bit]

    while stack:
        at, (a0, a1, b0, b1, diff) = stack.pop()
        while len(a0):
            work = (a1 - a0) * (b1 - b0)
            leaf = (work <= 16) if at < BITS else np.ones(len(a0), dtype=bool)
            if leaf.any():
                la0, la1, lb0, lb1 = (x[leaf] for x in (a0, a1, b0, b1))
                n = (la1 - la0) * (lb1 - lb0)
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                width = np.repeat(lb1 - lb0, n)
                i = np.repeat(la0, n) + within // width
                j = np.repeat(lb0, n) + within % width
                keep = _ones(a[i] ^ b[j]) <= budget
                if same:
                    keep &= i < j
                if keep.any():
                    yield i[keep], j[keep]
                a0, a1, b0, b1, diff = (x[~leaf] for x in (a0, a1, b0, b1, diff))
                if not len(a0):
                    break
            if len(a0) > FRONTIER:
                half = len(a0) // 2
                stack.append((at, tuple(x[half:] for x in (a0, a1, b0, b1, diff))))
                a0, a1, b0, b1, diff = (x[:half] for x in (a0, a1, b0, b1, diff))
            bit = BITS - 1 - at
            pa_, pb_ = before(0, a, bit), before(1, b, bit)
            am = a1 - (pa_[a1] - pa_[a0])
            bm = b1 - (pb_[b1] - pb_[b0])
            own = (a0 == b0) & (a1 == b1) if same else np.zeros(len(a0), dtype=bool)
            children = [
                (a0, am, b0, bm, diff, None), (am, a1, bm, b1, diff, None),
                (a0, am, bm, b1, diff + 1, None), (am, a1, b0, bm, diff + 1, own),
            ]
            kept = []
            for c0, c1, d0, d1, spent_now, mirrored in children:
                alive = (c1 > c0) & (d1 > d0) & (spent_now <= budget)
                if mirrored is not None:
                    alive &= ~mirrored
                kept.append(tuple(x[alive] for x in (c0, c1, d0, d1, spent_now)))
            a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*kept))
            at += 1


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links: (member, root) index pairs; at most n, whatever the number of links."""
    root = np.arange(n)

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            up = root[x]
            if (up == x).all():
                return x
            x = up

    for i, j in links:
        while len(i):
            i, j = find(i), find(j)
            low, high = np.minimum(i, j), np.maximum(i, j)
            apart = low != high
            i, j = high[apart], low[apart]
            np.minimum.at(root, i, j)
    all_roots = find(np.arange(n))
    moved = np.flatnonzero(all_roots != np.arange(n))
    return moved, all_roots[moved]


def _links_of_pair(low: int, high: int, depth: int, values: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked values of one node pair, as stars."""
    values = np.unique(values)
    if low == high:
        links = _walk(values, values, True, depth, 0, budget)
        n, order = len(values), values
    else:
        side = (values >> np.uint64(BITS - depth)) == np.uint64(low)
        a, b = values[side], values[~side]
        if not len(a) or not len(b):
            return values[:0], values[:0]
        spent = (low ^ high).bit_count()
        links = ((i, j + len(a)) for i, j in _walk(a, b, False, depth, spent, budget))
        n, order = len(a) + len(b), np.concatenate((a, b))
    i, j = _forest(n, links)
    return order[i], order[j]


def _masks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(mask, its ones) for each way to differ in at most ``budget`` of ``bits`` bits."""
    return [(sum(1 << k for k in at), n) for n in range(budget + 1) for at in combinations(range(bits), n)]


def _deeper(rows: DataFrame, depth: int, step: int, budget: int) -> DataFrame:
    """Each fingerprint once for each surviving node pair, ``step`` bits further down.

    ``own`` and ``other`` are the pair's prefixes, as the row's fingerprint sees them.
    """
    masks = F.explode(F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("ones")) for m, n in _masks(step, budget))))
    below = (1 << step) - 1
    prefix = F.shiftrightunsigned(F.col("fp"), BITS - depth - step)
    return (
        rows.withColumn("m", masks)
        .withColumn("spent", F.col("spent") + F.col("m.ones")).where(F.col("spent") <= budget)
        .select(
            "fp", "spent", prefix.alias("own"),
            F.shiftleft("other", step).bitwiseOR(prefix.bitwiseAND(F.lit(below).cast("long")).bitwiseXOR(F.col("m.mask"))).alias("other"),
        )
        .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    )


def linked(prints: DataFrame, budget: int = BUDGET, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Distinct ``fp`` to ``(u, v)`` edges whose components are those of all links within the budget.

    No link is lost; within a node pair the links are handed on as stars, so there are at most as many edges as rows.
    """
    count = max(prints.count(), 1)
    depth, found = 0, None
    rows = prints.select("fp", F.lit(0).alias("spent"), F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("other"))
    step = max(0, min(16, (count // (pair_rows // 4)).bit_length()))
    while True:
        if step:
            rows = _deeper(rows, depth, step, budget)
        else:
            rows = rows.withColumn("low", F.col("own")).withColumn("high", F.col("other"))
        depth += step
        rows = stored(rows) if depth else rows
        sizes = rows.groupBy("low", "high").agg(
            F.count("*").alias("n"), F.min("own").alias("first"), F.max("own").alias("last"))
        sizes = sizes.where((F.col("low") == F.col("high")) | (F.col("first") != F.col("last")))
        small = sizes.where(F.col("n") <= pair_rows) if depth < BITS - STEP else sizes
        pairs = rows.join(small.select("low", "high"), ["low", "high"], "left_semi") if depth else rows
        edges = _pair_links(pairs.select("low", "high", "fp"), depth, budget)
        found = edges if found is None else found.unionByName(edges)
        if not depth or depth >= BITS - STEP or not sizes.where(F.col("n") > pair_rows).limit(1).count():
            return found
        rows = rows.join(sizes.where(F.col("n") > pair_rows).select("low", "high"), ["low", "high"], "left_semi").select("fp", "spent", "own", "other")
        step = STEP


def _pair_links(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    def of_pair(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        values = part.column("fp").to_numpy().view(np.uint64)
        u, v = _links_of_pair(key[0].as_py(), key[1].as_py(), depth, values, budget)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return rows.groupBy("low", "high").applyInArrow(of_pair, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 3, budget: int = BUDGET, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id, n_linked_prints)``: the component's smallest id and its number of fingerprints."""
    prints = stored(fingerprints(docs, size, id_column, text_column))
    nodes = stored(prints.groupBy("fp").agg(F.min(id_column).alias("least")))
    roots = connected_components(linked(nodes.select("fp"), budget))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_linked_prints"))
    classes = rooted.select("fp", "root").join(named, "root").drop("root")
    return prints.join(classes, "fp").select(
        id_column, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_linked_prints")
