"""Facts about repeated keys, and a join that survives a key holding a third of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dueward.schemas import ROW_ID

KEY = "unique_key"
MISSING = "<NA>"
#: Bits of a :func:`hash_filter`, 32 MB; a piece of it is what one lookup reads.
FILTER_BITS, PIECE_BITS, BITMAP_BITS = 1 << 28, 1 << 10, 1 << 15


def text_hash(column: str) -> Column:
    """64-bit hash of raw text in which NULL equals the marker text."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)))


def present_hash(column: str) -> Column:
    """Like :func:`text_hash`, but NULL stays NULL and so never conflicts."""
    return F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column)))


def row_signature(times: Sequence[str], texts: Sequence[str]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a row's compared columns."""
    parts = [F.coalesce(F.unix_micros(F.col(t)), F.lit(-(2**63) + 1)) for t in times]
    parts += [F.coalesce(F.col(t).cast("string"), F.lit(MISSING)) for t in texts]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def differs(column: str | Column) -> Column:
    """More than one distinct non-NULL value, as two fixed-width map-side buffers."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.min(c) != F.max(c), F.lit(False))


def hash_filter(hashes: DataFrame, column: str) -> DataFrame:
    """A bitmap of 64-bit hashes as ``(piece, bits)``, empty pieces left out: of bounded size however many there are.

    It holds every hash and, of other hashes, a share that grows with their number: what it does not hold is certain.
    """
    at = F.pmod(F.col(column), F.lit(FILTER_BITS))
    width, per = PIECE_BITS // 8, BITMAP_BITS // PIECE_BITS
    maps = hashes.select(F.floor(at / BITMAP_BITS).alias("no"), F.pmod(at, F.lit(BITMAP_BITS)).alias("bit")).repartition("no").groupBy(
        "no").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    return maps.select("no", "bitmap", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("i")).select(
        (F.col("no") * per + F.col("i")).alias("piece"), F.substring("bitmap", F.col("i") * width + 1, F.lit(width)).alias("bits")).where(
        F.col("bits") != F.lit(bytes(width)))


def with_held(rows: DataFrame, hashed: Column, found: DataFrame, name: str) -> DataFrame:
    """Rows with ``name``: whether the :func:`hash_filter` may hold the hash, false for NULL. No row moves."""
    at = F.pmod(hashed, F.lit(FILTER_BITS))
    pieces = F.broadcast(found.select(F.col("piece").alias("_piece"), F.col("bits").alias("_bits")))
    bit = F.pmod(F.col("_at"), F.lit(PIECE_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = F.expr("shiftright(_byte, cast(_at % 8 AS int)) % 2 = 1")
    looked = rows.withColumn("_at", at).join(pieces, F.floor(F.col("_at") / PIECE_BITS) == F.col("_piece"), "left")
    return looked.withColumn("_byte", byte).withColumn(name, F.coalesce(held, F.lit(False))).drop("_at", "_piece", "_bits", "_byte")


def repeated_keys(rows: DataFrame, tests: Mapping[str, Column], *, canonical: bool = False) -> DataFrame:
    """One row per non-NULL key held by more than one row.

    ``tests`` are aggregate conditions. Partial aggregation reduces a hot key to
    one buffer per map task before anything moves.
    """
    aggregates = [F.count(F.lit(1)).alias("group_rows")]
    aggregates += [cond.alias(name) for name, cond in tests.items()]
    if canonical:
        aggregates.append(F.min(ROW_ID).alias("canonical_id"))
    return (
        rows.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(*aggregates).where(F.col("group_rows") > 1)
    )


def attach_key_facts(rows: DataFrame, facts: DataFrame, name: str = "key_facts") -> DataFrame:
    """Left-join ``facts`` (from :func:`repeated_keys`) as one nullable struct column.

    One plan for every key. The facts have one row per repeated key; a key with a third of the rows is a skewed left
    side, which adaptive execution splits. Rows without a key get a private join key, so they spread evenly.
    """
    fields = [c for c in facts.columns if c != KEY]
    packed = facts.select(F.col(KEY).alias("_fact_key"), F.struct(*fields).alias(name))
    private = F.concat(F.lit("\u0000"), F.col(ROW_ID))
    keyed = rows.withColumn("_join_key", F.coalesce(F.col(KEY), private))
    return keyed.join(packed, F.col("_join_key") == F.col("_fact_key"), "left").drop("_join_key", "_fact_key")


def key_groups(rows: DataFrame, flags: Sequence[str], signatures: Mapping[str, Sequence[Column]]) -> DataFrame:
    """Rows counted per (key, flags), with each key's size and conflict outcome beside them.

    The flags take a bounded number of values, so after the first aggregation no
    key has more than that many rows left and the window stays small however
    many source rows a key had.
    """
    prepared = rows.select(
        KEY, *flags,
        *[h.alias(f"_{s}_{i}") for s, hashes in signatures.items() for i, h in enumerate(hashes)],
    )
    spans = [
        agg(f"_{s}_{i}").alias(f"_{s}_{i}_{label}")
        for s, hashes in signatures.items() for i in range(len(hashes))
        for agg, label in ((F.min, "lo"), (F.max, "hi"))
    ]
    counted = prepared.groupBy(KEY, *flags).agg(F.count(F.lit(1)).alias("rows"), *spans)
    same_key = Window.partitionBy(KEY)
    has_key = F.col(KEY).isNotNull()
    conflicts = {}
    for s, hashes in signatures.items():
        unequal = F.lit(False)
        for i in range(len(hashes)):
            unequal = unequal | F.coalesce(
                F.min(f"_{s}_{i}_lo").over(same_key) != F.max(f"_{s}_{i}_hi").over(same_key), F.lit(False)
            )
        conflicts[s] = has_key & unequal
    return counted.select(
        KEY, *flags, "rows",
        F.when(has_key, F.sum("rows").over(same_key)).otherwise(F.lit(1)).alias("key_rows"),
        *[c.alias(s) for s, c in conflicts.items()],
    )
