"""Integrity of landed pages and of one extraction. Nothing here orders the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dueward.config import Scope
from dueward.functions.numbers import holds, total
from dueward.functions.shape import computed_once, rows_from
from dueward.functions.time import at
from dueward.operators.keyed import KEY, MISSING
from dueward.schemas import RAW_COLUMNS

PAGE = ("page_number", "offset", "requested_limit")
CHUNK = 10_000


class ExtractionRejected(RuntimeError):
    """An extraction gate failed; nothing may be stored."""


# ---- pages ------------------------------------------------------------------

def page_summary(landed: DataFrame) -> DataFrame:
    return landed.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("returned_rows"))


def oversized_pages(landed: DataFrame) -> DataFrame:
    """Pages with more rows than were asked for."""
    return page_summary(landed).where(F.col("returned_rows") > F.col("requested_limit"))


def repeated_pages(landed: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Pages whose content already arrived at a smaller offset.

    Content is compared by the row count and two combined 64-bit hashes of
    (position, values); no page is gathered into one value.
    """
    values = [F.coalesce(F.col(c), F.lit(MISSING)) for c in columns]
    prints = landed.groupBy("page_number", "offset").agg(
        F.count(F.lit(1)).alias("returned_rows"),
        F.bit_xor(F.xxhash64("pos", *values)).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(1), "pos", *values)).alias("h2"))
    same = ["returned_rows", "h1", "h2"]
    first = prints.groupBy(*same).agg(F.min("offset").alias("first_offset"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return prints.join(first, same).where(F.col("offset") > F.col("first_offset")).select(
        "page_number", "offset", "returned_rows", "first_offset")


def unstable_order(landed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows whose (created text, key text) is smaller than the row before them.

    Rows are compared inside chunks of a page, in one window pass. Chunk ends are then compared along their page, and
    page ends by an equality join with the next page. So an oversized page is split, and no window holds more than
    ``chunk`` rows or the ends of one page's chunks.
    """
    key = F.struct(F.coalesce("created_date", F.lit("")).alias("created"),
                   F.coalesce(KEY, F.lit("")).alias("key"))
    rows = landed.select("page_number", "pos", (F.col("pos") / chunk).cast("bigint").alias("chunk"), key.alias("k"))
    inside = Window.partitionBy("page_number", "chunk").orderBy("pos")
    marked = rows.withColumns({"previous": F.lag("k").over(inside), "following": F.lead("pos").over(inside)})
    # Findings, and the two ends of each chunk: all that the rest has to read.
    kept = marked.where(F.col("previous").isNull() | F.col("following").isNull() | (F.col("k") < F.col("previous")))
    along = Window.partitionBy("page_number").orderBy("pos")
    compared = kept.withColumn("previous", F.coalesce("previous", F.lag("k").over(along)))
    tails = kept.groupBy((F.col("page_number") + 1).alias("page_number")).agg(F.max_by("k", "pos").alias("tail"))
    before = compared.join(tails, "page_number", "left").withColumn("previous", F.coalesce("previous", "tail"))
    return before.where(F.col("k") < F.col("previous")).select(
        "page_number", "pos", F.col("k.created").alias("created_date"), F.col("k.key").alias(KEY),
        F.col("previous.created").alias("previous_created_date"), F.col("previous.key").alias("previous_unique_key"))


def repeated_keys_on_pages(landed: DataFrame) -> DataFrame:
    """Keys that arrive more than once, and whether they cross pages."""
    return landed.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.min("page_number") != F.max("page_number")).alias("crosses_pages")).where("row_count > 1")


def page_continuity(landed: DataFrame) -> DataFrame:
    """Per page: offset in step, a full page unless last, and a successor unless last."""
    pages = page_summary(landed)
    last = pages.agg(F.max("page_number").alias("last_page")).withColumn("_one", F.lit(1))
    following = pages.select((F.col("page_number") - 1).alias("page_number"), F.col("offset").alias("next_offset"))
    joined = pages.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one").join(following, "page_number", "left")
    is_last = F.col("page_number") == F.col("last_page")
    in_step = F.col("offset") == (F.col("page_number") - 1) * F.col("requested_limit")
    short = F.col("returned_rows") < F.col("requested_limit")
    succeeded = holds(F.col("next_offset") == F.col("offset") + F.col("requested_limit"))
    return joined.select(
        "page_number", "offset", "returned_rows", in_step.alias("offset_in_step"),
        is_last.alias("is_last_page"), (short & ~is_last).alias("short_before_end"),
        succeeded.alias("next_page_follows"),
        (in_step & (is_last | (succeeded & ~short))).alias("is_continuous"))


def key_presence(columns: Sequence[str] = RAW_COLUMNS) -> list[Column]:
    """Per column, the landed objects that carry its key and those that carry it as an explicit null.

    The record is one variant value; a path that is absent is NULL, one that holds null is a variant null.
    """
    found = []
    for c in columns:
        at_key = F.try_variant_get(F.col("variant"), f"$['{c}']", "variant")
        found += [F.count(at_key).alias(f"{c}__keys"), F.count_if(F.is_variant_null(at_key)).alias(f"{c}__nulls")]
    return found


def with_variant(landed: DataFrame) -> DataFrame:
    """``landed`` with its record as a variant, parsed once a row; NULL where the text is no JSON."""
    return computed_once(landed, {"variant": F.try_parse_json(F.col("record"))})


def column_presence(landed: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Objects per configured column that lack its key, send null, or send a value; one pass."""
    return presence_of(with_variant(landed).agg(F.count(F.lit(1)).alias("objects"), *key_presence(columns)), columns)


def presence_of(one: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """The same from a row of counts that holds ``objects`` and :func:`key_presence`."""
    return rows_from(one, [
        {"column_name": c, "objects_without_key": F.col("objects") - F.col(f"{c}__keys"), "explicit_nulls": F.col(f"{c}__nulls"),
         "objects_with_key": F.col(f"{c}__keys")} for c in columns])


def never_present_columns(landed: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Configured columns that no landed object carries, told from explicit nulls by the raw text."""
    return never_present_of(column_presence(landed, columns))


def never_present_of(presence: DataFrame) -> DataFrame:
    return presence.where("objects_with_key = 0").select("column_name", F.lit("WARN").alias("status"))


def count_reconciliation(raw: DataFrame, preflight: int, postflight: int) -> DataFrame:
    """The two source counts against the rows at hand."""
    return reconciliation_of(raw.agg(F.count(F.lit(1)).alias("retrieved")), preflight, postflight)


def reconciliation_of(one: DataFrame, preflight: int, postflight: int) -> DataFrame:
    return one.select(
        F.lit(preflight).cast("bigint").alias("preflight_count"),
        F.lit(postflight).cast("bigint").alias("postflight_count"),
        F.col("retrieved").alias("retrieved_row_count"),
        F.lit(preflight == postflight).alias("source_stable"),
        (F.col("retrieved") == preflight).alias("retrieval_complete"))


# ---- one extraction ---------------------------------------------------------

def gate_counters(scope: Scope, present: Sequence[str]) -> list[Column]:
    """What the gates count on rows; a column that is not ``present`` counts as NULL."""
    def known(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in present else F.lit(None).cast(kind)

    created = known("created_ts", "timestamp")
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(~holds(known("agency") == scope.agency)).alias("agency_bad"),
        F.count_if(~holds(known("complaint_type") == scope.complaint_type)).alias("type_bad"),
        F.count_if(~holds((created >= at(scope.start)) & (created < at(scope.end_exclusive)))).alias("created_bad"),
    ]


def extraction_gates(typed: DataFrame, scope: Scope, *, expected: int, postflight: int, query_hash: str,
                     columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Eight gates from one scan; any FAIL rejects the extraction."""
    return gates_of(typed.agg(*gate_counters(scope, typed.columns)), typed.columns, expected=expected, postflight=postflight,
                    query_hash=query_hash, columns=columns)


def gates_of(one: DataFrame, present: Sequence[str], *, expected: int, postflight: int, query_hash: str,
             columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """The gates from their counter row."""
    missing = sorted(set(columns) - set(present))

    def gate(name: str, passed, observed, wanted) -> dict[str, object]:
        return {"check_name": name, "status": F.when(passed if isinstance(passed, Column) else F.lit(passed), "PASS")
                .otherwise("FAIL"), "observed_value": observed, "expected_value": wanted}

    return rows_from(one, [
        gate("required_source_columns", not missing, "|".join(missing), "none missing"),
        gate("non_empty_extract", F.col("n") > 0, F.col("n"), "> 0"),
        gate("agency_scope", F.col("agency_bad") == 0, F.col("agency_bad"), "0"),
        gate("complaint_type_scope", F.col("type_bad") == 0, F.col("type_bad"), "0"),
        gate("created_date_scope", F.col("created_bad") == 0, F.col("created_bad"), "0"),
        gate("preflight_count", F.col("n") == expected, F.col("n"), str(expected)),
        gate("source_stability", expected == postflight, str(postflight), str(expected)),
        gate("query_hash", bool(query_hash), query_hash, "non-empty"),
    ], {"observed_value": "string", "expected_value": "string"})


def observation_counters() -> list[Column]:
    created = F.col("created_ts")
    wrong = holds(F.col("due_ts") < created) | holds(F.col("closed_ts") < created)
    return [
        F.count_if(F.col("due_date").isNull()).alias("missing_due_dates"),
        F.count_if(F.col("closed_date").isNull()).alias("missing_closed_dates"),
        F.count_if(wrong).alias("invalid_timestamp_chronology_rows"),
    ]


def extraction_observations(typed: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Findings kept for validation: repeats, gaps, chronology and the status vocabulary.

    Keys are counted by grouping; each observed status is a row of its own. ``counts`` is the row of counters, if the
    write of the rows has counted already.
    """
    counts = typed.agg(*observation_counters()) if counts is None else counts
    keys = typed.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).agg(
        total(F.col("n") - 1).alias("duplicate_unique-key_rows"))

    def rows(one: DataFrame) -> DataFrame:
        return rows_from(one, [
            {"check_name": c, "status": F.when(F.col(f"`{c}`") > 0, "WARN").otherwise("PASS"),
             "observed_value": F.col(f"`{c}`").cast("string")} for c in one.columns])

    statuses = typed.where(F.col("status").isNotNull()).select(F.col("status").alias("observed_value")).distinct().select(
        F.lit("status_values_observed").alias("check_name"), F.lit("PASS").alias("status"), "observed_value")
    return rows(keys).unionByName(rows(counts)).unionByName(statuses)


def enforce_gates(gates: DataFrame) -> None:
    """Raise with the names of failed gates; the table has eight rows."""
    failed = [r["check_name"] for r in gates.where("status = 'FAIL'").collect()]
    if failed:
        raise ExtractionRejected("Gates that failed: " + ", ".join(failed))


def key_integrity(raw: DataFrame) -> DataFrame:
    """NULL keys and rows beyond the first per key, as one row."""
    keys = raw.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(
        total("n").alias("row_count"),
        total(F.when(F.col(KEY).isNull(), F.col("n"))).alias("null_keys"),
        total(F.when(F.col(KEY).isNotNull(), F.col("n") - 1)).alias("repeated_rows"))


def load_strict(raw: DataFrame) -> DataFrame:
    """The same rows, or an error when a key is NULL or repeated."""
    found = key_integrity(raw).first()
    if found["null_keys"]:
        raise ExtractionRejected("Rows without a unique_key arrived.")
    if found["repeated_rows"]:
        raise ExtractionRejected(f"{found['repeated_rows']} rows repeat a unique_key.")
    return raw
