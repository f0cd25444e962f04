"""What the checks, the issue register and the profiles read instead of rows.

Three tables come from one write and scans of what it stored. The write counts every condition as rows pass (an observation:
it sits behind the last shuffle, where a task counts once however often it is tried); rows that are already stored are
counted by a scan and not written again. One scan groups (column, value) cells and agency names, by text in category columns,
else by two hashes. The others group keys and whole rows, and move only rows whose key's hash is repeated: the row of any
other key is a group of its own in both, so it is counted where it is. All key groups are folded into one row. A text that a
profile shows is fetched at the end, by place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dueward.config import (
    MATERIAL_COLUMNS, OVERVIEW_CONFLICT_COLUMNS, PROFILE_CATEGORY_COLUMNS, QUALITY_CATEGORY_COLUMNS, TIMESTAMP_COLUMNS, Scope,
    ValidationRules,
)
from dueward.functions.numbers import holds, to_double, total
from dueward.functions.time import parse_timestamp
from dueward.operators import geography, profile, quality
from dueward.operators.keyed import KEY, differs, hash_filter, present_hash, row_signature, with_held
from dueward.operators.silver import TYPED
from dueward.schemas import RAW_COLUMNS, ROW_ID, ROW_PLACE

#: Cells of whole rows, and of an agency code with its name.
WHOLE_ROW, AGENCY_NAME = "*", "agency|agency_name"
TEXTS = tuple(dict.fromkeys(PROFILE_CATEGORY_COLUMNS + QUALITY_CATEGORY_COLUMNS))


@dataclass(frozen=True)
class Evidence:
    """``counters`` and ``keys`` have one row each; ``cells`` one per distinct value; ``rows`` are the typed rows."""

    counters: DataFrame
    cells: DataFrame
    keys: DataFrame
    rows: DataFrame


def counters(scope: Scope, analysed_at: datetime, rules: ValidationRules = ValidationRules(),
             columns: Sequence[str] = RAW_COLUMNS) -> list[Column]:
    """Every conditional count of the raw validation and of the source audit."""
    found = _counters(scope, analysed_at, rules, columns)
    return [F.count(F.lit(1)).alias("all_rows"), *[c.alias(n) for n, c in found.items()]]


def counted(rows: DataFrame, found: DataFrame, scope: Scope, analysed_at: datetime, rules: ValidationRules = ValidationRules(),
            columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """The :func:`counters` of stored rows by a scan, where a coordinate is read once; values are counted in ``found``.

    ``found`` are the :func:`cells` of the columns beside the key, with ``kind``: what is missing is asked of a value where it is
    grouped, by one expression for all columns. As many expressions as columns make code too large to be compiled.
    """
    position = {"_latitude": to_double(F.col("latitude")), "_longitude": to_double(F.col("longitude"))}
    missing = profile.missing_of(found, _beside_key(columns))
    every = _counters(scope, analysed_at, rules, columns, tuple(map(F.col, position)))
    nulls = {f"missing__{c}": F.col(f"{c}__null").alias(f"missing__{c}") for c in columns}
    one = rows.withColumns(position).agg(F.count(F.lit(1)).alias("all_rows"), *[
        c.alias(n) for n, c in every.items() if n not in nulls and n not in missing.columns])
    return one.crossJoin(F.broadcast(missing)).select("all_rows", *[nulls.get(n, F.col(n)) for n in every])


def _counters(scope: Scope, analysed_at: datetime, rules: ValidationRules, columns: Sequence[str],
              position: tuple[Column, Column] | None = None) -> dict[str, Column]:
    return {
        **{f"scope__{n}": c for n, c in profile.scope_counters(scope).items()},
        **profile.missing_counters(columns, rules.null_like),
        **{f"ts__{c}": F.count_if(F.col(c).isNotNull() & F.col(TYPED[c]).isNull()) for c in rules.timestamp_columns},
        **{f"geo__{n}": c for n, c in geography.counters(rules, position).items()},
        **quality.audit_counts(analysed_at, columns, position),
    }


def place_of(rows: DataFrame) -> Column:
    """The number that orders rows, where they have one; else their identity as text."""
    return F.col(ROW_PLACE if ROW_PLACE in rows.columns else ROW_ID)


def _readable(column: str, rows: DataFrame) -> Column:
    if column in TIMESTAMP_COLUMNS:
        parsed = F.col(TYPED[column]) if TYPED[column] in rows.columns else parse_timestamp(F.col(column))
        return parsed.isNotNull()
    return to_double(F.col(column)).isNotNull() if column in ("latitude", "longitude") else F.lit(True)


def cells(rows: DataFrame, columns: Sequence[str] = RAW_COLUMNS, texts: Sequence[str] = TEXTS, *,
          whole: Sequence[str] = RAW_COLUMNS, extra: bool = True, several: DataFrame | None = None,
          words: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, h1, value, n, readable, first_place)`` per distinct value; a NULL is a value without a hash.

    Values are told apart by text where they carry it, else by two hashes. ``extra`` adds rows equal in all of
    ``whole``, of which only ``n`` is kept, and agency names. Buffers are of fixed width, so grouping needs no sort.
    ``several`` is a filter of the :func:`repeated_hashes`, or of those whose rows may be equal; whole rows of other keys are
    not shuffled. With ``words`` each value has its :func:`profile.missing_kind` as ``kind``.
    """
    names, parts, shown = [], [], []
    nothing, no_hash = F.lit(None).cast("string"), F.lit(None).cast("long")

    def add(name: str, readable: Column, text: Column, as_text: bool) -> None:
        parts.append(F.struct(F.lit(len(names)).alias("no"), text.alias("text"), readable.alias("readable")))
        shown.extend([len(names)] * as_text)
        names.append(name)

    for c in columns:
        add(c, _readable(c, rows), F.col(c).cast("string"), c in texts)
    if extra:
        add(AGENCY_NAME, F.lit(True), F.when(F.col("agency").isNotNull(), F.to_json(F.struct("agency", "agency_name"))), True)
    # A value is hashed once it stands in a row of its own: one small expression for all columns.
    text, as_text = F.col("text"), F.col("no").isin(shown)
    alike, kind = text.isNotNull() & ~as_text, {} if words is None else {"kind": profile.missing_kind(text, words)}
    fanned = rows.select(place_of(rows).alias("place"), F.inline(F.array(*parts))).select(
        "no", "place", "readable", F.when(alike, F.xxhash64(text)).alias("h1"), F.when(alike, F.xxhash64(F.lit(1), text)).alias("h2"),
        F.when(as_text, text).alias("value"), *[c.alias(n) for n, c in kind.items()])
    grouped = fanned.groupBy("no", "h1", "h2", "value").agg(
        F.count(F.lit(1)).alias("n"), F.max("readable").alias("readable"), F.min("place").alias("first_place"),
        *[F.max(n).alias(n) for n in kind])
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("no") + 1)
    hashed = F.coalesce("h1", F.when(F.col("value").isNotNull(), F.xxhash64("value")))
    found = grouped.select(named.alias("column_name"), hashed.alias("h1"), "value", "n", "readable", "first_place", *kind)
    if not extra:
        return found
    first, second = row_signature((), whole)
    one = F.lit(1).cast("long")
    if several is None or KEY not in whole:
        hashed = rows.select(first.alias("h1"), second.alias("h2"))
        alike = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    else:  # equal rows have equal keys
        shared = _marked(rows, several).where("NOT alone").select(first.alias("h1"), second.alias("h2"))
        alike = shared.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).select("n").unionByName(
            _marked(rows, several).where("alone").select(one.alias("n")))
    return found.unionByName(alike.select(
        F.lit(WHOLE_ROW).alias("column_name"), no_hash.alias("h1"), nothing.alias("value"), "n", F.lit(True).alias("readable"),
        F.lit(None).cast(found.schema["first_place"].dataType).alias("first_place"), *[F.lit(None).cast("int").alias(n) for n in kind]))


def value_counts(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, rows) of category columns, NULL a value of its own."""
    return found.where(F.col("column_name").isin(list(columns))).select("column_name", "value", F.col("n").alias("row_count"))


def whole_rows(found: DataFrame) -> DataFrame:
    """Rows per distinct row."""
    return found.where(F.col("column_name") == WHOLE_ROW).select("n")


def agency_names(found: DataFrame) -> DataFrame:
    """``(agency, agency_name, n)``, rows without an agency left out."""
    pair = F.from_json("value", "agency string, agency_name string")
    return found.where((F.col("column_name") == AGENCY_NAME) & F.col("value").isNotNull()).select(
        pair["agency"].alias("agency"), pair["agency_name"].alias("agency_name"), "n")


def key_hash() -> Column:
    """The first hash of the key, NULL for none: :func:`present_hash` of its text."""
    key = F.col(KEY).cast("string")
    return F.when(key.isNotNull(), F.xxhash64(key))


def repeated_hashes(rows: DataFrame) -> DataFrame:
    """``k1``, the first hash of each known key that more than one row has: a hash and a count are shuffled."""
    return rows.select(key_hash().alias("k1")).where("k1 IS NOT NULL").groupBy("k1").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("k1")


def filter_of(hashes: DataFrame) -> DataFrame:
    """The :func:`hash_filter` of the :func:`repeated_hashes`."""
    return hash_filter(hashes, "k1")


def _marked(rows: DataFrame, several: DataFrame) -> DataFrame:
    """Rows with ``alone``: their key is known and no other row has its hash, since the filter does not hold it."""
    return with_held(rows, key_hash(), several, "_held").withColumn("alone", F.col(KEY).isNotNull() & ~F.col("_held")).drop("_held")


def key_groups(rows: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """Rows, conflicts, chronology counts and the first place of each key, grouped by the key's hashes.

    A conflict of raw text counts a NULL as a value, so one hash of all compared columns tells it; an audit conflict does
    not, and is told column by column. With ``several``, a filter of the :func:`repeated_hashes`, the keys that it does not
    hold are a single group that is marked ``alone``; their rows are not compared.
    """
    conditions = profile.chronology_conditions()
    key = F.col(KEY).cast("string")
    alone = F.lit(False) if several is None else F.col("alone")
    present = key.isNotNull() & ~alone
    marked = rows if several is None else _marked(rows, several)
    prepared = marked.select(
        alone.alias("alone"), F.when(present, F.xxhash64(key)).alias("k1"), F.when(present, F.xxhash64(F.lit(1), key)).alias("k2"),
        place_of(rows).alias("place"), F.when(~alone, row_signature((), MATERIAL_COLUMNS)[0]).alias("material"),
        *[F.when(~alone, present_hash(c)).alias(f"a_{c}") for c in OVERVIEW_CONFLICT_COLUMNS],
        *[holds(c).cast("int").alias(n) for n, c in conditions.items()])
    audit = F.lit(False)
    for c in OVERVIEW_CONFLICT_COLUMNS:
        audit = audit | differs(f"a_{c}")
    return prepared.groupBy("alone", "k1", "k2").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"), differs("material").alias("conflict"),
        audit.alias("audit_conflict"), *[total(n).alias(n) for n in conditions]).drop("k2")


def key_cells(groups: DataFrame, rows: DataFrame, several: DataFrame) -> DataFrame:
    """The key column's :func:`cells`: a group each, and a row each for keys that are alone."""
    def cell(found: DataFrame, hashed: str, n: Column, place: Column) -> DataFrame:
        return found.select(F.lit(KEY).alias("column_name"), F.col(hashed).alias("h1"), F.lit(None).cast("string").alias("value"),
                            n.alias("n"), F.lit(True).alias("readable"), place.alias("first_place"))

    single = _marked(rows, several).where("alone").select(key_hash().alias("h1"), place_of(rows).alias("place"))
    return cell(groups.where("NOT alone"), "k1", F.col("n"), F.col("first_place")).unionByName(
        cell(single, "h1", F.lit(1).cast("long"), F.col("place")))


def key_totals(keys: DataFrame) -> DataFrame:
    """Duplicate and chronology counts of all :func:`key_groups` as one row."""
    conditions = profile.chronology_conditions()
    alone, known = F.col("alone"), F.col("k1").isNotNull()
    repeated = known & (F.col("n") > 1)
    conflict, rows_of = repeated & F.col("conflict"), F.col("n")
    return keys.agg(
        total("n").alias("all_rows"),
        total(F.when(~known & ~alone, rows_of)).alias("missing_unique_key_rows"),
        F.count_if(repeated).alias("duplicate_unique_key_groups"),
        total(F.when(repeated, rows_of)).alias("rows_in_duplicate_key_groups"),
        total(F.when(repeated, rows_of - 1)).alias("excess_duplicate_rows"),
        F.coalesce(F.max(F.when(repeated, rows_of)), F.lit(1)).alias("most_rows_of_a_key"),
        total(F.when(repeated & ~F.col("conflict"), rows_of - 1)).alias("redundant_exact_duplicate_rows"),
        F.count_if(conflict).alias("conflicting_duplicate_keys"),
        total(F.when(conflict, rows_of)).alias("rows_in_conflicting_groups"),
        F.count_if(repeated & F.col("audit_conflict")).alias("audit_conflicting_keys"),
        *[total(n).alias(f"{n}__rows") for n in conditions],
        # A NULL key is one key here; of keys alone each row is one.
        *[total(F.when(alone, F.col(n)).when(F.col(n) > 0, 1)).alias(f"{n}__keys") for n in conditions])


# ---- gathered and stored ----------------------------------------------------

def planned(typed: DataFrame, scope: Scope, analysed_at: datetime, rules: ValidationRules = ValidationRules(),
            columns: Sequence[str] = RAW_COLUMNS) -> Evidence:
    """The same tables as plans over rows that are already stored, or small."""
    several = filter_of(repeated_hashes(typed))
    groups = key_groups(typed, several)
    found = cells(typed, _beside_key(columns), whole=columns, several=several)
    return Evidence(typed.agg(*counters(scope, analysed_at, rules, columns)),
                    found.unionByName(key_cells(groups, typed, several)) if KEY in columns else found, key_totals(groups), typed)


def _beside_key(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c != KEY]


def gather(typed: DataFrame, root: str, scope: Scope, analysed_at: datetime, rules: ValidationRules = ValidationRules(),
           columns: Sequence[str] = RAW_COLUMNS, *, mode: str = "errorifexists", rows_stored: bool = False,
           several: DataFrame | None = None, held: DataFrame | None = None, alike: DataFrame | None = None) -> Evidence:
    """Store the typed rows, counting on the way, then the cells, the key groups and the key row; ``typed`` is computed once.

    ``rows_stored`` says that ``typed`` reads a stored table: it is :func:`counted` by a scan and not stored a second time.
    ``several`` are its :func:`repeated_hashes`, or ``held`` their filter, where they are known; more hashes change no result.
    ``alike`` are hashes of all keys under which rows may be equal in all ``columns``: only their whole rows are shuffled.
    """
    spark = typed.sparkSession
    if rows_stored:
        rows = typed
    else:
        seen = Observation("conditions")
        typed.observe(seen, *counters(scope, analysed_at, rules, columns)).write.mode(mode).parquet(f"{root}/typed")
        found = seen.get  # one row
        spark.createDataFrame([tuple(found.values())], ", ".join(f"`{n}` long" for n in found)).coalesce(1).write.mode(
            mode).parquet(f"{root}/counters")
        rows = spark.read.parquet(f"{root}/typed")
    if held is None:
        held = filter_of(repeated_hashes(rows) if several is None else several)
    held.write.mode(mode).parquet(f"{root}/several")
    shared = _several(spark, root)
    cells(rows, _beside_key(columns), whole=columns, several=shared if alike is None else filter_of(alike),
          words=rules.null_like if rows_stored else None).write.mode(mode).partitionBy("column_name").parquet(f"{root}/cells")
    if rows_stored:
        found = spark.read.schema("kind int, n long, column_name string").parquet(f"{root}/cells")
        counted(rows, found, scope, analysed_at, rules, columns).write.mode(mode).parquet(f"{root}/counters")
    key_groups(rows, shared).write.mode(mode).parquet(f"{root}/key_groups")
    key_totals(spark.read.parquet(f"{root}/key_groups")).write.mode(mode).parquet(f"{root}/keys")
    return stored(spark, root, rows if rows_stored else None, KEY in columns)


def _several(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("piece long, bits binary").parquet(f"{root}/several")


def stored(spark: SparkSession, root: str, rows: DataFrame | None = None, with_key: bool = True) -> Evidence:
    """What :func:`gather` stored; ``rows`` are the typed rows, where they were stored before."""
    rows = spark.read.parquet(f"{root}/typed") if rows is None else rows
    kind = rows.schema[ROW_PLACE if ROW_PLACE in rows.columns else ROW_ID].dataType.simpleString()
    found = spark.read.schema(
        f"h1 long, value string, n long, readable boolean, first_place {kind}, column_name string").parquet(f"{root}/cells")
    if with_key:
        found = found.unionByName(key_cells(spark.read.parquet(f"{root}/key_groups"), rows, _several(spark, root)))
    return Evidence(spark.read.parquet(f"{root}/counters"), found, spark.read.parquet(f"{root}/keys"), rows)
