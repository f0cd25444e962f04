"""One-row aggregates turned into long tables, and wide rows into (column, value)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


_STATIC_TYPES = {str: "string", bool: "boolean", int: "int", float: "double"}


def rows_from(one_row: DataFrame, rows: Sequence[Mapping[str, object]], types: Mapping[str, str] | None = None) -> DataFrame:
    """Fan a one-row aggregate out to a long table.

    Each entry of ``rows`` maps output names to literals or to expressions over
    the aggregate's columns, so many counters cost one scan. Fields that hold
    plain values in every entry travel as one constant array, which keeps the
    plan and its generated code small.
    """
    types = types or {}
    names = list(rows[0])
    fixed = {
        k: types.get(k, _STATIC_TYPES[type(rows[0][k])]) for k in names
        if len({type(row[k]) for row in rows}) == 1 and type(rows[0][k]) in _STATIC_TYPES
    }
    moving = [k for k in names if k not in fixed]

    def value(row: Mapping[str, object], k: str) -> Column:
        plain_text = isinstance(row[k], str) and types.get(k) == "string"
        return (_as_column(row[k]).cast(types[k]) if k in types and not plain_text else _as_column(row[k])).alias(k)

    measured = F.array(*[F.struct(*[value(row, k) for k in moving]) for row in rows])
    if not fixed:
        return one_row.select(F.inline(measured))
    text = json.dumps([{k: row[k] for k in fixed} for row in rows])
    schema = "array<struct<" + ", ".join(f"`{k}`: {t}" for k, t in fixed.items()) + ">>"
    constants = F.from_json(F.lit(text), schema)
    paired = one_row.select(F.inline(F.arrays_zip(constants.alias("c"), measured.alias("m"))).alias("c", "m"))
    return paired.select(*[F.col(f"{'c' if k in fixed else 'm'}.`{k}`").alias(k) for k in names])


def column_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(kept columns, column_name, value) with one row per cell, as text."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return df.select(*keep, F.inline(cells))


def evidence(df: DataFrame, keep: Sequence[Column | str], rules: Sequence[tuple[Column, Mapping[str, object]]]) -> DataFrame:
    """One row per (input row, rule that holds); rows without a finding cost no output."""
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(False)),
               F.struct(*[_as_column(v).alias(k) for k, v in fields.items()]))
        for cond, fields in rules
    ]))
    return df.select(*keep, F.inline(found))


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that everything downstream reads as plain values.

    The optimizer copies a projected expression into each filter and join
    condition above it. It does not look through a generator, so an expensive
    expression placed in a one-element generator runs once per row.
    """
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def one_row(spark: SparkSession, counts: Mapping[str, int | None]) -> DataFrame:
    """Counts that the driver holds as the one-row table that plans read."""
    return spark.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in counts.items()])


def whole_table():
    """A window over every row, for tables whose row count is fixed by a calendar or a list."""
    return Window.partitionBy()
