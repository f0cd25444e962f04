"""Coordinates, ZIP codes and boroughs, measured and never corrected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueward.config import UNSPECIFIED_BOROUGHS, ValidationRules
from dueward.functions.numbers import holds, ratio, to_double
from dueward.functions.shape import evidence, rows_from
from dueward.functions.text import fold
from dueward.operators.keyed import KEY

# Fixed values: (field, metric, severity) in report order.
METRICS = (
    ("borough", "missing", "WARNING"),
    ("borough", "unspecified_or_null_like", "WARNING"),
    ("latitude", "missing", "WARNING"),
    ("latitude", "parseable", "INFO"),
    ("latitude", "invalid_numeric", "ERROR"),
    ("latitude", "outside_world_range", "ERROR"),
    ("longitude", "missing", "WARNING"),
    ("longitude", "parseable", "INFO"),
    ("longitude", "invalid_numeric", "ERROR"),
    ("longitude", "outside_world_range", "ERROR"),
    ("coordinate_pair", "outside_nyc_bounding_box", "WARNING"),
    ("incident_zip", "missing", "WARNING"),
    ("incident_zip", "non_digit", "WARNING"),
    ("incident_zip", "unexpected_length", "WARNING"),
    ("incident_zip", "decimal_like", "WARNING"),
)
DIGITS = r"^[0-9]+$"
DECIMAL_DIGITS = r"^[0-9]+\.0+$"


def conditions(rules: ValidationRules = ValidationRules(), position: tuple[Column, Column] | None = None) -> dict[tuple[str, str], Column]:
    """``position`` are the coordinates as numbers, where they are columns already."""
    lat_text, lon_text, zip_text = F.col("latitude"), F.col("longitude"), F.col("incident_zip")
    lat, lon = position or (to_double(lat_text), to_double(lon_text))
    lat_in, lon_in = lat.between(*rules.latitude_range), lon.between(*rules.longitude_range)
    box = rules.box
    in_box = lat.between(box.min_latitude, box.max_latitude) & lon.between(box.min_longitude, box.max_longitude)
    digits = zip_text.rlike(DIGITS)
    return {
        ("borough", "missing"): F.col("borough").isNull(),
        ("borough", "unspecified_or_null_like"): fold(F.col("borough")).isin(list(UNSPECIFIED_BOROUGHS)),
        ("latitude", "missing"): lat_text.isNull(),
        ("latitude", "parseable"): lat.isNotNull(),
        ("latitude", "invalid_numeric"): lat_text.isNotNull() & lat.isNull(),
        ("latitude", "outside_world_range"): ~lat_in,
        ("longitude", "missing"): lon_text.isNull(),
        ("longitude", "parseable"): lon.isNotNull(),
        ("longitude", "invalid_numeric"): lon_text.isNotNull() & lon.isNull(),
        ("longitude", "outside_world_range"): ~lon_in,
        ("coordinate_pair", "outside_nyc_bounding_box"): lat_in & lon_in & ~in_box,
        ("incident_zip", "missing"): zip_text.isNull(),
        ("incident_zip", "non_digit"): ~digits,
        ("incident_zip", "unexpected_length"): digits & (F.length(zip_text) != 5),
        ("incident_zip", "decimal_like"): zip_text.contains(".") & zip_text.rlike(DECIMAL_DIGITS),
    }


def counters(rules: ValidationRules = ValidationRules(), position: tuple[Column, Column] | None = None) -> dict[str, Column]:
    return {f"{f}__{m}": F.count_if(holds(c)) for (f, m), c in conditions(rules, position).items()}


def geo_summary(df: DataFrame, rules: ValidationRules = ValidationRules()) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("all_rows"), *[c.alias(n) for n, c in counters(rules).items()])
    return rows_from(one, [
        {"field": f, "metric": m, "row_count": F.col(f"{f}__{m}"),
         "row_rate": ratio(F.col(f"{f}__{m}"), F.col("all_rows")), "severity": severity}
        for f, m, severity in METRICS
    ])


def geo_outliers(df: DataFrame, rules: ValidationRules = ValidationRules()) -> DataFrame:
    """One row per (request, finding); missing and parseable are not findings."""
    found = conditions(rules)
    pair = F.concat(F.col("latitude"), F.lit(","), F.col("longitude"))
    return evidence(df, (KEY,), [
        (found[(f, m)], {"field": f, "raw_value": pair if f == "coordinate_pair" else F.col(f),
                         "issue_type": m, "severity": severity})
        for f, m, severity in METRICS if m not in ("missing", "parseable")
    ])
