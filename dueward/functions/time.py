"""Timestamps kept as source text and read as UTC."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text forms accepted besides ISO, each with the shape that selects it.
FALLBACK_FORMATS = (
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$", "M/d/yyyy H:mm[:ss]"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2} [AP]M$", "M/d/yyyy h:mm:ss a"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "M-d-yyyy"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "M-d-yyyy H:mm:ss"),
    (r"^[A-Za-z]{3} [0-9]{1,2},? [0-9]{4}$", "MMM d[,] yyyy"),
    (r"^[A-Za-z]{4,9} [0-9]{1,2},? [0-9]{4}$", "MMMM d[,] yyyy"),
    (r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", "d MMM yyyy"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "yyyy/M/d H:mm:ss"),
    (r"^[0-9]{8}$", "yyyyMMdd"),
)


def parse_timestamp(text: Column) -> Column:
    """Mixed-format text to a UTC timestamp; anything unreadable is NULL.

    ISO text takes the first branch. What is left gets a format by its shape, or
    none, so one formatter call covers every other form.
    """
    shape = None
    for pattern, fmt in FALLBACK_FORMATS:
        shape = F.when(text.rlike(pattern), fmt) if shape is None else shape.when(text.rlike(pattern), fmt)
    return F.coalesce(text.try_cast("timestamp"), F.try_to_timestamp(text, shape))


def is_zoned(text: Column) -> Column:
    """True when the text carries an offset; the leading colon keeps plain dates naive."""
    return text.rlike(r":.*(Z|[+-][0-9]{2}(:?[0-9]{2})?)$")


def at(moment: datetime | date | str) -> Column:
    """A UTC timestamp literal."""
    if isinstance(moment, datetime):
        text = moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    else:
        text = str(moment)
    return F.lit(text).cast("timestamp")


def in_days(ts: Column, start: date, end_exclusive: date) -> Column:
    """Half-open calendar range on a typed column, in a form a scan can push down."""
    return (ts >= at(start)) & (ts < at(end_exclusive))


def month_of(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "MM")


def month_start(day: date) -> date:
    return day.replace(day=1)


def iso_text(ts: Column) -> Column:
    """ISO text with a +00:00 suffix; the fraction appears only when it is not zero."""
    micros = F.unix_micros(ts)
    return F.when(
        F.pmod(micros, F.lit(1_000_000)) == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
