"""Ratios, percentages and scores that never turn into NaN or infinity."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(text: Column) -> Column:
    """Text to double; unreadable text and the word NaN are NULL."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Zero when the denominator is NULL or zero."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percentage(count: Column, total: Column) -> Column:
    """Rounded to six digits; NULL when it cannot be computed."""
    return F.round(F.try_divide(F.lit(100.0) * count.cast("double"), total.cast("double")), 6)


def share_pct(count: Column, total: Column) -> Column:
    """Unrounded percentage, zero when the total is zero."""
    return F.lit(100.0) * ratio(count, total)


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double")))


def balance_score(rate: Column) -> Column:
    """One at a 50 % rate, zero at either extreme or when the rate is unknown."""
    return F.coalesce(clip01(1.0 - 2.0 * F.abs(rate.cast("double") - 0.5)), F.lit(0.0))


def volume_score(count: Column, minimum: Column) -> Column:
    return clip01(F.log1p(F.greatest(count, F.lit(0)).cast("double"))
                  / F.log1p((F.greatest(minimum, F.lit(1)) * 10).cast("double")))


def holds(condition: Column) -> Column:
    """A condition whose unknown outcome counts as false."""
    return F.coalesce(condition, F.lit(False))


def all_hold(conditions) -> Column:
    return reduce(and_, [holds(c) for c in conditions])


def total(column: str | Column) -> Column:
    """A sum that is zero on no rows, as a BIGINT."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")
