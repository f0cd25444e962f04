"""Text comparison forms. Raw values are never replaced, only compared."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim Unicode whitespace with the native trim, which stops at the first other character."""
    return F.trim(text, F.lit(WHITESPACE))


def fold(text: Column) -> Column:
    """Trim and lower-case."""
    return F.lower(strip(text))


def collapse(text: Column) -> Column:
    """Trim and turn inner whitespace runs into one blank, keeping case."""
    return F.regexp_replace(strip(text), f"[{WHITESPACE}]+", " ")


def comparison_form(text: Column) -> Column:
    return F.lower(collapse(text))


def _solid(character: Column) -> Column:
    """Certainly no whitespace, told without a search: ASCII beyond the blank."""
    return F.ascii(character).between(0x21, 0x7E)


def _starts_solid(text: Column) -> Column:
    """:func:`_solid` of the first character, told by comparing the texts."""
    return (text >= "!") & (text < "\x7f")


def is_blank(text: Column) -> Column:
    """Non-empty text made only of whitespace."""
    return (text != "") & ~_starts_solid(text) & (strip(text) == "")


def is_null_like(text: Column, words: Iterable[str]) -> Column:
    """One of the words when trimmed and lower-cased; most texts begin with another letter, have nothing to trim or are too long to be one."""
    words = [w.strip().lower() for w in words if w.strip()]
    longest = max(map(len, words), default=0)
    trimmed = _starts_solid(text) & _solid(F.right(text, F.lit(1)))
    begun = F.lit(False)
    for first in sorted({x for w in words if w[0].isascii() for x in (w[0], w[0].upper())}):
        begun = begun | ((text >= first) & (text < chr(ord(first) + 1)))
    return F.when(_starts_solid(text) & ~begun, F.lit(False)).when(trimmed, (F.char_length(text) <= longest) & F.lower(text).isin(words)).otherwise(fold(text).isin(words))


def has_leading_space(text: Column) -> Column:
    return text != F.ltrim(text, F.lit(WHITESPACE))


def has_trailing_space(text: Column) -> Column:
    return text != F.rtrim(text, F.lit(WHITESPACE))


def nested_text(text: Column) -> Column:
    """JSON objects and arrays with their keys in order, so that equal values are equal texts; other text as it is."""
    return F.when(text.rlike(r"^\s*[\[{]"), F.coalesce(F.to_json(F.try_parse_json(text)), text)).otherwise(text)


def joined_reasons(pairs: Iterable[tuple[Column, str]], separator: str = " | ") -> Column:
    """Labels of the conditions that hold, in the given order."""
    labels = [F.when(F.coalesce(cond, F.lit(False)), F.lit(label)) for cond, label in pairs]
    return F.array_join(F.array_distinct(F.array_compact(F.array(*labels))), separator)


def truth(value: Column) -> Column:
    """``true``/``false`` text in any case; NULL is false and anything else fails the job."""
    word = F.lower(F.trim(value.cast("string")))
    return (
        F.when(word.isNull(), F.lit(False))
        .when(word == "true", F.lit(True))
        .when(word == "false", F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("Not true or false: "), value.cast("string"))).cast("boolean"))
    )
