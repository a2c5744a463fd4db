"""Metadata text as Catalyst expressions: comments, fixed strings, colours, ratios, wavelengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n?", "\n")


def control_to_newline(text: Column) -> Column:
    """Text kept as numbers: NUL goes, other control characters part its lines."""
    return F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("")), "[\\x01-\\x1f\\x7f-\\x9f]", "\n")


def last_unit(comment: Column) -> Column:
    """The last word behind `unit=`; null without one."""
    return F.try_element_at(F.regexp_extract_all(comment, F.lit("unit=([A-Za-z0-9_]+)"), F.lit(1)), F.lit(-1))


def comment_value(comment: Column, key: str) -> Column:
    """The text behind the last line `key=...`; the key must stand alone, without blanks."""
    mine = F.filter(F.split(normalise_newlines(comment), "\n"), lambda line: F.startswith(line, F.lit(f"{key}=")))
    return F.substring(F.try_element_at(mine, F.lit(-1)), len(key) + 2, 1 << 30)


def comment_count(comment: Column, key: str) -> Column:
    """A count of a comment: digits, else 0; 1 if the comment lacks the key."""
    value = comment_value(comment, key)
    number = F.when(value.rlike("^\\+?[0-9]{1,18}$"), value.try_cast("bigint"))
    return F.when(value.isNull(), 1).otherwise(F.coalesce(F.when(number < 1 << 32, number), F.lit(0)))


def until_nul(raw: Column, trim: bool = False) -> Column:
    """A fixed-length string up to its first NUL."""
    out = F.substring_index(raw.cast("string"), "\0", 1)
    return F.trim(out) if trim else out


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def colour(text: Column) -> Column:
    """An unsigned colour of 32 bits, written with or without a sign; null otherwise."""
    number = F.when(text.rlike("^[+-]?[0-9]{1,18}$"), text.try_cast("bigint"))
    return F.when(number.between(0, (1 << 32) - 1), number).when(number.between(-(1 << 31), -1), number + (1 << 32))


def emission_centre(wavelengths: Column) -> Column:
    """The middle of the positive wavelengths; null without any."""
    seen = F.filter(wavelengths, lambda w: w > 0)
    return (F.array_min(seen) + F.array_max(seen)) / 2


def plane_value(explicit: Column, step: Column, index: Column) -> Column:
    """A plane's time or place: as stated, else the step times its index."""
    return F.coalesce(explicit, step * index)
