"""Units of length and time, as factors and as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIXES = {"Y": 24, "Z": 21, "E": 18, "P": 15, "T": 12, "G": 9, "M": 6, "k": 3, "h": 2, "da": 1, "": 0, "d": -1, "c": -2, "m": -3, "µ": -6, "u": -6, "μ": -6, "n": -9, "p": -12, "f": -15, "a": -18, "z": -21, "y": -24}
# Micrometres of units that are no metres with a prefix.
_OTHERS = {"Å": 1e-4, "thou": 25.4, "li": 25400.0 / 12, "in": 25400.0, "ft": 304800.0, "yd": 914400.0, "mi": 1609344000.0, "ua": 1.495978707e17, "ly": 9.4607304725808e21, "pc": 3.085677581491367e22, "pt": 25400.0 / 72}
#: Micrometres of each unit: metres with every prefix, and others.
LENGTHS = {f"{p}m": float(f"1e{e + 6}") for p, e in _PREFIXES.items()} | _OTHERS
#: Nanometres of each unit.
NANOMETRES = {k: v * 1000 for k, v in LENGTHS.items()}
#: Seconds of each unit.
TIMES = {f"{p}s": float(f"1e{e}") for p, e in _PREFIXES.items()} | {"min": 60.0, "h": 3600.0, "d": 86400.0}
# Micrometres of the names that comments use, in any case; other units are those of LENGTHS as written.
IMAGEJ_ALIASES = {
    "micron": 1.0, "microns": 1.0, "micrometer": 1.0, "micrometers": 1.0, "nanometer": 1e-3, "nanometers": 1e-3, "millimeter": 1e3, "millimeters": 1e3,
    "centimeter": 1e4, "centimeters": 1e4, "meter": 1e6, "meters": 1e6, "inch": 25400.0, "inches": 25400.0,
}


def comment_factor(unit: str | None) -> float | None:
    """Micrometres of a comment's unit."""
    unit = (unit or "").strip()
    return IMAGEJ_ALIASES.get(unit.lower(), LENGTHS.get(unit))


def comment_factors(unit: Column) -> Column:
    """Micrometres of a comment's unit, as an expression."""
    named = F.create_map(*[F.lit(x) for pair in IMAGEJ_ALIASES.items() for x in pair])
    plain = F.create_map(*[F.lit(x) for pair in LENGTHS.items() for x in pair])
    return F.coalesce(F.try_element_at(named, F.lower(F.trim(unit))), F.try_element_at(plain, F.trim(unit)))


def convert(value: Column, unit: Column, table: dict[str, float]) -> Column:
    """value in the table's base unit; null for a unit that it lacks or a result that is not finite."""
    factors = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    out = value * F.try_element_at(factors, unit)
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), None).otherwise(out)


def strict_int(text: Column) -> Column:
    """Digits with a sign only, else null; no blanks."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
