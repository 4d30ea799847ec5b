"""Sky coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import number


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance of two points in degrees, by the haversine formula."""
    half_dec, half_ra = F.radians(dec2 - dec1) / 2, F.radians(ra2 - ra1) / 2
    h = F.pow(F.sin(half_dec), F.lit(2.0)) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(half_ra), F.lit(2.0))
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))) * 3600


def sexagesimal(value: Column, is_ra: bool) -> Column:
    """Degrees from "h m s" or "d m s" with any usual separators; null for fewer than three numbers."""
    text = F.trim(F.regexp_replace(value, "[hmsd:,]", " "))
    parts = F.split(text, r"\s+")
    a, b, c = (number(F.get(parts, F.lit(i))) for i in range(3))
    if is_ra:
        return (a + b / 60 + c / 3600) * 15
    size = F.abs(a) + b / 60 + c / 3600
    return F.when(text.startswith("-"), -size).otherwise(size)


def six_numbers(value: Column) -> tuple[Column, Column]:
    """Right ascension and declination from "h m s d m s"; null for fewer than six parts."""
    parts = F.split(F.trim(value), r"\s+")
    three = lambda i, is_ra: F.when(F.size(parts) >= 6, sexagesimal(F.array_join(F.slice(parts, i, 3), " "), is_ra))
    return three(1, True), three(4, False)


def from_parts(a: Column, b: Column, c: Column, is_ra: bool, sign: Column | None = None) -> Column:
    """Degrees from separate columns; a sign column overrides the sign of the degrees."""
    a, b, c = number(a), number(b), number(c)
    if is_ra:
        return (a + b / 60 + c / 3600) * 15
    size = F.abs(a) + b / 60 + c / 3600
    minus = F.trim(sign) == "-" if sign is not None else a < 0
    return F.when(minus, -size).otherwise(size)


def clean_id(value: Column) -> Column:
    """An identifier as a whole number: from a number, of which a fraction is cut off, or from text with a TIC prefix."""
    text = F.trim(F.regexp_replace(value.cast("string"), "(?i)TIC", ""))
    x = text.try_cast("double")
    return F.coalesce(text.try_cast("bigint"), F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).try_cast("bigint"))
