"""Positions as files write them: EXIF fractions, XMP coordinates, ISO 6709 text. What can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[+-]?\d+(?:\.\d+)?"
_FRACTION = rf"^({_NUMBER})(?:/({_NUMBER})?)?$"
_XMP = r"(?i)^\s*([+-]?\d+(?:\.\d+)?)(?:,(\d+(?:\.\d+)?))?(?:,(\d+(?:\.\d+)?))?\s*([NSEW])?\s*$"
_ISO = r"([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)"


def _part(text: Column, pattern: str, n: int) -> Column:
    """A group as a number; null where the pattern or the group is absent."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit("")).cast("double")


def valid_position(lat: Column, lon: Column) -> Column:
    """On the globe, and not the point at zero that stands for no fix; never null."""
    on_globe = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(on_globe & ~((F.abs(lat) < 1e-9) & (F.abs(lon) < 1e-9)), F.lit(False))


def exif_degrees(value: Column, side: Column) -> Column:
    """``37/1 46/1 1629/100`` with a side N, S, E or W as signed degrees; one or two fractions will do."""
    words = F.slice(F.filter(F.split(F.trim(value), r"[\s,]+"), lambda w: w != ""), 1, 3)
    number = lambda w: F.try_divide(_part(w, _FRACTION, 1), F.coalesce(_part(w, _FRACTION, 2), F.lit(1.0)))
    numbers = F.transform(words, number)
    at = lambda i: F.when(F.size(words) > i, F.get(numbers, F.lit(i))).otherwise(0.0)
    degrees = F.when(F.size(words) > 0, at(0) + at(1) / 60 + at(2) / 3600)
    return F.when(F.upper(F.substring(F.trim(F.coalesce(side, F.lit(""))), 1, 1)).isin("S", "W"), -degrees).otherwise(degrees)


def xmp_degrees(value: Column) -> Column:
    """``122,25.5W``, ``48,51,29.6N``, ``48.858N`` or a signed decimal as signed degrees."""
    whole, side = _part(value, _XMP, 1), F.upper(F.regexp_extract(value, _XMP, 4))
    size = F.abs(whole) + F.coalesce(_part(value, _XMP, 2), F.lit(0.0)) / 60 + F.coalesce(_part(value, _XMP, 3), F.lit(0.0)) / 3600
    return F.when(side.isin("S", "W") | ((side == "") & (whole < 0)), -size).otherwise(size)


def iso6709(value: Column) -> Column:
    """``+37.7749-122.4194+010.000/`` as a struct of ``lat`` and ``lon``; null off the globe."""
    lat, lon = _part(value, _ISO, 1), _part(value, _ISO, 2)
    return F.when(valid_position(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))
