"""Dates, tags and blanks of file rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """A date out of ISO, EXIF, packed or day-first text; an impossible day becomes the 28th, all else null."""
    iso = "^\\s*(\\d{4})[-:/.](\\d{1,2})[-:/.](\\d{1,2})"
    last = "^\\s*(\\d{1,2})[-:/.](\\d{1,2})[-:/.](\\d{4})"
    packed = "^\\s*(\\d{4})(\\d{2})(\\d{2})(?:\\D|$)"
    year = "^\\s*(\\d{4})\\s*$"
    part = lambda pattern, n: F.regexp_extract(text, pattern, n).try_cast("int")
    first, second = part(last, 1), part(last, 2)
    swapped = (second > 12) & (first <= 12)
    ymd = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
    whole = (
        F.when(text.rlike(iso), ymd(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(text.rlike(last), ymd(part(last, 3), F.when(swapped, first).otherwise(second), F.when(swapped, second).otherwise(first)))
        .when(text.rlike(packed), ymd(part(packed, 1), part(packed, 2), part(packed, 3)))
        .when(text.rlike(year), ymd(part(year, 1), F.lit(1), F.lit(1)))
    )
    y, m, d = whole["y"], whole["m"], whole["d"]
    good = y.between(1826, 2100) & m.between(1, 12) & d.between(1, 31)
    return F.when(good, F.coalesce(F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)), F.try_make_timestamp(y, m, F.lit(28), F.lit(0), F.lit(0), F.lit(0))).cast("date"))


def date_range(first: Column, last: Column) -> Column:
    """``3 Jun 2024``, ``3-5 Jun 2024``, ``3 Jun - 5 Jul 2024`` or both dates whole."""
    text = lambda c, pattern: F.date_format(c, pattern)
    return (
        F.when(F.to_date(first) == F.to_date(last), text(first, "d MMM yyyy"))
        .when(text(first, "yyyy-MM") == text(last, "yyyy-MM"), F.concat(text(first, "d"), F.lit("-"), text(last, "d MMM yyyy")))
        .when(F.year(first) == F.year(last), F.concat(text(first, "d MMM"), F.lit(" - "), text(last, "d MMM yyyy")))
        .otherwise(F.concat(text(first, "d MMM yyyy"), F.lit(" - "), text(last, "d MMM yyyy")))
    )


def filled(current: Column, new: Column) -> Column:
    """The new value only where the current one is blank."""
    return F.coalesce(F.nullif(F.trim(current), F.lit("")), new)


def merged_tags(current: Column, new: Column) -> Column:
    """Both lists without repeats in any case, the first spelling and place kept."""
    every = F.concat(F.coalesce(current, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))
    lowered = F.transform(every, F.lower)
    return F.filter(every, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)


def rendered(template: str, fields: dict[str, Column]) -> Column:
    """``{name}`` replaced by its field, blanks and dangling separators tidied."""
    out = F.lit(template)
    for name, column in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column.cast("string"), F.lit("")))
    tidy = F.regexp_replace(F.regexp_replace(out, "\\s+", " "), "(?:\\s*[-,/]\\s*)+$|^(?:\\s*[-,/]\\s*)+", "")
    return F.trim(tidy)
