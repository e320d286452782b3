"""Search tokens as DataFrame conditions.

A search is a string of blank-separated tokens, all of which must hold: ``tag:x``, ``tags:+a,-b,c|d,x*``,
``tagcount:>2``, ``kind:a|b``, ``artist:x``, ``date:2021..2022``, a number column such as ``size:10..30``, and
``sort:-price``. A leading ``-`` negates a token; what has no known prefix is one phrase searched in the text columns.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.operators.scopes import box_around

_SPLIT = re.compile(r'(?:[^\s"]+|"[^"]*"?)+')
_RANGE = re.compile(r"(>=|<=|>|<|=)?(-?\d+(?:\.\d+)?)$")


@dataclass(frozen=True)
class Fields:
    """Which columns play which part in a search."""

    key: str
    tags: Column
    texts: tuple[Column, ...] = ()
    numbers: dict[str, Column] = field(default_factory=dict)
    words: dict[str, Column] = field(default_factory=dict)
    date: Column | None = None
    #: Width and height, for ``ratio:``, ``orient:``, ``mp:`` and ``pixels:``.
    sides: tuple[Column, Column] | None = None
    path: Column | None = None
    #: Arrays of names that take the terms of ``tags:``, arrays of places, and yes-or-no columns such as ``fav:``.
    names: dict[str, Column] = field(default_factory=dict)
    places: Column | None = None
    flags: dict[str, Column] = field(default_factory=dict)
    #: Text columns of which a part is asked for, such as ``desc:``; latitude and longitude, for ``gps:``, ``near:`` and ``bbox:``.
    parts: dict[str, Column] = field(default_factory=dict)
    position: tuple[Column, Column] | None = None
    #: Tokens that other tables answer, such as ``person:``: they give the keys that meet them, or none for a value that they don't know.
    relations: dict[str, Callable[[str], DataFrame | None]] = field(default_factory=dict)
    #: Tokens and sort keys of one's own.
    handlers: dict[str, Callable[[str], Column]] = field(default_factory=dict)
    sorts: dict[str, Column] = field(default_factory=dict)


def number_range(value: str, column: Column) -> Column:
    """``5``, ``>5`` or ``5..9``; ends may be swapped."""
    if ".." in value:
        low, high = sorted(float(x) for x in value.split("..", 1))
        return column.between(low, high)
    match = _RANGE.match(value)
    if not match:
        return F.lit(False)
    number = float(match[2])
    return {None: column == number, "=": column == number, ">": column > number, "<": column < number, ">=": column >= number, "<=": column <= number}[match[1]]


def period(text: str) -> tuple[str, str] | None:
    """First and last day of ``2021``, ``2021-03`` or ``2021-03-04`` as ISO text; none if there is no such date."""
    parts = text.split("-")
    try:
        numbers = [int(p) for p in parts]
        if len(parts) == 1:
            return f"{numbers[0]:04d}-01-01", f"{numbers[0]:04d}-12-31"
        last = calendar.monthrange(numbers[0], numbers[1])[1]
        if len(parts) == 2:
            return f"{numbers[0]:04d}-{numbers[1]:02d}-01", f"{numbers[0]:04d}-{numbers[1]:02d}-{last:02d}"
        if len(parts) == 3 and 1 <= numbers[2] <= last:
            return (text, text)
    except (ValueError, calendar.IllegalMonthError):
        pass
    return None


def date_condition(value: str, column: Column) -> Column:
    """A date token: a period, ``a..b``, or a comparison with the ends of a period. Null dates never match."""
    day = F.date_format(column, "yyyy-MM-dd")
    if ".." in value:
        first, last = (period(v) for v in value.split("..", 1))
        return day.between(first[0], last[1]) if first and last else F.lit(False)
    match = re.match(r"(>=|<=|>|<|=)?(.*)$", value)
    span = period(match[2])
    if not span:
        return F.lit(False)
    return {"<": day < span[0], "<=": day <= span[1], ">": day > span[1], ">=": day >= span[0]}.get(match[1] or "=", day.between(*span))


def _plain_tags(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.lower(F.ltrim(t, F.lit("?"))))


def has_tag(tags: Column, name: str) -> Column:
    """Whether a tag of this name is there, confirmed or not; never null."""
    return F.coalesce(F.array_contains(_plain_tags(tags), name.lower()), F.lit(False))


def _globbed(name: str) -> Callable[[Column], Column]:
    pattern = "^" + ".*".join(re.escape(part) for part in name.split("*")) + "$"
    return lambda tag: tag.rlike(pattern)


def tag_terms(tags: Column, value: str) -> Column:
    """``+a,-b,c|d,x*``: every term must hold, a term holds if one of its alternatives does."""
    plain, condition = _plain_tags(tags), F.lit(True)
    for term in value.split(","):
        negative, found = term.startswith("-"), F.lit(False)
        for name in term.lstrip("+-").lower().split("|"):
            if "*" in name:
                found = found | F.coalesce(F.exists(plain, _globbed(name)), F.lit(False))
            else:
                found = found | F.coalesce(F.array_contains(plain, name), F.lit(False))
        condition = condition & (~found if negative else found)
    return condition


def _contains(column: Column, value: str) -> Column:
    return F.lower(column).contains(value.lower())


def tag_state(value: str, tags: Column) -> Column:
    """``untagged``, ``tagged``, ``unconfirmed`` (only such tags) or ``tagunconfirmed`` (some); null tags are none."""
    n, unsure = F.coalesce(F.size(tags), F.lit(0)), F.coalesce(F.exists(tags, lambda t: t.startswith("?")), F.lit(False))
    sure = F.coalesce(F.exists(tags, lambda t: ~t.startswith("?")), F.lit(False))
    return {"untagged": n <= 0, "tagged": n > 0, "unconfirmed": unsure & ~sure, "tagunconfirmed": unsure}.get(value, F.lit(False))


#: Shapes by name, as the least and the largest width over height.
SHAPES = {"square": (1 / 1.05, 1.05), "portrait": (0, 1 / 1.05), "tall": (0, 0.6), "landscape": (1.05, 1e9), "wide": (1.6, 1e9), "ultrawide": (2.2, 1e9)}


def _quotient(text: str) -> float | None:
    """``16:9``, ``16/9``, ``16x9`` or ``1.78``."""
    try:
        parts = [float(x) for x in re.split("[:/x]", text)]
        return parts[0] / parts[1] if len(parts) == 2 else parts[0] if len(parts) == 1 else None
    except (ValueError, ZeroDivisionError):
        return None


def shape_condition(value: str, sides: tuple[Column, Column]) -> Column:
    """A shape's name, a quotient with a tolerance (``1.5~0.1``), a comparison or ``a..b``; alternatives by ``|``. Sides of nothing never match."""
    ratio, found = F.try_divide(sides[0].cast("double"), F.when((sides[0] > 0) & (sides[1] > 0), sides[1])), F.lit(False)
    for one in value.lower().split("|"):
        op, rest = re.match("(<=|>=|<|>|=)?(.*)$", one).groups()
        text, _, tolerance = rest.partition("~")
        spans = [_quotient(x) for x in rest.split("..", 1)] if ".." in rest else [_quotient(text)]
        if one in SHAPES:
            low, high = SHAPES[one]
        elif None in spans:
            return F.lit(False)
        elif len(spans) == 2:
            low, high = sorted(spans)
        elif op in ("<", "<=", ">", ">="):
            found = found | number_range(f"{op}{spans[0]}", ratio)
            continue
        else:
            spread = float(tolerance) if re.fullmatch(r"\d*\.?\d+", tolerance) else 0.05
            low, high = spans[0] * (1 - spread), spans[0] * (1 + spread)
        found = found | ratio.between(low, high)
    return F.coalesce(found, F.lit(False))


def place_condition(value: str, places: Column) -> Column:
    """Parts by comma or slash, each of which must be one of the places; ``*`` stands for anything."""
    condition = F.lit(True)
    for part in re.split("[,/]", value.lower()):
        condition = condition & F.coalesce(F.exists(F.transform(places, F.lower), _globbed(part.strip())), F.lit(False))
    return condition


def split_negatives(text: str) -> tuple[str, list[str]]:
    """The phrase of a query, and the words that a leading ``-`` turns away."""
    words = text.split()
    return " ".join(w for w in words if not w.startswith("-")), [w[1:] for w in words if w.startswith("-") and len(w) > 1]


def every_term(text: str, columns: list[Column]) -> Column:
    """Each word must occur in one of the columns."""
    condition = F.lit(True)
    for word in text.lower().split():
        found = F.lit(False)
        for column in columns:
            found = found | F.coalesce(_contains(column, word), F.lit(False))
        condition = condition & found
    return condition


def near_condition(value: str, position: tuple[Column, Column]) -> Column:
    """``lat,lon`` or ``lat,lon,km``: inside the box around a point, one kilometre without a distance."""
    try:
        numbers = [float(x) for x in value.split(",")]
    except ValueError:
        return F.lit(False)
    if len(numbers) not in (2, 3):
        return F.lit(False)
    return F.coalesce(box_around(*position, (numbers[0], numbers[1]), numbers[2] if len(numbers) == 3 else 1.0), F.lit(False))


def box_condition(value: str, position: tuple[Column, Column]) -> Column:
    """``south,west,north,east``; a west beyond the east goes round the back of the globe."""
    try:
        south, west, north, east = (float(x) for x in value.split(","))
    except ValueError:
        return F.lit(False)
    lat, lon = position
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return F.coalesce(lat.between(south, north) & across, F.lit(False))


def compile_search(text: str, fields: Fields) -> tuple[Column, list[Column]]:
    """The condition and the order of a search; the key is the last order column."""
    handlers: dict[str, Callable[[str], Column]] = {
        "tag": lambda v: has_tag(fields.tags, v),
        "tags": lambda v: tag_terms(fields.tags, v),
        "tagcount": lambda v: number_range(v, F.coalesce(F.size(fields.tags), F.lit(0))),
        "is": lambda v: tag_state(v, fields.tags),
        **fields.handlers,
    }
    if fields.sides is not None:
        area = fields.sides[0] * fields.sides[1]
        handlers |= {name: lambda v: shape_condition(v, fields.sides) for name in ("ratio", "orient")}
        handlers |= {"pixels": lambda v: number_range(v, area), "mp": lambda v: number_range(v, area / 1e6)}
    if fields.path is not None:
        handlers["path"] = lambda v: _contains(fields.path, v)
        handlers["ext"] = lambda v: F.lower(fields.path).rlike("\\.(" + "|".join(re.escape(x.lower().lstrip(".")) for x in v.split("|")) + ")$")
    for name, column in fields.parts.items():
        handlers[name] = lambda v, c=column: _contains(c, v)
    if fields.position is not None:
        known = fields.position[0].isNotNull() & fields.position[1].isNotNull()
        handlers["gps"] = lambda v: known if v in ("yes", "any") else ~known
        handlers["near"] = lambda v: near_condition(v, fields.position)
        handlers["bbox"] = lambda v: box_condition(v, fields.position)
    if fields.places is not None:
        handlers["location"] = lambda v: place_condition(v, fields.places)
    for name, column in fields.names.items():
        handlers[name] = lambda v, c=column: tag_terms(c, v)
    for name, column in fields.flags.items():
        handlers[name] = lambda v, c=column: F.coalesce(c, F.lit(False)) if v in ("yes", "any") else ~F.coalesce(c, F.lit(False))
    if fields.date is not None:
        handlers["date"] = lambda v: date_condition(v, fields.date)
    for name, column in fields.numbers.items():
        handlers[name] = lambda v, c=column: number_range(v, c)
    for name, column in fields.words.items():
        handlers[name] = lambda v, c=column: F.lower(c).isin([x.lower() for x in v.split("|")])
    condition, order, phrase = F.lit(True), [], []
    for token in _SPLIT.findall(text):
        negative = token.startswith("-") and ":" in token
        name, colon, value = token.removeprefix("-").partition(":")
        value = value.strip('"')
        if name == "sort" and colon:
            key, down = value.removeprefix("-"), value.startswith("-")
            keys = fields.numbers | fields.sorts
            if key in keys:
                order.append(keys[key].desc_nulls_last() if down else keys[key].asc_nulls_last())
        elif colon and name in handlers:
            found = handlers[name](value)
            condition = condition & (~found if negative else found)
        else:
            phrase.append(token.strip('"'))
    if phrase:
        words, found = " ".join(phrase), F.lit(False)
        for column in fields.texts:
            found = found | F.coalesce(_contains(column, words), F.lit(False))
        condition = condition & found
    return condition, [*order, F.col(fields.key).asc()]


def search(files: DataFrame, text: str, fields: Fields, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The rows that meet a search, in its order; ``limit`` and ``offset`` take a page.

    Tokens that other tables answer are semi and anti joins on the key.
    """
    own = []
    for token in _SPLIT.findall(text):
        name, colon, value = token.removeprefix("-").partition(":")
        if not colon or name not in fields.relations:
            own.append(token)
        elif (keys := fields.relations[name](value.strip('"'))) is not None:
            files = files.join(keys.select(fields.key), fields.key, "left_anti" if token.startswith("-") else "left_semi")
    condition, order = compile_search(" ".join(own), fields)
    found = files.where(condition).orderBy(*order)
    if offset:
        found = found.offset(offset)
    return found.limit(limit) if limit else found
