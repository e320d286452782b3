"""Named orders of songs, albums and groups: the primary columns take the direction, ties always rise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE, MOST = 200, 5000

# For each name of an order its primary columns, then its ties. ``~`` takes no notice of the case of A-Z, ``0`` takes null as
# zero, ``?`` puts blanks last in both directions.
_IN_ALBUM = "disc0 track0 title~"
SONGS = {
    "default": ("name~", f"album~ {_IN_ALBUM}"),
    "artist": ("name~", f"album~ {_IN_ALBUM}"),
    "album": ("album~", f"name~ {_IN_ALBUM}"),
    "title": ("title~", "name~"),
    "track": ("disc0 track0", "title~"),
    "year": ("year?", f"name~ album~ {_IN_ALBUM}"),
    "genre": ("genre~", f"name~ album~ {_IN_ALBUM}"),
    "duration": ("duration0", "title~"),
    "added": ("created0", f"album~ {_IN_ALBUM}"),
    "bitrate": ("bitrate0", "title~"),
    "size": ("size0", "title~"),
    "path": ("path", ""),
}
ALBUMS = {
    "default": ("name~", "year album~"),
    "artist": ("name~", "year album~"),
    "album": ("album~", "artist~"),
    "title": ("album~", "artist~"),
    "year": ("year?", "artist~ album~"),
    "tracks": ("tracks", "album~"),
    "duration": ("duration", "album~"),
    "added": ("added", "album~"),
    "genre": ("genre~", "artist~ album~"),
}
GROUPS = {name: ("name~", "") for name in ("default", "artist", "title", "genre")} | {name: (name, "name~") for name in ("tracks", "albums", "duration", "added")}


def _nocase(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _orders(column: str, descending: bool) -> list[Column]:
    name, mark = (column[:-1], column[-1]) if column[-1] in "~0?" else (column, "")
    value = {"~": _nocase(F.col(name)), "0": F.coalesce(F.col(name), F.lit(0))}.get(mark, F.col(name))
    blank = [(F.col(name).isNull() | (F.col(name).cast("string") == "")).asc()] if mark == "?" else []
    return [*blank, value.desc_nulls_last() if descending else value.asc_nulls_first()]


def sort_columns(sorts: dict[str, tuple[str, str]], name: str | None, descending: bool) -> list[Column]:
    """The columns to order by; an unknown or missing name means the default. Null is less than all else."""
    primary, ties = sorts.get((name or "default").lower(), sorts["default"])
    return [o for c in primary.split() for o in _orders(c, descending)] + [o for c in ties.split() for o in _orders(c, False)]


def sorted_page(rows: DataFrame, sorts: dict[str, tuple[str, str]], name: str | None, descending: bool, last: str, size: int | None = None, most: int = MOST) -> DataFrame:
    """The first page of ``rows`` in a named order; ``last`` settles what is still equal.

    A page has ``size`` rows, ``PAGE`` if none or less than one is asked for, and never more than ``most``. The tasks keep a page each, so nothing is sorted as a whole.
    """
    rows_asked = min(size, most) if size and size > 0 else min(PAGE, most)
    return rows.orderBy(*sort_columns(sorts, name, descending), last).limit(rows_asked)
