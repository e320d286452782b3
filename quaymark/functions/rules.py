"""Rules about names, dates, tags and texts of files, as columns. Nulls count as empty text unless a rule says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings and beginnings of names of partial and temporary files.
TEMP_SUFFIXES = (".part", ".partial", ".crdownload", ".download", ".opdownload", ".filepart", ".tmp", ".temp", ".!qb", ".!ut", ".dtapart", ".swp")
TEMP_PREFIXES = ("~$", "~lock.")
# EXIF names whose date is another one than they say.
EXIF_DATES = {"createdate": "d_digitized", "datetimedigitized": "d_digitized", "modifydate": "d_actual", "datetime": "d_actual", "datetimeoriginal": "d_original"}
# Text that stands for no.
FALSE_WORDS = ("", "no", "false", "0", "none", "null")
# The lines around a public-domain book.
BOOK_START, BOOK_END = (rf"(?is)\*\*\*\s*{w} OF (?:THE|THIS) PROJECT GUTENBERG.*?\*\*\*" for w in ("START", "END"))


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


# names


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(_text(path), F.lit("\\"), F.lit("/")), "/"), -1)


def folder_of(path: Column) -> Column:
    """The folder part of a path; empty at the root."""
    return F.regexp_extract(_text(path), "^(.*)/[^/]*$", 1)


def stem(name: Column) -> Column:
    """A base name without its extension; a leading point begins no extension."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def stem_keys(path: Column) -> Column:
    """``key``: the stem in small letters; ``key2``: the same without the ``_2`` that an upload adds to a name that was taken."""
    key = F.lower(F.trim(stem(base_name(path))))
    return F.struct(key.alias("key"), F.regexp_replace(key, r"_\d+$", "").alias("key2"))


def temporary(name: Column) -> Column:
    """The ending or beginning that shows a partial or temporary file; null for others."""
    low = F.lower(_text(name))
    found = [F.when(F.startswith(low, F.lit(p)), p) for p in TEMP_PREFIXES] + [F.when(F.endswith(low, F.lit(s)), s) for s in TEMP_SUFFIXES]
    return F.coalesce(*found)


def sidecar_changed(sidecar: Column, row: Column, seen: Column, synced: Column) -> Column:
    """Whether a sidecar has changed since it was last seen, is newer than its row and came after the last sync. Never seen: no."""
    asked = (sidecar > 0) & seen.isNotNull() & (sidecar > F.coalesce(synced, F.lit(0.0)))
    return F.coalesce(asked & (sidecar - seen >= 0.01) & (sidecar > F.coalesce(row, F.lit(0.0))), F.lit(False))


# dates


def date_bucket(field: Column) -> Column:
    """Which of the five dates of a file a metadata field tells; null for none."""
    name = F.lower(_text(field))
    tail = F.element_at(F.split(name, r"\."), -1)
    has = lambda *words: name.rlike("|".join(words))
    exif = F.coalesce(*[F.when(tail == t, b) for t, b in EXIF_DATES.items()])
    named = (
        F.when(tail == "datetimeoriginal", "d_original")
        .when(~has("date", "time", "digitized", "modified", "created", "capture") | has("zone", "offsettime", "subsectime"), None)
        .when(has("original"), "d_original")
        .when(has("capture"), "d_capture")
        .when(has("digitized", "digital"), "d_digitized")
        .when(has("modif"), "d_modified")
        .otherwise("d_actual")
    )
    return F.when(F.startswith(name, F.lit("exif.")) & exif.isNotNull(), exif).otherwise(named)


# texts


def truthy(value: Column) -> Column:
    """Text that does not say no; numbers but zero. Null is false."""
    return ~F.lower(F.trim(_text(value))).isin(*FALSE_WORDS)


def listed(values: Column) -> Column:
    """An array as text: its members that are there, with commas."""
    return F.array_join(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull()), ", ")


def compared(value: Column, op: str, to: str = "") -> Column:
    """The five comparisons of text: ``not_empty``, ``empty``, ``equals``, ``contains``, ``matches``; case does not matter."""
    text = _text(value)
    if op == "matches":
        return text.rlike(f"(?i){to}") if to else F.lit(False)
    return {
        "not_empty": F.trim(text) != "", "empty": F.trim(text) == "", "equals": F.lower(F.trim(text)) == to.strip().lower(), "contains": F.contains(F.lower(text), F.lit(to.lower()))
    }[op]


def matched(text: Column, pattern: str, group: int = 0) -> Column:
    """What a pattern finds, in any case and over lines; null if it finds nothing."""
    return F.nullif(F.regexp_extract(_text(text), f"(?is){pattern}", group), F.lit(""))


def filled_in(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), _text(value))
    return out


def gated(value: Column, run: Column, invert: bool = False) -> Column:
    """The value where ``run`` lets it pass."""
    return F.when(truthy(run) != F.lit(invert), value)


def without_boilerplate(text: Column) -> Column:
    """What stands between the start and the end line of a public-domain book; texts without them as they are."""
    start = F.regexp_instr(text, F.lit(BOOK_START))
    body = F.when(start > 0, F.substr(text, start + F.char_length(F.regexp_substr(text, F.lit(BOOK_START))))).otherwise(text)
    end = F.regexp_instr(body, F.lit(BOOK_END))
    return F.when(end > 0, F.substr(body, F.lit(1), end - 1)).otherwise(body)


def engagement(tags: Column) -> Column:
    """``up, down, views, source`` out of tags such as ``score_up: 1,200`` or ``site=Safebooru``; of several, the last that can be read."""
    pattern = lambda names: rf"(?i)^\s*(?:{names})\s*[:=]\s*(.+?)\s*$"
    of = lambda names: F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.regexp_extract(t, pattern(names), 1)), lambda v: v != "")
    number = lambda names: F.try_element_at(F.filter(F.transform(of(names), lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("double")), lambda v: v.isNotNull()), F.lit(-1))
    return F.struct(
        number("score_up").alias("up"), number("score_down").alias("down"), number("views").alias("views"), F.lower(F.try_element_at(of("source|site"), F.lit(-1))).alias("source")
    )


# documents


def text_verdict(size: Column, text: Column, has_owner: Column) -> Column:
    """``verdict, reason`` of a ``.txt``: a tag list beside a file, a book, or for a person to look at.

    A file of the same stem beside it owns it; so does the shape of one line of commas without a sentence. Long prose is a book.
    """
    whole = F.regexp_replace(_text(text), r"^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$", "")
    count = lambda column, pattern: F.regexp_count(column, F.lit(pattern))
    tag_line = (count(F.substring_index(whole, "\n\n", 1), ",") >= 3) & (count(whole, "\n") <= 2) & (count(whole, r"""[.!?]["')\]]?\s""") == 0)
    said = lambda verdict, reason: F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))
    return (
        F.when(has_owner, said("sidecar", "tags of the file beside it"))
        .when(size < 512, said("sidecar", "too small for a book"))
        .when(F.contains(_text(text), F.lit("\x00")), said("skip", "no text"))
        .when((size < 4096) & tag_line, said("sidecar", "one line with commas and no sentence"))
        .when(size < 4096, said("triage", "short enough for either"))
        .when(count(_text(text), "[A-Za-z']+") < 50, said("triage", "too few words"))
        .otherwise(said("book", "prose"))
    )


def page_verdict(size: Column, html: Column, text: Column, has_owner: Column, saved_beside: Column, unpacked: Column) -> Column:
    """``verdict, reason`` of an ``.html``: a story, a saved or an index page, a chapter, or for a person to look at.

    ``text``: what a reader sees of it; ``saved_beside``: a folder with its pictures is there; ``unpacked``: it lies in an unpacked book.
    """
    low, seen = F.lower(_text(html)), F.char_length(_text(text))
    has = lambda words: F.contains(low, F.lit(words))
    links = F.regexp_count(low, F.lit("<a "))
    said = lambda verdict, reason: F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))
    return (
        F.when(unpacked, said("part", "component of an unpacked book"))
        .when(saved_beside, said("skip", "saved page"))
        .when(has_owner, said("part", "beside a file of its name"))
        .when(has("archiveofourown.org") | has("fanfiction.net"), said("book", "archive export"))
        .when(has('<meta name="generator" content="calibre'), said("book", "made by a converter"))
        .when(has("epub:type"), said("part", "chapter of an unpacked book"))
        .when((size < 8192) & (seen < 1500), said("skip", "little text"))
        .when((links > 60) & (seen < 4000), said("skip", "index page"))
        .when(seen > 6000, said("book", "body text"))
        .otherwise(said("triage", "ambiguous"))
    )
