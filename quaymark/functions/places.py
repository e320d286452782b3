"""Where a template puts a file: tokens with filters in segments, an owner's tree kept, clashes numbered.

``{year}/{title|slug|default:untitled}/{name}.{ext}``: a segment that renders to nothing goes; a value never makes a
segment of its own. The last segment is the file's name if it uses ``name`` or ``ext``, and always ends with the extension.
Nulls are empty values. An unknown token is empty, an unknown filter changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\{([^{}|]+)((?:\|[^{}|]+)*)\}")
_EDGES = r"^[\s\-_.,]+|[\s\-_,]+$"


def slug(text: Column) -> Column:
    """Small ASCII letters and digits with single hyphens between; Latin letters lose their marks."""
    marked, bare = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), marked, bare)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))


def filtered(value: Column, spec: str) -> Column:
    name, _, argument = spec.partition(":")
    name = name.strip().lower()
    if name == "lower":
        return F.lower(value)
    if name == "upper":
        return F.upper(value)
    if name == "default":
        return F.when(value == "", argument).otherwise(value)
    if name == "slug":
        return slug(value)
    if name == "pad2":
        return F.when((F.char_length(value) == 1), F.concat(F.lit("0"), value)).otherwise(value)
    return value


def _segment(text: str, fields: Mapping[str, Column]) -> tuple[Column, set[str]]:
    parts, used, at = [], set(), 0
    for match in _TOKEN.finditer(text):
        parts.append(F.lit(text[at : match.start()]))
        token = match[1].strip().lower()
        used.add(token)
        value = F.coalesce(fields[token].cast("string"), F.lit("")) if token in fields else F.lit("")
        for spec in match[2].split("|")[1:]:
            value = filtered(value, spec)
        parts.append(F.regexp_replace(value, r"[/\\]", "-"))
        at = match.end()
    joined = F.regexp_replace(F.concat(*parts, F.lit(text[at:])), _EDGES, "")
    return F.when(joined.isin(".", ".."), "").otherwise(joined), used


def rendered_path(template: str, fields: Mapping[str, Column]) -> Column:
    """The path of a file; ``fields`` must hold ``name`` and ``ext``, the extension with its dot."""
    name, ext = (F.coalesce(fields[f].cast("string"), F.lit("")) for f in ("name", "ext"))
    base = F.concat(name, ext)
    segments = [s for s in template.replace("\\", "/").strip().split("/") if s.strip()]
    folders, filename = [], base
    for i, segment in enumerate(segments):
        text, used = _segment(segment, fields)
        if i == len(segments) - 1 and used & {"name", "ext"}:
            ends = F.lower(F.concat(F.lit("."), F.regexp_extract(text, r"[^.]\.([^.]*)$", 1))) == F.lower(ext)
            filename = F.when(text == "", base).when(ends | ((ext == "") & ~text.contains(".")), text).otherwise(F.concat(text, ext))
        else:
            folders.append(F.nullif(text, F.lit("")))
    return F.when(filename == "", "").otherwise(F.concat_ws("/", *folders, filename))


def in_owner_tree(target: Column, path: Column, root: str = "users") -> Column:
    """The target, below the owner's folder if the file is in one (``users/<name>/...``) and the target has left it."""
    clean = F.trim(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), F.lit("/"))
    parts = F.split(clean, "/")
    prefix = F.concat(F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)), F.lit("/"))
    owned = (F.size(parts) >= 3) & (F.lower(F.get(parts, F.lit(0))) == root) & (F.get(parts, F.lit(1)) != "")
    return F.when(owned & ~F.startswith(F.lower(target), F.lower(prefix)), F.concat(prefix, target)).otherwise(target)


def without_clashes(files: DataFrame, key: str, target: str) -> DataFrame:
    """``target`` with `` (2)``, `` (3)`` before the extension of the second and later files of one place, by key; case does not tell places apart."""
    nth = F.row_number().over(Window.partitionBy(F.lower(target)).orderBy(key))
    stem, ext = F.regexp_replace(target, r"(?<=[^/.])\.[^./]*$", ""), F.regexp_extract(target, r"(?<=[^/.])(\.[^./]*)$", 1)
    numbered = files.withColumn("_nth", nth)
    return numbered.withColumn(target, F.when(F.col("_nth") > 1, F.concat(stem, F.lit(" ("), F.col("_nth").cast("string"), F.lit(")"), ext)).otherwise(F.col(target))).drop("_nth")
