"""Text of books and pages: titles, chunks, plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Articles that a sort title moves behind the rest.
ARTICLES = ("the", "a", "an", "le", "la", "les", "der", "die", "das", "el", "los", "las", "un")


def sort_title(title: Column) -> Column:
    """``The Sea`` gives ``sea, the``."""
    lowered = F.lower(F.trim(title))
    pattern = f"^({'|'.join(ARTICLES)})\\s+(.+)$"
    return F.when(lowered.rlike(pattern), F.regexp_replace(lowered, pattern, "$2, $1")).otherwise(lowered)


def plain_html(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; entities stay as they are, white space becomes one blank."""
    bare = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(bare, "(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), "[ \\t\\n\\r]+", " "))


def first_heading(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1))


def chunks(docs: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 200, back: int = 300, least: int = 80) -> DataFrame:
    """Overlapping pieces of each text, ended at the last sentence end in their tail; short ones are dropped."""

    def cut(value: str) -> list[str]:
        out, at = [], 0
        while at < len(value):
            end = min(at + size, len(value))
            if end < len(value):
                stop = max(value.rfind(mark, end - back, end) for mark in (". ", "! ", "? ", ".\n"))
                end = stop + 1 if stop > at else end
            piece = value[at:end].strip()
            if len(piece) > least:
                out.append(piece)
            if end >= len(value):
                break
            at = max(end - overlap, at + 1)
        return out

    # a hundred texts go to a worker at a time, where an Arrow batch would hold up to ten thousand
    pieces = F.udf(lambda value: cut(value or ""), "array<string>", useArrow=False)
    return docs.select(key, F.posexplode(pieces(F.col(text))).alias("chunk", "piece"))
