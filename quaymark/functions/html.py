"""HTML as readers see it: text with character references decoded, clean fragments, sections by headings.

The standard parser reads each page once on the executors, which hold few pages at a time. Nulls stay null; what is not well
formed is read as far as browsers' rules go, never an error. Pages are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements whose content is no text, elements and attributes that a clean fragment keeps, and schemes that links may have.
SILENT = ("script", "style")
KEPT_TAGS = (
    "a", "abbr", "b", "blockquote", "br", "caption", "center", "cite", "code", "dd", "del", "div", "dl", "dt", "em", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
    "hr", "i", "img", "ins", "li", "ol", "p", "pre", "q", "s", "small", "span", "strong", "sub", "sup", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "u", "ul",
)
KEPT_ATTRIBUTES = ("href", "src", "alt", "title", "id", "colspan", "rowspan")
VOID = ("br", "hr", "img")
SCHEMES = ("http:", "https:", "mailto:", "#", "data:image/")

_BLANKS = re.compile(r"\s+")
_BODY = re.compile(r"<body[^>]*>(.*)</body>", re.I | re.S)
_SPLIT = re.compile(r"(?=<h[12][\s>])", re.I)
_HEADING = re.compile(r"<h[1-6][^>]*>(.*?)</h[1-6]\s*>", re.I | re.S)


class _Reader(HTMLParser):
    """Calls back for what is outside silent elements; references come decoded."""

    def __init__(self, on_text: Callable[[str], None], on_tag: Callable[[str, list, bool], None] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.on_text, self.on_tag, self.silent = on_text, on_tag, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        elif self.on_tag and not self.silent:
            self.on_tag(tag, attrs, True)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.on_tag and not self.silent:
            self.on_tag(tag, [], False)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.on_text(data)


def _read(html: str, reader: _Reader) -> None:
    reader.feed(html)
    reader.close()


def text_of(html: str) -> str:
    """The text of a page or fragment, references decoded, white space as single blanks."""
    parts: list[str] = []
    _read(html, _Reader(parts.append))
    return _BLANKS.sub(" ", "".join(parts)).strip()


def clean_of(html: str) -> str:
    """A fragment with harmless elements and attributes only; other elements give way to what is in them, silent ones go whole."""
    out: list[str] = []

    def tag(name: str, attrs: list, opens: bool) -> None:
        if name not in KEPT_TAGS:
            return
        if not opens:
            if name not in VOID:
                out.append(f"</{name}>")
            return
        kept = []
        for key, value in attrs:
            value = value or ""
            if key not in KEPT_ATTRIBUTES:
                continue
            if key in ("href", "src") and ":" in value.split("/")[0] and not value.strip().lower().startswith(SCHEMES):
                continue
            kept.append(f' {key}="{escape(value)}"')
        out.append(f"<{name}{''.join(kept)}>")

    _read(html, _Reader(lambda text: out.append(escape(text, quote=False)), tag))
    return "".join(out)


def body_of(html: str) -> str:
    match = _BODY.search(html)
    return match[1] if match else html


def heading_of(html: str) -> str:
    """The text of the first heading; empty without one."""
    match = _HEADING.search(html)
    return text_of(match[1]) if match else ""


def sections_of(html: str) -> list[tuple[str, str, str, int]]:
    """Title, clean fragment, text and number of words of each stretch that an h1 or h2 begins; stretches without text are left out."""
    out = []
    for piece in _SPLIT.split(body_of(html)):
        text = text_of(piece)
        if text:
            out.append((heading_of(piece), clean_of(piece), text, len(re.findall(r"\w+", text))))
    return out


def _mapped(function: Callable[[str], str]) -> Callable[[Column], Column]:
    # a hundred pages go to a worker at a time, where an Arrow batch would hold up to ten thousand
    return F.udf(lambda html: None if html is None else function(html), "string", useArrow=False)


def html_to_text(html: Column) -> Column:
    return _mapped(text_of)(html)


def sanitised(html: Column) -> Column:
    return _mapped(clean_of)(html)


def heading(html: Column) -> Column:
    return _mapped(heading_of)(html)


def sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, nth, title, html, text, words``: a row for each section of each page, in order; the body alone is read."""
    made = "array<struct<title: string, html: string, text: string, words: int>>"

    cut = F.udf(lambda page: [] if page is None else sections_of(page), made, useArrow=False)
    found = pages.select(key, F.posexplode(cut(html)).alias("nth", "s"))
    return found.select(key, "nth", "s.title", "s.html", "s.text", "s.words")
