"""Main text of web pages by wrapper induction.

Pages of a host with the same kinds of container elements are of one layout; its reference is the page with the smallest id.
Every page's element tree is aligned with that of its reference by simple tree matching: equal labels match, and the
children of matched nodes are aligned in order so that the number of matched nodes is largest. Siblings with one label form one
repeated node, so the trees stay small. Over all pages of a layout, Spark counts for each reference node how often its texts
recur and how much text varies there. The wrapper follows from these counts alone:

- texts that recur in ``RECURS`` of the pages are template;
- nodes whose text varies are slots, and those whose varying text is mostly links are menus;
- the content is the deepest container that holds nearly all text of the slots, with no varying heading, paragraph or other block
  of text beside it; an article is not looked into, and one that holds most is taken whatever containers follow it.

A page's text is what stands in the content slots of its layout, in the page's order, without template texts. A page that
shares nearly all text with the reference is a copy and no evidence. Where no other page gives evidence (a host of
one page) or a page does not have the content container of its layout, the same rule is applied to the text of that page alone.
Elements that say what they are (nav, footer, aside, form and their like, or such a role) are never content, nor are
elements whose class is one of ``ASIDES`` word for word, unless they hold most of the text that varies. Readers' comments are told by a
word for comments in any class or id (``reader-comments``, ``commentList``); such an element stays if it holds most of the
text and an article or a title, as a page's frame does that only says whether comments are open.

What travels to a page is its layout's skeleton: labels, text hashes and counts of one page. Counts are
added up in each task and by partial sums before the shuffle, so a host with a third of all pages is split.
Nulls: a null html has no text; a null url has an empty host, whose pages form one. Repeated rows each get a row.
An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.url_filter import host_and_path
from quaymark.sources.shared import stored

#: The share of a layout's pages in which a text recurs as template, and other pages that show it at least.
RECURS, OTHERS = 0.8, 2
#: Nodes with a larger share of link text are menus.
LINKS = 0.5
#: A page whose text varies from the reference by a smaller share is a copy of it.
COPY = 0.05
#: A container with this share of its parent's content is looked into.
MAIN = 0.8
#: Elements nested deeper are taken as their parent, so that no page exhausts the stack.
DEPTH = 200
ROWS = 256

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "select", "svg", "math", "xmp")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
BREAKS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LEFT_OUT = frozenset("nav header footer aside form menu dialog button head".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu".split())
ASIDES = frozenset("ad ads advert adverts advertisement sidebar comments cookie-banner cookie-notice breadcrumbs newsletter share-buttons".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that are text themselves: beside a container they belong to what it holds.
TEXTS = HEADINGS | frozenset("p blockquote pre ul ol dl table figure figcaption".split())
FRAMES = ("", "html", "body")
_WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[a-zA-Z/!?])[^<]*\Z", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Containers that tell layouts apart.
CONTAINERS = ("<article", "<main", "<section", "<aside", "<header", "<nav", "<form", "<table", "<div")


def _comments(name: str) -> bool:
    """Whether a class or id has a word for readers' comments."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return any(w == "disqus" or (w.startswith("comment") and not w.startswith("commentar")) for w in words)


class Node:
    """An element that isn't inline; ``out``: it or one above is left out."""

    __slots__ = ("tag", "label", "parent", "children", "out", "depth")

    def __init__(self, tag: str, label: str, parent: Node | None, out: bool) -> None:
        self.tag, self.label, self.parent, self.out = tag, label, parent, out
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0


class Page:
    """Blocks of a page in order, as ``(node, text, characters in links)``, and its tree."""

    def __init__(self, html: str | None) -> None:
        self.root = self.at = Node("", "", None, False)
        self.blocks: list[tuple[Node, str, int]] = []
        self.text: list[tuple[str, bool]] = []
        self.links = 0
        #: Open elements below the deepest node, by tag: their end tags close nothing else.
        self.ignored: list[str] = []
        self._parse(html or "")

    def _parse(self, html: str) -> None:
        at = 0
        while True:
            match = _TOKEN.search(html, at)
            if not match:
                self._add(html[at:])
                break
            self._add(html[at : match.start()])
            at = match.end()
            if match[2]:
                tag = match[2].lower()
                if match[1]:
                    self._end(tag)
                elif tag in RAW:
                    close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(html, at)
                    at = close.end() if close else len(html)
                else:
                    self._start(tag, match[3])
        self._flush()

    def _add(self, text: str) -> None:
        if text:
            self.text.append((text, self.links > 0))

    def _flush(self) -> None:
        text = " ".join("".join([entities.unescape(t) for t, _ in self.text]).split())
        linked = sum(len(" ".join(t.split())) for t, inside in self.text if inside)
        self.text = []
        if text:
            self.blocks.append((self.at, text, linked))

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._add("\n")
        elif tag in INLINE:
            self.links += tag == "a"
        elif tag not in VOID:
            self._flush()
            if tag in BREAKS_P:
                self._close(("p",), ("article", "section", "div", "td", "th", "li", "body"))
            elif tag in CLOSES:
                self._close(CLOSES[tag], ("ul", "ol", "dl", "table", "select"))
            self._open(tag, attributes)
        elif tag == "hr":
            self._flush()

    def _open(self, tag: str, attributes: str) -> None:
        if self.at.depth >= DEPTH:
            self.ignored.append(tag)
            return
        named: dict[str, str] = {}
        for k, x, y, z in _ATTRIBUTE.findall(attributes):
            named.setdefault(k.lower(), x or y or z)
        # the header of an article or a section holds its title
        own = tag == "header" and any(n.tag in ("article", "main", "section") for n in self._above())
        out = (tag in LEFT_OUT and not own) or named.get("role", "").lower() in ROLES
        classes = (named.get("class") or "").split()
        names = (*classes, named.get("id", ""))
        aside = "!!" if any(map(_comments, names)) else "!" if ASIDES.intersection(x.lower() for x in names) else ""
        label = f"{tag}.{re.sub('[0-9]+', '', (classes or [''])[0])}{aside}"
        node = Node(tag, label, self.at, out or self.at.out)
        self.at.children.append(node)
        self.at = node

    def _above(self) -> Iterator[Node]:
        node = self.at
        while node:
            yield node
            node = node.parent

    def _close(self, tags: tuple[str, ...], fences: tuple[str, ...]) -> None:
        """Closes the nearest open element of ``tags``, unless a fence stands before it."""
        for k in range(len(self.ignored) - 1, -1, -1):
            if self.ignored[k] in tags:
                del self.ignored[k:]
                return
            if self.ignored[k] in fences:
                return
        for node in self._above():
            if node.tag in tags:
                self.at, self.ignored = node.parent, []
                return
            if node.tag in fences:
                return

    def _end(self, tag: str) -> None:
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            return
        if tag in VOID:
            return
        self._flush()
        if tag in self.ignored:
            # as with nodes, what was opened inside ends with it
            del self.ignored[len(self.ignored) - 1 - self.ignored[::-1].index(tag) :]
            self.links = 0
            return
        for node in self._above():
            if node.tag == tag and node.parent:
                self.at, self.links, self.ignored = node.parent, 0, []
                return


class Tree:
    """A page's tree with the siblings of one label merged; nodes are numbered in preorder."""

    def __init__(self) -> None:
        self.labels: list[str] = []
        self.children: list[list[int]] = []

    @classmethod
    def of(cls, page: Page) -> tuple[Tree, dict[int, int]]:
        """The tree, and the number of each node of the page by its identity."""
        tree, number = cls(), {}

        def add(label: str, members: list[Node]) -> int:
            own = len(tree.labels)
            tree.labels.append(label)
            tree.children.append([])
            merged: dict[str, list[Node]] = {}
            for member in members:
                number[id(member)] = own
                for child in member.children:
                    merged.setdefault(child.label, []).append(child)
            for child_label, children in merged.items():
                tree.children[own].append(add(child_label, children))
            return own

        add("", [page.root])
        return tree, number

    def packed(self) -> list:
        return [self.labels, self.children]

    @classmethod
    def unpacked(cls, packed: list) -> Tree:
        tree = cls()
        tree.labels, tree.children = packed
        return tree


def align(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the nodes of ``a`` matched to nodes of ``b``, as many as can be in order."""
    sizes: dict[tuple[int, int], int] = {}

    def matrix(i: int, j: int) -> list[list[int]]:
        xs, ys = a.children[i], b.children[j]
        m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for p, x in enumerate(xs, 1):
            for q, y in enumerate(ys, 1):
                m[p][q] = max(m[p - 1][q], m[p][q - 1], m[p - 1][q - 1] + size(x, y))
        return m

    def size(i: int, j: int) -> int:
        if a.labels[i] != b.labels[j]:
            return 0
        if (i, j) not in sizes:
            sizes[i, j] = matrix(i, j)[-1][-1] + 1
        return sizes[i, j]

    found = {0: 0}
    open_ = [(0, 0)]
    while open_:
        i, j = open_.pop()
        m, p, q = matrix(i, j), len(a.children[i]), len(b.children[j])
        while p and q:
            if m[p][q] == m[p - 1][q]:
                p -= 1
            elif m[p][q] == m[p][q - 1]:
                q -= 1
            else:
                pair = a.children[i][p - 1], b.children[j][q - 1]
                found[pair[0]] = pair[1]
                open_.append(pair)
                p, q = p - 1, q - 1
    return found


def text_hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def skeleton(html: str | None) -> str:
    """A reference page as JSON: its tree and the hashes of the texts of each node."""
    page = Page(html)
    tree, number = Tree.of(page)
    texts: dict[int, list[int]] = {}
    for node, text, _ in page.blocks:
        if (h := text_hash(text)) not in texts.setdefault(number[id(node)], []):
            texts[number[id(node)]].append(h)
    return json.dumps({"tree": tree.packed(), "texts": texts})


class Reference:
    """A host's skeleton, parsed once in a task for the pages in a row that share it."""

    def __init__(self, packed: str) -> None:
        parts = json.loads(packed)
        self.tree = Tree.unpacked(parts["tree"])
        self.texts = {int(k): set(v) for k, v in parts["texts"].items()}


def content(tree: Tree, chars: dict[int, int]) -> tuple[int, set[int]]:
    """The deepest container that holds nearly all of ``chars``, the varying text of each node but that of menus; and the asides that stay."""
    mass, headed, titled, kept = [0] * len(tree.labels), [False] * len(tree.labels), [False] * len(tree.labels), set()
    tags = [label.partition(".")[0] for label in tree.labels]
    whole = sum(chars.values())
    for i in range(len(tree.labels) - 1, -1, -1):  # children have larger numbers
        mass[i] = chars.get(i, 0) + sum(mass[c] for c in tree.children[i])
        headed[i] = (chars.get(i, 0) > 0 and tags[i] in HEADINGS) or any(headed[c] for c in tree.children[i])
        titled[i] = tags[i] == "article" or (tags[i] == "h1" and chars.get(i, 0) > 0) or any(titled[c] for c in tree.children[i])
        if tree.labels[i].endswith("!"):
            if 2 * mass[i] <= whole or (tree.labels[i].endswith("!!") and not titled[i]):
                mass[i], headed[i] = 0, False
            else:
                kept.add(i)
    at = 0
    while tree.children[at] and tags[at] != "article":
        best = max(tree.children[at], key=lambda c: mass[c])
        beside = [c for c in tree.children[at] if c != best and (headed[c] or (mass[c] > 0 and tags[c] in TEXTS))]
        if chars.get(at, 0) > 0 and tags[at] not in FRAMES:
            break
        if tags[best] == "article" and 2 * mass[best] > mass[at]:
            if any(c < best for c in beside):
                break
        elif beside or 2 * chars.get(best, 0) > mass[best] or mass[best] < MAIN * mass[at]:
            break
        at = best
    return at, kept


COUNTS = "host string, layout long, node int, text long, pages long, chars long, linked long"


def _evidence(page: Page, reference: Reference, into: Counter, key: tuple) -> None:
    """Counts of one page: texts that recur (``text`` is their hash), and the text of each node (``text`` is -1)."""
    tree, number = Tree.of(page)
    match = align(tree, reference.tree)
    placed = [(match.get(number[id(node)]), text, linked) for node, text, linked in page.blocks if not node.out]
    own = [(at, text_hash(text), len(text), linked) for at, text, linked in placed if at is not None]
    varying = [x for x in own if x[1] not in reference.texts.get(x[0], ())]
    if sum(x[2] for x in varying) <= COPY * sum(x[2] for x in own):
        return
    into[key, 0, -1, "pages"] += 1
    for at, h in {(at, h) for at, h, _, _ in own if h in reference.texts.get(at, ())}:
        into[key, at, h, "pages"] += 1
    for at, _, n, linked in varying:
        into[key, at, -1, "chars"] += n
        into[key, at, -1, "linked"] += linked


class Wrapper:
    """What the pages of a layout say of it: template texts, slots, menus and the container of the content."""

    def __init__(self, reference: Reference, template: set[tuple[int, int]], slots: dict[int, int], menus: set[int]) -> None:
        self.reference, self.template, self.slots, self.menus = reference, template, slots, menus
        self.content, self.kept = content(reference.tree, slots) if slots else (None, set())


def _within(page: Page, number: dict[int, int], main: int, kept: set[int]) -> set[int]:
    """The identities of the nodes of a page below the node ``main`` of its tree, but those of asides that are not ``kept``."""
    found: set[int] = set()

    def add(node: Node) -> None:
        found.add(id(node))
        for child in node.children:
            if not child.label.endswith("!") or number[id(child)] in kept:
                add(child)

    def look(node: Node) -> None:
        if number[id(node)] == main:
            add(node)
            return
        for child in node.children:
            look(child)

    look(page.root)
    return found


def main_text(page: Page, wrapper: Wrapper) -> str | None:
    """Blocks of the content slots of a page, joined by empty lines; None if the page has not the container of its layout."""
    if wrapper.content is None:
        return None
    tree, number = Tree.of(page)
    match = align(tree, wrapper.reference.tree)
    main = next((i for i, at in match.items() if at == wrapper.content), None)
    if main is None:
        return None
    inside, kept = _within(page, number, main, {i for i, at in match.items() if at in wrapper.kept}), []
    for node, text, linked in page.blocks:
        at = match.get(number[id(node)])
        if node.out or id(node) not in inside or at in wrapper.menus or (at, text_hash(text)) in wrapper.template:
            continue
        # what the wrapper has not seen is judged by its own links
        if at in wrapper.slots or linked <= LINKS * len(text):
            kept.append(text)
    return "\n\n".join(kept)


def single_text(page: Page) -> str:
    """The text of a page that no other page explains: the same rule, with all its text as varying."""
    tree, number = Tree.of(page)
    chars: dict[int, int] = {}
    blocks = [(node, text) for node, text, linked in page.blocks if not node.out and linked <= LINKS * len(text)]
    for node, text in blocks:
        chars[number[id(node)]] = chars.get(number[id(node)], 0) + len(text)
    inside = _within(page, number, *content(tree, chars))
    return "\n\n".join(text for node, text in blocks if id(node) in inside)


def _hosted(pages: DataFrame) -> DataFrame:
    """The pages with their host and layout: the kinds of containers that they have."""
    html = F.lower("html")
    layout = sum((F.coalesce(F.contains(html, F.lit(tag)).cast("long"), F.lit(0)) * (1 << i) for i, tag in enumerate(CONTAINERS)), F.lit(0).cast("long"))
    return pages.select("page_id", "url", "html", host_and_path(F.col("url"))[0].alias("host"), layout.alias("layout"))


def references(pages: DataFrame) -> DataFrame:
    """``(host, layout, skeleton)`` of the page with the smallest id of each layout, of its first html in order."""

    @F.udf("string", useArrow=True)
    def packed(html: str) -> str:
        return skeleton(html)

    # one row for each layout and task before the shuffle; the pages are fetched by their ids afterwards
    first = stored(pages.groupBy("host", "layout").agg(F.min("page_id").alias("page_id")).where("page_id is not null"), "wrapper-firsts")
    chosen = pages.join(first, ["host", "layout", "page_id"]).groupBy("host", "layout").agg(F.min(F.coalesce("html", F.lit(""))).alias("html"))
    return stored(chosen.select("host", "layout", packed("html").alias("skeleton")), "wrapper-skeletons")


def wrappers(pages: DataFrame, skeletons: DataFrame) -> DataFrame:
    """``(host, layout, skeleton, template, slots, menus)``: what the evidence of all pages makes of each skeleton."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for key, html, reference in _rows(batch):
                if reference:
                    _evidence(Page(html), reference, found, key)
            summed: dict[tuple, list[int]] = {}
            for (key, node, text, what), n in found.items():
                summed.setdefault((*key, node, text), [0, 0, 0])[("pages", "chars", "linked").index(what)] += n
            if summed:
                yield pa.RecordBatch.from_pylist([dict(zip(_COUNTS.names, (*k, *v))) for k, v in summed.items()], schema=_COUNTS)

    key = ["host", "layout"]
    counted = pages.join(skeletons, key, "left").select(*key, "html", "skeleton").mapInArrow(count, COUNTS)
    sums = counted.groupBy(*key, "node", "text").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    # no more rows of a layout than its reference page has nodes and texts
    sums = stored(sums, "wrapper-counts")
    pages_of = sums.where("node = 0 and text = -1").select(*key, F.col("pages").alias("all_pages"))
    recurs = (F.col("text") >= 0) & (F.col("all_pages") >= OTHERS) & (F.col("pages") >= RECURS * F.col("all_pages"))
    varies = (F.col("text") < 0) & (F.col("chars") > 0)
    linked = F.col("linked") > LINKS * F.col("chars")
    node = F.col("node").cast("long").alias("node")
    found = sums.join(pages_of, key).groupBy(*key).agg(
        F.collect_list(F.when(recurs, F.struct(node, "text"))).alias("template"),
        F.collect_list(F.when(varies & ~linked, F.struct(node, "chars"))).alias("slots"),
        F.collect_list(F.when(varies & linked, F.col("node"))).alias("menus"),
    )
    return stored(skeletons.join(found, key, "left").select(*key, "skeleton", "template", "slots", "menus"), "wrappers")


_COUNTS = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("node", pa.int32()), ("text", pa.int64()), ("pages", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Host and layout, html and reference of each row; a skeleton is parsed once for the rows of a batch that share it."""
    parsed: dict[tuple, Reference | None] = {}
    for at in range(0, batch.num_rows, ROWS):
        some = batch.slice(at, ROWS)
        for nth, (host, layout, html) in enumerate(zip(some["host"].to_pylist(), some["layout"].to_pylist(), some["html"].to_pylist())):
            if (key := (host, layout)) not in parsed:
                packed = some["skeleton"][nth].as_py()
                parsed[key] = Reference(packed) if packed else None
            yield key, html, parsed[key]


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, main ``text`` and ``learnt`` (whether a wrapper gave it) of each row of ``pages``."""
    hosted = _hosted(pages)
    learnt = wrappers(hosted, references(hosted))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, Wrapper | None] = {}
            texts, by_wrapper = [], []
            for nth, (key, html, reference) in enumerate(_rows(batch)):
                if key not in known:
                    template, slots, menus = (batch[c][nth].as_py() or () for c in ("template", "slots", "menus"))
                    rules = {(t["node"], t["text"]) for t in template}, {x["node"]: x["chars"] for x in slots}, set(menus)
                    known[key] = Wrapper(reference, *rules) if reference else None
                page = Page(html)
                text = main_text(page, known[key]) if known[key] else None
                by_wrapper.append(text is not None)
                texts.append(single_text(page) if text is None else text)
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(by_wrapper)], names=["page_id", "url", "text", "learnt"])

    joined = hosted.join(learnt, ["host", "layout"], "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "host", "layout", "skeleton", "template", "slots", "menus")
    return joined.mapInArrow(extract, "page_id long, url string, text string, learnt boolean")


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op8 over all pages."""
    found = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "learnt")
