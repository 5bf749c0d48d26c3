"""HTML to paragraphs, links and calendar entries.

A small tree is built by the standard library's tokenizer: elements stay open until their end tag or an ancestor's,
void elements close at once, stray end tags are passed over. Arrow UDFs wrap the functions for columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that part paragraphs, elements without text, elements without end tags.
BLOCK_TAGS = ("p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "br", "hr", "dd", "dt")
SILENT_TAGS = ("script", "style", "noscript", "svg")
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer", "menuitem", "keygen")

_SPACE = re.compile(r"\s+")
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


class Node:
    """An element, its attributes, children (nodes and strings) and parent."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order, without recursion."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        """All strings below, in document order."""
        todo: list = list(reversed(self.children))
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                yield item
            else:
                todo += reversed(item.children)

    def text(self) -> str:
        """The strings below, trimmed, the empty ones dropped, joined by a space."""
        return " ".join(s for s in (x.strip() for x in self.strings()) if s)

    def has_class(self, name: str) -> bool:
        """Whether the class attribute holds ``name``."""
        return name in self.attrs.get("class", "").split()

    def enclosing(self, tag: str, cls: str) -> Node | None:
        """The nearest ancestor with this tag and class."""
        node = self.parent
        while node is not None and not (node.tag == tag and node.has_class(cls)):
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        node = Node(tag, found, self.at)
        self.at.children.append(node)
        if tag not in VOID_TAGS:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        while True:
            node, self.at = self.at, self.at.parent
            self.open[node.tag] -= 1
            if node.tag == tag:
                return

    def handle_data(self, data):
        self.at.children.append(data)


def close_references(html: str) -> str:
    """The page with each ampersand that begins no closed character reference written as one, so that it is read as it stands."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + (m[1] or ""), html)


def parse(html: str) -> Node:
    """The tree of a page."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def html_to_paragraphs(html: str | None, prefer_article: bool = True, open_references: bool = True) -> list[str]:
    """Paragraphs of a page: the element with id ``article`` if wanted and there, else the body, else all of it. A character reference without
    its semicolon counts, as in HTML, unless ``open_references`` is false: it then stays as it is written."""
    if not html:
        return []
    tree = parse(html if open_references else close_references(html))
    root = body = None
    silent: set[int] = set()
    for node in tree.walk():
        if id(node.parent) in silent or node.tag in SILENT_TAGS:
            silent.add(id(node))
        elif root is None and prefer_article and node.attrs.get("id") == "article":
            root = node
        elif body is None and node.tag == "body":
            body = node
    out: list[str] = []
    line: list[str] = []

    def part():
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    todo: list = list(reversed((root or body or tree).children))
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            line.append(_SPACE.sub(" ", item))
        elif item is None:
            part()
        elif id(item) not in silent:
            block = item.tag in BLOCK_TAGS
            if block:
                part()
                todo.append(None)
            todo += reversed(item.children)
    part()
    return out


def links(block: Node, site: str) -> list[tuple[str, str]]:
    """(href, text) of all anchors of a block, the site's own address taken off."""
    own = re.compile(rf"^https?://{re.escape(site)}")
    anchors = [n for n in [block, *block.walk()] if n.tag == "a"]
    return [(own.sub("", n.attrs.get("href", "").strip()), n.text()) for n in anchors]


MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"


def archive_entries(html: str | None, site: str) -> list[dict]:
    """An archive year's entries: each fifth-level heading with a month, and the links and text of the panel around it."""
    out = []
    for node in parse(html or "").walk():
        if node.tag == "h5" and re.search(MONTH, label := node.text()):
            panel = node.enclosing("div", "panel")
            out.append({"label": label, "year": None, "dates": None, "month": None, "links": links(panel, site) if panel else [], "text": panel.text() if panel else ""})
    return out


def recent_entries(html: str | None, site: str, heading: str = r"^\s*(\d{4}) FOMC Meetings\s*$") -> list[dict]:
    """The current calendar's entries: each meeting of each year's panel that has a month and dates."""
    out = []
    root = parse(html or "")
    for node in root.walk():
        for child in node.children:
            if not (isinstance(child, str) and (m := re.match(heading, child))):
                continue
            panel = node if node.tag == "div" and node.has_class("panel") else node.enclosing("div", "panel")
            for meeting in panel.walk() if panel else ():
                if not (meeting.tag == "div" and meeting.has_class("fomc-meeting")):
                    continue
                month = next((n for n in meeting.walk() if n.has_class("fomc-meeting__month")), None)
                dates = next((n for n in meeting.walk() if n.has_class("fomc-meeting__date")), None)
                if month is not None and dates is not None:
                    out.append({"label": f"{month.text()} {dates.text()}", "year": int(m[1]), "dates": dates.text(), "month": month.text(), "links": links(meeting, site), "text": meeting.text()})
    return out


LINKS = T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())]))
ENTRIES = T.ArrayType(
    T.StructType(
        [T.StructField("label", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("dates", T.StringType()), T.StructField("month", T.StringType()), T.StructField("links", LINKS), T.StructField("text", T.StringType())]
    )
)


def limit_batches(spark: SparkSession, rows: int = 256) -> None:
    """Cut the session's Arrow batches to at most ``rows`` rows: ten thousand long pages would fill a worker. This changes the session's setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def paragraphs_udf(prefer_article: bool = True, open_references: bool = True):
    """Column function: page -> array of paragraphs (empty for null)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def paragraphs(html: pd.Series) -> pd.Series:
        return html.map(lambda h: html_to_paragraphs(h, prefer_article, open_references))

    return paragraphs


def links_udf(site: str):
    """Column function: page -> array of (href, text)."""

    @F.pandas_udf(LINKS)
    def found(html: pd.Series) -> pd.Series:
        return html.map(lambda h: [{"href": a, "text": b} for a, b in links(parse(h or ""), site)])

    return found


def entries_udf(kind: str, site: str):
    """Column function: calendar page -> array of entries; ``kind`` is ``archive`` or ``recent``."""
    read = {"archive": archive_entries, "recent": recent_entries}[kind]

    @F.pandas_udf(ENTRIES)
    def entries(html: pd.Series) -> pd.Series:
        return html.map(lambda h: [e | {"links": [{"href": a, "text": b} for a, b in e["links"]]} for e in read(h, site)])

    return entries
