"""Pages as text: a tree of elements is built first, its hidden branches are cut, and what is left is written as markdown."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, MapType, StringType, StructType

# The roles of elements, marks, classes and names of dates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("main article section div p li ul ol h1 h2 h3 h4 h5 h6 pre blockquote tr".split())
OMITTED = frozenset("script style noscript nav header footer aside figcaption svg form button table".split())
HIDDEN_CLASSES = frozenset("w-dyn-hide w-dyn-bind-empty w-condition-invisible".split())
MARKS = {"sup": ("^(", ")"), "sub": ("_(", ")"), "del": ("[deleted: ", "]"), "ins": ("[inserted: ", "]")}
DATE_NAMES = ("datePublished", "article:published_time", "publishedTime")
REGIONS = ("main", "body", "article")
MOST_DEPTH = 128

_NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!important\s*)?(?:;|$)", re.I)
_HEADING = re.compile(r"h[1-6]")
_ENDED, _CUT_OFF = 1, 2  # by its own end tag, or by that of an element around it


@dataclass
class _Element:
    tag: str
    attributes: dict
    children: list = field(default_factory=list)
    end: int = 0


class _Tree(HTMLParser):
    """Elements as they are nested; an end tag ends all that was opened inside its element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Element("", {})
        self.path = [self.root]
        self.too_deep = False

    def handle_starttag(self, tag, attrs):
        element = _Element(tag, dict(attrs))
        self.path[-1].children.append(element)
        if tag not in VOID:
            self.path.append(element)
            self.too_deep |= len(self.path) > MOST_DEPTH + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        depth = next((i for i in range(len(self.path) - 1, 0, -1) if self.path[i].tag == tag), 0)
        if depth:
            for element in self.path[depth:]:
                element.end = _CUT_OFF
            self.path[depth].end = _ENDED
            del self.path[depth:]

    def handle_data(self, data):
        self.path[-1].children.append(data)


class Page:
    """markdown, title, n_links, metadata, conflict (of dates) and linked_data (JSON-LD texts) of a page; problem instead, if it is nested too deep."""

    def __init__(self, html: str, url: str = ""):
        tree = _Tree()
        tree.feed(html)
        tree.close()
        self.url, self.metadata, self.conflict, self.linked_data, self.n_links = url, {}, False, [], 0
        self.problem = "too_deep" if tree.too_deep else None
        self.markdown = self.title = ""
        if self.problem:
            return
        self.generated = any(isinstance(e, _Element) and e.tag == "html" and e.attributes.get("data-wf-site") and e.attributes.get("data-wf-page") for e in tree.root.children)
        self.regions: dict[str, list[_Element]] = {r: [] for r in REGIONS}
        self._survey(tree.root)
        chosen = next((self.regions[r][0] for r in REGIONS if len(self.regions[r]) == 1), tree.root)
        out: list[str] = []
        for child in [chosen] if chosen is not tree.root else chosen.children:
            self._write(child, out, chosen.tag == "pre")
        text = re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+\n", "\n", "".join(out)))
        self.markdown = re.sub(r"\n{3,}", "\n\n", text).strip()
        self.title = self.title.strip()

    def _hidden(self, e: _Element) -> bool:
        own = e.attributes
        return e.tag in OMITTED or "hidden" in own or own.get("aria-hidden") == "true" or bool(_NOT_SHOWN.search(own.get("style") or "")) or (self.generated and not HIDDEN_CLASSES.isdisjoint((own.get("class") or "").split()))

    def _survey(self, e: _Element) -> None:
        """Dates, titles, linked data and the regions that hold the article."""
        for child in e.children:
            if isinstance(child, str):
                continue
            if child.tag == "script" and (child.attributes.get("type") or "").lower() == "application/ld+json" and child.end == _ENDED:
                self.linked_data.append("".join(x for x in child.children if isinstance(x, str)))
            if self._hidden(child):
                continue
            if child.tag == "meta":
                self._date(child.attributes)
            elif child.tag == "title":
                self.title += "".join(x for x in child.children if isinstance(x, str))
            if child.end:
                if "articleBody" in (child.attributes.get("itemprop") or "").split():
                    self.regions["body"].append(child)
                elif child.tag in ("main", "article"):
                    self.regions[child.tag].append(child)
            self._survey(child)

    def _date(self, own: dict) -> None:
        name, value = own.get("property") or own.get("name"), own.get("content")
        if name in DATE_NAMES and value:
            self.conflict |= self.metadata.get(name, value) != value
            self.metadata[name] = value

    def _write(self, e, out: list[str], literal: bool) -> None:
        if isinstance(e, str):
            out.append(e if literal else re.sub(r"\s+", " ", e))
            return
        if e.tag in ("head", "title") or self._hidden(e):
            return
        if e.tag == "br":
            out.append("\n")
        opening, closing = MARKS.get(e.tag, ("", ""))
        if e.tag in BLOCK:
            opening, closing = "\n\n# " if _HEADING.fullmatch(e.tag) else "\n\n", "\n\n"
        elif e.tag == "a":
            opening, closing = "[", f"]({urljoin(self.url, e.attributes.get('href') or '')})"
            self.n_links += bool(e.attributes.get("href"))
        out.append(opening)
        for child in e.children:
            self._write(child, out, literal or e.tag == "pre")
        if e.end == _ENDED:
            out.append(closing)


PAGE = (
    StructType().add("markdown", StringType()).add("title", StringType()).add("n_links", LongType())
    .add("metadata", MapType(StringType(), StringType())).add("conflict", BooleanType()).add("linked_data", ArrayType(StringType())).add("problem", StringType())
)


@F.pandas_udf(PAGE)
def _read(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    pages = [Page(text or "", address or "") for text, address in zip(html, url)]
    return pd.DataFrame({f.name: [getattr(p, f.name) for p in pages] for f in PAGE.fields}, columns=[f.name for f in PAGE.fields])


def read_html(html: Column | str, url: Column | str | None = None) -> Column:
    """Each page as a struct: markdown, title, n_links, metadata (dates by name), conflict, linked_data, problem. url makes links absolute. A null page is an empty one."""
    return _read(html, F.lit("") if url is None else url)
