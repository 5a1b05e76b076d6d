"""Web pages to chapter records by rules of their sites."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import pages as H
from ..plans.spread import spread
from ..sources.tables import table

# How a page carries the order of shuffled paragraphs, and what says so on their container.
ORDER_ATTRIBUTE, ORDER_STYLE, ORDER_MARKS = "data-reader-order-index", re.compile(r"\border\s*:\s*(\d+)"), ("data-reader-order", "data-reader-order-count")
JUNK = "script, style, ins, .ads, .adsbygoogle"
_NUMBER = re.compile(r"(?i)\bchapter\s+(\d+)")
_PATH_NUMBER = re.compile(r"(\d+)/?$")


@dataclass(frozen=True)
class Site:
    """Selectors of a site, which is known by the end of a page's host. Of titles and links the first selector that names something counts."""

    host: str
    content: str
    title: tuple[str, ...] = ("h1",)
    previous: tuple[str, ...] = ()
    next: tuple[str, ...] = ()
    junk: str = JUNK


def order_of(p: H.Node) -> int | None:
    own = p.attrs.get(ORDER_ATTRIBUTE, "").strip()
    style = ORDER_STYLE.search(p.attrs.get("style", ""))
    return int(own) if own.isdigit() else int(style[1]) if style else None


def paragraphs(content: H.Node) -> list[str] | None:
    """The texts of a container's paragraphs in reading order: by their marks where each has one of its own, else as written. None where
    the page shuffles them (its container says so, or half of them are marked) and the marks do not tell the order."""
    found = list(H.select(content, "p"))
    marks = [order_of(p) for p in found]
    known = [m for m in marks if m is not None]
    if found and len(set(known)) == len(found):
        found = [p for _, p in sorted(zip(marks, found, strict=True), key=lambda x: x[0])]
    elif any(a in content.attrs for a in ORDER_MARKS) or (found and 2 * len(known) >= len(found)):
        return None
    return [t for p in found if (t := p.text())]


def _link(root: H.Node, url: str, selectors: tuple[str, ...]) -> str | None:
    for selector in selectors:
        for node in H.select(root, selector):
            href = node.attrs.get("href", "").strip()
            if href and not href.startswith(("#", "javascript:")):
                return urljoin(url, href)
    return None


def chapter(html: str, url: str, sites: list[Site]) -> tuple:
    """(status, title, paragraphs, text, previous, next, number) of one page."""
    host = urlsplit(url).hostname or ""
    site = next((s for s in sites if host == s.host or host.endswith("." + s.host)), None)
    if site is None:
        return "unknown site", None, None, None, None, None, None
    root = H.tree(html)
    titles = (t for s in site.title for node in H.select(root, s) if (t := node.text()))
    title = next(titles, None) or next((t.text() for t in H.select(root, "title")), None)
    links = _link(root, url, site.previous), _link(root, url, site.next)
    told = _NUMBER.search(title or "") or _PATH_NUMBER.search(urlsplit(url).path)
    number = int(told[1]) if told and len(told[1]) < 19 else None
    content = next(H.select(root, site.content), None)
    if content is None:
        return "no content", title, None, None, *links, number
    H.remove(content, site.junk)
    texts = paragraphs(content)
    if texts is None:
        return "order unknown", title, None, None, *links, number
    return "read", title, len(texts), "\n\n".join(texts) if texts else content.text("\n"), *links, number


def site_chapters(pages: DataFrame, sites: list[Site]) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, status, title, paragraphs, text, previous, next, number). A page of an unknown site, without its
    site's content or with paragraphs in an order that cannot be told has a status and no text; null urls and html are empty."""
    kinds = [("status", pa.string()), ("title", pa.string()), ("paragraphs", pa.int64()), ("text", pa.string()), ("previous", pa.string()), ("next", pa.string()), ("number", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [chapter(html or "", url or "", sites) for url, html in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = [pa.array([f[k] for f in found], t) for k, (_, t) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["page_id", *(n for n, _ in kinds)])

    return spread(pages.select("page_id", "url", "html")).mapInArrow(run, "page_id long, status string, title string, paragraphs long, text string, previous string, next string, number long")


#: Sites of the queries; pages of the third kind of domain are unknown.
SITES = [Site("example.com", "article", previous=("nav li a",), next=("a[href^='/t']",)), Site("example.net", "article", title=("article p b", "h1"), next=("nav a",))]

QUERIES = {"site_chapters": lambda s, d: site_chapters(table(s, d, "pages"), SITES)}
ORACLE: dict[str, str] = {}
