"""A web page as a tree, and the few selectors that a table of sites needs: tags, #ids, .classes, [attributes] with =, *= or ^=, one inside
another, several by commas. A reader of one row; Spark deals out the pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What ends a paragraph that is not closed.
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_PART = re.compile(r"#([\w-]+)|\.([\w-]+)|\[([\w:-]+)(?:([*^]?=)[\"']?([^\"'\]]*)[\"']?)?\]|([\w-]+|\*)")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    inside: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """All nodes below, in order, without recursion."""
        open_ = [iter(self.inside)]
        while open_:
            child = next(open_[-1], None)
            if child is None:
                open_.pop()
            elif isinstance(child, Node):
                yield child
                open_.append(iter(child.inside))

    def text(self, separator: str = " ") -> str:
        parts, open_ = [], [iter(self.inside)]
        while open_:
            child = next(open_[-1], None)
            if child is None:
                open_.pop()
            elif isinstance(child, str):
                parts.append(child.strip())
            else:
                open_.append(iter(child.inside))
        return separator.join(p for p in parts if p)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close("p", BLOCKS - {"p"})
        if tag == "li":
            self._close("li", {"ul", "ol"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inside.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close(tag, set())

    def handle_data(self, data):
        self.at.inside.append(data)

    def _close(self, tag: str, within: set[str] | frozenset[str]) -> None:
        """Ends the nearest open tag of that name, and all that is open in it; none, where one of `within` stands between."""
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            if node.tag in within:
                return
            node = node.parent


def tree(html: str) -> Node:
    """The page's tree. Tags that are not closed end with what they stand in, closing tags of nothing are passed over."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.root


def _fits(node: Node, compound: str) -> bool:
    for ident, cls, attr, how, value, tag in _PART.findall(compound):
        own = node.attrs.get(attr)
        if ident and node.attrs.get("id") != ident or cls and cls not in node.attrs.get("class", "").split() or tag and tag not in ("*", node.tag):
            return False
        if attr and (own is None or how == "=" and own != value or how == "*=" and value not in own or how == "^=" and not own.startswith(value)):
            return False
    return True


def select(root: Node, selector: str) -> Iterator[Node]:
    """Nodes that a selector names, in order."""
    chains = [re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", s) for s in selector.split(",")]
    for node in root.walk():
        for *outer, last in filter(None, chains):
            if not _fits(node, last):
                continue
            up = node.parent
            while outer and up is not None:
                if _fits(up, outer[-1]):
                    outer.pop()
                up = up.parent
            if not outer:
                yield node
                break


def remove(root: Node, selector: str) -> None:
    for node in list(select(root, selector)):
        node.parent.inside = [x for x in node.parent.inside if x is not node]
