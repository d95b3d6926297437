"""The one helper outside built-in expressions: select nodes of HTML pages by CSS selectors.

A page is parsed once, in Arrow batches; what the selectors find comes back as nested columns and everything else
(cleaning, fallbacks, joins) is done by expressions. A page that can't be parsed gives a null struct.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_type

# Fixed values of HTML: tags without an end, and tags whose start ends an open paragraph.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS_ITSELF = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}}
P_WALLS = {"div", "td", "li", "section", "article", "body", "blockquote"}

NONE: frozenset[str] = frozenset()
TAGS: dict[str, tuple[str, list]] = {}  # start tags of a worker as they were read
MOST_TAGS, LONG_TAG = 10_000, 200
END_TAG = re.compile("</([a-zA-Z][a-zA-Z0-9]*)>")


class Node:
    """place: its number in document order; last: the number of the last node below it."""

    __slots__ = ("tag", "attrs", "parent", "parts", "classes", "place", "last")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, place: int):
        self.tag, self.attrs, self.parent, self.parts, self.place, self.last = tag, attrs, parent, [], place, place
        self.classes = frozenset(attrs["class"].split()) if "class" in attrs else NONE

    def text(self) -> str:
        """All inner strings, stripped, with a space between; scripts, styles and comments don't count."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if s := x.strip():
                    out.append(s)
            elif x is self or x.tag not in ("script", "style"):
                stack += reversed(x.parts)
        return " ".join(out)

    def above(self, test: Callable[[Node], bool]) -> Node | None:
        node = self.parent
        while node and not test(node):
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None, 0)
        self.nodes = [self.root]

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't needed

    def parse_starttag(self, i: int) -> int:
        """A start tag that was read before isn't taken apart again; one that opens raw text (a script) always is."""
        end = self.check_for_whole_start_tag(i)
        if end < 0:
            return end
        text = self.rawdata[i:end]
        if (known := TAGS.get(text)) is not None:
            self.handle_starttag(*known)
            return end
        self.read = None
        end = super().parse_starttag(i)
        if self.read and self.cdata_elem is None and len(text) <= LONG_TAG:
            if len(TAGS) >= MOST_TAGS:
                TAGS.clear()
            TAGS[text] = self.read
        return end

    def parse_endtag(self, i: int) -> int:
        if self.cdata_elem is None and (plain := END_TAG.match(self.rawdata, i)):
            self.handle_endtag(plain[1].lower())
            return plain.end()
        return super().parse_endtag(i)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.read = tag, attrs
        if tag in ENDS_P:
            self._close("p", P_WALLS)
        if tag in ENDS_ITSELF:
            self._close(tag, ENDS_ITSELF[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, len(self.nodes))
        self.nodes.append(node)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._close(tag, set())

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)

    def _close(self, tag: str, walls: set[str]) -> None:
        """Close the nearest open node with the tag, unless a wall stands before it."""
        node = self.at
        while node.parent:
            if node.tag == tag:
                self.at = node.parent
                return
            if node.tag in walls:
                return
            node = node.parent


def parse(html: str) -> list[Node]:
    """All nodes in document order, the root first."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    for node in reversed(builder.nodes[1:]):
        node.parent.last = max(node.parent.last, node.last)
    return builder.nodes


_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*)|\.([\w-]+)|\#([\w-]+)|\[([\w-]+)(?:(\*?)=['"]?([^'"\]]*)['"]?)?\]""")


def _compound(text: str) -> tuple[Callable[[Node], bool], str]:
    """(test of a node, what any such node has: its .class, #id or tag, or else *)."""
    tests, has = [], "*"
    for tag, cls, id_, attr, part, value in _SIMPLE.findall(text):
        if tag:
            tests.append(lambda n, x=tag.lower(): n.tag == x)
            has = tag.lower() if has == "*" else has
        elif cls:
            tests.append(lambda n, x=cls: x in n.classes)
            has = "." + cls
        elif id_:
            tests.append(lambda n, x=id_: n.attrs.get("id") == x)
            has = "#" + id_
        elif part:
            tests.append(lambda n, a=attr, v=value: v in n.attrs.get(a, ""))
        elif value:
            tests.append(lambda n, a=attr, v=value: n.attrs.get(a) == v)
        else:
            tests.append(lambda n, a=attr: a in n.attrs)
    if len(tests) == 2:
        first, second = tests
        return (lambda n: first(n) and second(n)), has
    return (tests[0] if len(tests) == 1 else lambda n: all(t(n) for t in tests)), has


class Selectors:
    """Named selectors: tag, .class, #id, [attr], [attr='v'], [attr*='v'], compounds, descendants and comma lists.

    They are filed by what a node must have for a match, so that a page is walked once for all of them.
    """

    def __init__(self, css: dict[str, str]):
        self.names, self.filed = list(css), {}
        for name, several in css.items():
            for one in several.split(","):
                chain = [_compound(c) for c in re.sub(r"\s*(\[[^\]]*\])", r"\1", one).split()]
                self.filed.setdefault(chain[-1][1], []).append((name, [test for test, _ in chain]))

    def __call__(self, html: str) -> Page:
        nodes, hits = parse(html), {name: [] for name in self.names}
        for node in nodes[1:]:
            keys = ["*", node.tag, *("." + c for c in node.classes)]
            if "id" in node.attrs:
                keys.append("#" + node.attrs["id"])
            for key in keys:
                for name, chain in self.filed.get(key, ()):
                    own = hits[name]
                    if not (own and own[-1] is node) and _chain(chain, node):
                        own.append(node)
        return Page(nodes[0], hits)


def _chain(chain: list, node: Node) -> bool:
    if not chain[-1](node):
        return False
    for test in reversed(chain[:-1]):
        if not (node := node.above(test)):
            return False
    return True


class Page:
    """What the selectors match in a page, in document order; the nodes below a node are a stretch of that order."""

    def __init__(self, root: Node, hits: dict[str, list[Node]]):
        self.root, self.hits = root, hits

    def all(self, name: str, below: Node | None = None) -> list[Node]:
        own = self.hits[name]
        if below is None:
            return own
        at = bisect_right(own, below.place, key=lambda n: n.place)
        return own[at : bisect_right(own, below.last, at, key=lambda n: n.place)]

    def first(self, name: str, below: Node | None = None) -> Node | None:
        return next(iter(self.all(name, below)), None)


def with_parsed(pages: DataFrame, selectors: Selectors, read: Callable[[Page], dict], schema: str, html: str = "html", error: str | None = None) -> DataFrame:
    """pages without its html, and `parsed`: what read() makes of each page; null for a null page and for one that fails
    in any way, so that one page can't end the job. error: the name of a text column that says what failed (null where
    nothing did), so that broken pages can be counted and aren't taken for empty ones."""
    kind = T.StructType.fromDDL(schema)
    names = [c for c in pages.columns if c not in (html, "parsed", error)]
    out = T.StructType([pages.schema[c] for c in names] + [T.StructField("parsed", kind)] + ([T.StructField(error, T.StringType())] if error else []))
    arrow = to_arrow_type(kind)

    def one(page: str | None) -> tuple[dict | None, str | None]:
        try:
            return (None if page is None else read(selectors(page))), None
        except Exception as failed:  # noqa: BLE001
            return None, f"{type(failed).__name__}: {failed}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                done = [one(p) for p in part.column(html).to_pylist()]
                columns = [*[part.column(c) for c in names], pa.array([d[0] for d in done], arrow), *([pa.array([d[1] for d in done], pa.string())] if error else [])]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "parsed", *([error] if error else [])])

    return pages.select(*names, html).mapInArrow(run, out)
