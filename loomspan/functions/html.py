"""HTML to Markdown on the standard parser: content root, noise removal, links made absolute, sections."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..frames import in_pieces
from .url import resolved

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NOISE_TAGS = frozenset("nav aside header footer script style template".split())
NOISE_CLASSES = frozenset("breadcrumb breadcrumbs sidebar side-bar toc table-of-contents search searchbox toolbar pagination page-header page-footer".split())
ROOTS = tuple("main article .content .doc .docs .entry .documentation #content".split())
_CLOSES_P = frozenset("p div ul ol table pre h1 h2 h3 h4 h5 h6 section article blockquote hr".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        """The node and those in it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack += reversed(c.children)
        return "".join(out)

    def matches(self, selector: str) -> bool:
        if selector[0] == ".":
            return selector[1:] in self.attrs.get("class", "").split()
        return self.attrs.get("id") == selector[1:] if selector[0] == "#" else self.tag == selector


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("document", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P and self.open[-1].tag == "p":
            self.open.pop()
        if tag == "li" and self.open[-1].tag == "li" or tag in ("td", "th") and self.open[-1].tag in ("td", "th"):
            self.open.pop()
        if tag == "tr" and self.open[-1].tag in ("td", "th"):
            self.open.pop()
            if self.open[-1].tag == "tr":
                self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def content_root(root: Node, selectors: tuple[str, ...] = ROOTS) -> tuple[Node, str]:
    """(node, selector) of the first selector that matches, else the document."""
    for s in selectors:
        for node in root.walk():
            if node.matches(s):
                return node, s
    return root, "document"


def _noise(node: Node) -> bool:
    a = node.attrs
    return (
        node.tag in NOISE_TAGS or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in ("navigation", "search")
        or bool(NOISE_CLASSES & set(a.get("class", "").split()))
    )


def clean(node: Node) -> None:
    stack = [node]
    while stack:
        at = stack.pop()
        at.children = [c for c in at.children if isinstance(c, str) or not _noise(c)]
        stack += [c for c in at.children if isinstance(c, Node)]


_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


def _inline(node: Node, base: str) -> str:
    """The node as one run of text; an element's text is finished when its end is reached."""
    done: list[list[str]] = [[]]
    stack: list[tuple[str, Node | str]] = [("in", c) for c in reversed(node.children)]
    while stack:
        what, c = stack.pop()
        if isinstance(c, str):
            done[-1].append(re.sub(r"\s+", " ", c))
        elif what == "in":
            if c.tag == "img":
                done[-1].append(f"![{c.attrs.get('alt', '')}]({resolved(c.attrs.get('src', ''), base)})")
            elif c.tag == "br":
                done[-1].append("  \n")
            else:
                marked = c.tag in _MARKS or c.tag == "a" and c.attrs.get("href") is not None
                if marked:
                    done.append([])
                    stack.append(("out", c))
                stack += [("in", x) for x in reversed(c.children)]
        else:
            inner = "".join(done.pop())
            mark, plain = _MARKS.get(c.tag), inner.strip()
            if mark:
                done[-1].append(f"{mark}{plain}{mark}" if plain else inner)
            else:
                done[-1].append(f"[{plain}]({resolved(c.attrs['href'], base)})")
    return "".join(done[0])


_BLOCK = frozenset("p div ul ol table pre h1 h2 h3 h4 h5 h6 section article main body html blockquote hr document li tr thead tbody dl dt dd figure".split())


@dataclass
class _Open:
    """An element whose blocks are being collected, and what becomes of them at its end."""

    children: Iterator[Node | str]
    depth: int
    end: Callable[[list[str]], list[str]]
    run: Node
    out: list[str]


def _blocks(node: Node, base: str, depth: int = 0) -> list[str]:
    """The blocks of a node.  Open elements are on a stack of our own, so pages may nest as deep as they like."""
    plain = lambda blocks: blocks
    enter = lambda n, d, end=plain: _Open(iter(n.children), d, end, Node("run", {}), [])
    stack = [enter(node, depth)]
    while True:
        top = stack[-1]
        c = next(top.children, None)
        if c is not None and (isinstance(c, str) or c.tag not in _BLOCK):
            top.run.children.append(c)
            continue
        if text := _inline(top.run, base).strip():
            top.out.append(text)
        top.run.children = []
        if c is None:
            stack.pop()
            blocks = top.end(top.out)
            if not stack:
                return blocks
            stack[-1].out += blocks
        elif re.fullmatch("h[1-6]", c.tag):
            title = _inline(c, base).strip()
            top.out += [f"{'#' * int(c.tag[1])} {title}"] if title else []
        elif c.tag == "pre":
            top.out.append(f"```\n{c.text().strip(chr(10))}\n```")
        elif c.tag in ("ul", "ol"):
            stack.append(_Open(iter(_items(c)), top.depth, lambda lines: ["\n".join(lines)], Node("run", {}), []))
        elif c.tag == _ITEM:
            mark, indent = c.attrs["mark"], "  " * top.depth
            stack.append(enter(c, top.depth, lambda blocks, mark=mark, indent=indent: [indent + f"{mark} {' '.join(blocks)}".rstrip()]))
        elif c.tag == _NESTED:
            stack.append(_Open(iter(_items(c.children[0])), top.depth + 1, plain, Node("run", {}), []))
        elif c.tag == "table":
            top.out += _table(c, base)
        elif c.tag == "hr":
            top.out.append("---")
        elif c.tag == "blockquote":
            stack.append(enter(c, top.depth, lambda blocks: ["\n".join("> " + line for line in "\n\n".join(blocks).split("\n"))]))
        else:
            stack.append(enter(c, top.depth))


_ITEM, _NESTED = ":item", ":nested"
_BLOCK |= {_ITEM, _NESTED}


def _items(node: Node) -> list[Node]:
    """A list's items with their marks, each followed by the lists in it, which stand one level deeper."""
    out = []
    for n, item in enumerate((c for c in node.children if isinstance(c, Node) and c.tag == "li"), 1):
        nested = [c for c in item.children if isinstance(c, Node) and c.tag in ("ul", "ol")]
        head = Node(_ITEM, {"mark": f"{n}." if node.tag == "ol" else "*"})
        head.children = [c for c in item.children if isinstance(c, str) or c.tag not in ("ul", "ol")]
        out.append(head)
        for inner in nested:
            deeper = Node(_NESTED, {})
            deeper.children = [inner]  # its items are listed when it is reached
            out.append(deeper)
    return out


def _table(node: Node, base: str) -> list[str]:
    own, stack = [], list(reversed(node.children))
    while stack:  # rows of the table itself; a table in a cell is text of the cell
        c = stack.pop()
        if isinstance(c, Node) and c.tag == "tr":
            own.append(c)
        elif isinstance(c, Node) and c.tag != "table":
            stack += reversed(c.children)
    rows = [[_inline(c, base).strip().replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in own]
    rows = [r for r in rows if r]
    if not rows:
        return []
    lines = [f"| {' | '.join(r)} |" for r in rows]
    return ["\n".join([lines[0], f"| {' | '.join(['---'] * len(rows[0]))} |", *lines[1:]])]


def to_markdown(html: str, base: str = "", selectors: tuple[str, ...] = ROOTS) -> tuple[str, str]:
    """(markdown, matched selector)."""
    root, selector = content_root(parse(html), selectors)
    clean(root)
    text = re.sub("\n\n\n+", "\n\n", "\n\n".join(_blocks(root, base)))
    return text.strip(), selector


def sections(html: str, base: str = "", level: str = "h2", selectors: tuple[str, ...] = ROOTS) -> list[tuple[str, str]]:
    """(title, markdown) of the parts of the content that headings of a level open; the whole where there is none."""
    root, _ = content_root(parse(html), selectors)
    clean(root)
    heads = [n for n in root.walk() if n.tag == level]
    if not heads:
        title = next((n.text().strip() for n in root.walk() if n.tag in ("h1", "title")), "")
        return [(title, "\n\n".join(_blocks(root, base)).strip())]
    out = []
    for parent in root.walk():
        kids = parent.children
        for i, c in enumerate(kids):
            if isinstance(c, Node) and c.tag == level:
                part = Node("section", {})
                for k in kids[i + 1 :]:
                    if isinstance(k, Node) and k.tag == level:
                        break
                    part.children.append(k)
                out.append((c.text().strip(), "\n\n".join(_blocks(part, base)).strip()))
    return out


MARKDOWN = StructType([StructField("markdown", StringType()), StructField("selector", StringType())])
SECTIONS = ArrayType(StructType([StructField("title", StringType()), StructField("markdown", StringType())]))


def html_to_markdown(html: Column, base: Column) -> Column:
    @F.arrow_udf(MARKDOWN)
    def run(pages: pa.Array, bases: pa.Array) -> pa.Array:
        made = (dict(zip(MARKDOWN.names, to_markdown(p.as_py() or "", b.as_py() or ""), strict=True)) for p, b in zip(pages, bases, strict=True))
        return in_pieces(made, pa.struct([(n, pa.string()) for n in MARKDOWN.names]))

    return run(html, base)


def html_sections(html: Column, base: Column, level: str = "h2") -> Column:
    @F.pandas_udf(SECTIONS)
    def run(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([[{"title": t, "markdown": m} for t, m in sections(p or "", b or "", level)] for p, b in zip(pages, bases, strict=True)])

    return run(html, base)
