"""A small HTML tree on the standard library's tokenizer, for use inside Arrow functions."""

from __future__ import annotations

import html as entities
from collections.abc import Iterator
from html.parser import HTMLParser

IR_ID = "data-ir-id"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
#: Opening one of the values closes an open element of the key.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot", "thead")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot", "thead")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot", "thead")),
    "option": frozenset(("option", "optgroup")),
    "head": frozenset(("body",)),
}
#: An implied close does not reach beyond one of these.
WALLS = frozenset(("table", "ul", "ol", "dl", "select", "body", "html"))


class Node:
    """An element; ``children`` holds nodes, text (str) and comments (Comment)."""

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def add(self, child: Node | str, at: int | None = None) -> None:
        self.children.insert(len(self.children) if at is None else at, child)
        if isinstance(child, Node):
            child.parent = self

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [x for x in reversed(node.children) if isinstance(x, Node)]

    def texts(self, skip: frozenset[str] = frozenset()) -> Iterator[str]:
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                if x is self or x.tag not in skip:
                    stack += reversed(x.children)
            elif not isinstance(x, Comment):
                yield x

    def place(self) -> int:
        return next(k for k, x in enumerate(self.parent.children) if x is self)

    def html(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, Close):
                out.append(x)
            elif isinstance(x, Comment):
                out.append(f"<!--{x}-->")
            elif isinstance(x, str):
                out.append(x if isinstance(x, RawText) else entities.escape(x, quote=False))
            else:
                attrs = "".join(f' {k}="{entities.escape(v)}"' for k, v in x.attrs.items())
                out.append(f"<{x.tag}{attrs}>")
                if x.tag not in VOID:
                    stack.append(Close(f"</{x.tag}>"))
                    stack += reversed(x.children)
        return "".join(out)


class Comment(str):
    pass


class RawText(str):
    pass


class Close(str):
    pass


class _Builder(HTMLParser):
    def __init__(self, implied: bool):
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("#document")
        self.implied = implied

    def handle_starttag(self, tag, attrs):
        if self.implied:
            x = self.at
            while x.parent is not None and x.tag not in WALLS:
                if tag in CLOSED_BY.get(x.tag, ()):
                    self.at = x.parent
                    x = self.at
                else:
                    x = x.parent
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.at.add(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        x = self.at
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.add(RawText(data) if self.at.tag in RAW else data)

    def handle_comment(self, data):
        self.at.add(Comment(data))


def parse(html: str, implied: bool = True) -> Node:
    """The document's tree; ``implied``: open paragraphs, items and cells are closed as browsers do."""
    builder = _Builder(implied)
    builder.feed(html or "")
    builder.close()
    return builder.top


def root_of(top: Node) -> Node | None:
    """The outermost element."""
    return next((x for x in top.children if isinstance(x, Node) and x.tag == "html"), next((x for x in top.children if isinstance(x, Node)), None))


def index(top: Node) -> dict[str, Node]:
    """Elements by identifier; of equal ones the last."""
    return {x.attrs[IR_ID]: x for x in top.walk() if IR_ID in x.attrs}


def elements(html: str) -> list[dict]:
    """Every identified element, in document order."""
    out = []
    for x in parse(html, implied=False).walk():
        if IR_ID in x.attrs:
            text = "".join(t.strip() for t in x.texts(RAW if x.tag not in RAW else frozenset()))
            alt = x.attrs.get("alt", "")
            out.append({"pos": len(out), "ir_id": x.attrs[IR_ID], "tag": x.tag, "text": text, "alt": alt, "empty": not text and not alt, "attrs": x.attrs})
    return out


def measure(html: str) -> dict:
    """What the content gate compares: visible words, images, heading levels, table shapes."""
    top = parse(html)
    nodes = list(top.walk())
    body = next((x for x in nodes if x.tag == "body"), top)
    tables = [x for x in nodes if x.tag == "table"]
    inner = lambda t, tags: sum(x.tag in tags for x in t.walk() if x is not t)
    return {
        "words": len("".join(body.texts(RAW)).split()),
        "images": sum(x.tag == "img" for x in nodes),
        "headings": [int(x.tag[1]) for x in nodes if len(x.tag) == 2 and x.tag[0] == "h" and x.tag[1] in "123456"],
        "tables": [{"rows": inner(t, ("tr",)), "cells": inner(t, ("td", "th"))} for t in tables],
    }
