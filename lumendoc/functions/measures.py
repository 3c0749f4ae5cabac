"""What the content gate compares, by the fold of ``markup`` inside an Arrow function.

The same tokens, stack and counters as ``markup.measure``, which tells the same as a
native expression and takes some hundred times as long.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumendoc.functions import dom, markup

MEASURE = "struct<words int, images int, headings array<int>, tables array<struct<rows int, cells int>>>"
_MEASURE = pa.struct([
    ("words", pa.int32()), ("images", pa.int32()), ("headings", pa.list_(pa.int32())), ("tables", pa.list_(pa.struct([("rows", pa.int32()), ("cells", pa.int32())]))),
])
_REST = r"[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>"
_RAW = "|".join(sorted(dom.RAW))
#: ``markup.TOKEN`` with the parts that count as groups: text, an end tag's slash, a tag's name; what is not seen has none.
_TOKEN = re.compile(
    rf"(?is)([^<]+)|<!--.*?(?:--!?>|\Z)|<({_RAW})(?=[\s/>]){_REST}.*?(?:</\2(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)(?=([a-z][^\s/>]*))[a-z]{_REST}|(<)", re.ASCII
)
_HEADINGS = {f"h{k}": k for k in range(1, 7)}
_SPACE, _NO = re.compile(markup.SPACE_REFERENCE), re.compile(markup.NO_REFERENCE)
#: What an opening tag closes by implication.
_CLOSES = {t: frozenset(k for k, v in dom.CLOSED_BY.items() if t in v) for t in set().union(*dom.CLOSED_BY.values())}


def visible(text: str) -> str:
    """Text with its references to white space as blanks, and those to nothing gone."""
    return _SPACE.sub(" ", _NO.sub("", text))


def _opened(stack: list[str], tag: str) -> int:
    """How much of the stack stays below ``tag``: what it closes by implication goes, up to the nearest wall."""
    closed, out = _CLOSES[tag], len(stack)
    for k in range(len(stack) - 1, -1, -1):
        if stack[k] in dom.WALLS:
            break
        if stack[k] in closed:
            out = k
    return out


def measured(html: str) -> tuple[int, int, list[int], list[tuple[int, int]]]:
    """(words, images, headings, tables) of a page; see ``measure``."""
    stack: list[str] = []
    open_tables: list[int] = []  # places in ``tables`` of those in the stack
    seen: list[str] = []
    rows, cells, headings, images = [], [], [], 0
    begins, ends, body = None, None, 0  # the body's part of ``seen``, and where it stands in the stack

    def cut(n: int) -> None:
        nonlocal ends
        while len(stack) > n:
            if stack.pop() == "table":
                open_tables.pop()
        if body > n and ends is None:
            ends = len(seen)

    for m in _TOKEN.finditer(html):
        text, _, slash, tag, lone = m.groups()
        if text:
            seen.append(visible(text) if "&" in text else text)
            continue
        if tag is None:
            if lone:
                seen.append(lone)
            continue
        tag = tag.lower()
        if slash:
            if stack and stack[-1] == tag:
                cut(len(stack) - 1)
            elif tag in stack:
                cut(len(stack) - 1 - stack[::-1].index(tag))
            continue
        if tag in dom.RAW:
            continue
        if tag in _CLOSES and stack:
            cut(_opened(stack, tag))
        if tag == "body" and not body:
            body, begins = len(stack) + 1, len(seen)
        void = tag in dom.VOID
        if not void:
            stack.append(tag)
        if tag == "table":
            open_tables.append(len(rows))
            rows.append(0)
            cells.append(0)
        elif tag == "tr":
            for t in open_tables:
                rows[t] += 1
        elif tag == "td" or tag == "th":
            for t in open_tables:
                cells[t] += 1
        elif tag == "img":
            images += 1
        elif tag in _HEADINGS:
            headings.append(_HEADINGS[tag])
        if not void and html[m.end() - 2] == "/":
            cut(len(stack) - 1)
    return len("".join(seen if begins is None else seen[begins:ends]).split()), images, headings, list(zip(rows, cells))


def _measures(html: pa.Array) -> pa.Array:
    got = [measured(x.as_py() or "") for x in html]
    columns = list(zip(*got)) or [(), (), (), ()]
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MEASURE)], fields=list(_MEASURE))


def measure(html: Column) -> Column:
    """Visible words (of the body, if there is one), images, heading levels, rows and cells of every table with all that it holds."""
    return F.arrow_udf(_measures, MEASURE)(html)
