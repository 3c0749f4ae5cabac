"""A structural index of pages: every element as an interval, instead of a tree.

``element_spans`` gives a row an element: ``pre`` and ``post`` number the openings and
closings of a page together, so ``b`` lies inside ``a`` exactly if ``a.pre < b.pre
and b.post < a.post``, and ``b`` stands wholly before ``a`` if ``b.post < a.pre``.
Siblings share ``parent`` (the ``pre`` of the element around them).  ``start`` and
``inner`` are the places in the source where the start tag begins and ends, ``close``
and ``stop`` those of the end tag; ``text_start`` and ``text_stop`` the element's part of
the page's visible text.  Descendants, siblings, nested tables and labels are then
conditions on ranges.

A page is scanned once, without a tree.  Joins between elements of one page run
over arrays inside the row, so no page is shuffled.

Cases: a null or empty page has no elements; an element without an end tag ends
where an outer one ends, or with the page; elements that are closed by
implication end where the closing tag begins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumendoc.functions.arrow import in_pieces
from lumendoc.functions import spans
from lumendoc.functions import text as X

SPAN = "pre int, post int, depth int, parent int, tag string, ir_id string, start int, inner int, close int, stop int, text_start int, text_stop int"


#: Pages whose elements are held as Python objects at a time.
PIECE = 16
_SPANS = pa.list_(pa.struct([(n, pa.string() if t == "string" else pa.int32()) for n, t in (f.split() for f in SPAN.split(", "))]))
_SCANNED = pa.struct([("text", pa.string()), ("elements", _SPANS)])


def scanned(html: Column, tags: tuple[str, ...] | None = None) -> Column:
    """The page's visible text, and its elements in order; ``tags``: those that are asked for, so that no others leave the scan, nor does the text."""

    def of(own: pa.Array) -> pa.Array:
        found = [spans.scan(x) for x in own.to_pylist()]
        if tags is not None:
            found = [{"text": None, "elements": [e for e in x["elements"] if e["tag"] in tags]} for x in found]
        return pa.array(found, _SCANNED)

    def scan(html: pa.Array) -> pa.Array:
        return in_pieces(html, of, _SCANNED, PIECE)

    return F.arrow_udf(scan, f"struct<text string, elements array<struct<{SPAN}>>>")(html)


def element_spans(pages: DataFrame, *keys: str, html: str = "html") -> DataFrame:
    """One row an element: keys and SPAN."""
    return pages.select(*keys, F.explode(scanned(F.col(html))["elements"]).alias("e")).select(*keys, "e.*")


def inside(outer: Column, inner: Column) -> Column:
    return (inner["pre"] > outer["pre"]) & (inner["post"] < outer["post"])


def table_shapes(pages: DataFrame, *keys: str, html: str = "html") -> DataFrame:
    """A row a table: its place among the page's tables, the tables around it, rows and cells with those of nested tables, and its own alone.

    A row or cell is a table's own if no other table stands between them.
    """
    some = scanned(F.col(html), ("table", "tr", "td", "th"))["elements"]
    at = pages.select(*keys, some.alias("e")).withColumn("tables", F.filter("e", lambda e: e["tag"] == "table"))
    at = at.where(F.size("tables") > 0).select(*keys, F.filter("e", lambda e: e["tag"] != "table").alias("parts"), "tables", F.posexplode("tables").alias("nth", "t"))
    t = F.col("t")
    held = F.filter("parts", lambda e: inside(t, e))
    nested = F.filter("tables", lambda x: inside(t, x))
    own = F.filter(held, lambda e: ~F.exists(nested, lambda x: inside(x, e)))
    rows = lambda a: F.size(F.filter(a, lambda e: e["tag"] == "tr"))
    return at.select(
        *keys, "nth", F.size(F.filter("tables", lambda x: inside(x, t))).alias("around"), F.size(nested).alias("nested"),
        rows(held).alias("rows"), (F.size(held) - rows(held)).alias("cells"), rows(own).alias("own_rows"), (F.size(own) - rows(own)).alias("own_cells"),
    )


def previous_siblings(pages: DataFrame, *keys: str, tags: tuple[str, ...] = ("table",), html: str = "html") -> DataFrame:
    """Of every element with one of these tags: pre and tag of the sibling just before it, and the text of the nearest one that has any."""
    at = pages.select(*keys, scanned(F.col(html)).alias("page")).select(*keys, "page.*")
    at = at.select(*keys, "text", "elements", F.explode(F.filter("elements", lambda x: x["tag"].isin(*tags))).alias("t"))
    t = F.col("t")
    before = F.filter("elements", lambda x: (x["parent"] == t["parent"]) & (x["post"] < t["pre"]))
    text = lambda x: F.substring(F.col("text"), x["text_start"] + 1, x["text_stop"] - x["text_start"])
    told = F.filter(F.transform(before, text), lambda x: X.strip(x) != "")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    return at.select(*keys, t["pre"].alias("pre"), t["tag"].alias("tag"), last(before)["pre"].alias("before"), last(before)["tag"].alias("before_tag"), X.strip(last(told)).alias("label"))
