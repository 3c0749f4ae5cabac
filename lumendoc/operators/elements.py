"""Identified elements of HTML: a table of them, their ids, and the last of equal ones."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumendoc.functions.arrow import in_pieces
from lumendoc.functions import measures, spans

ELEMENT = "array<struct<pos int, ir_id string, tag string, text string, alt string, empty boolean, attrs map<string,string>>>"


#: Pages whose elements are held as Python objects at a time.
PIECE = 16
_FIELDS = [("pos", pa.int32()), ("ir_id", pa.string()), ("tag", pa.string()), ("text", pa.string()), ("alt", pa.string()), ("empty", pa.bool_()), ("attrs", pa.map_(pa.string(), pa.string()))]
_ELEMENT = pa.list_(pa.struct(_FIELDS))


def _told(found: list[list[dict]]) -> pa.Array:
    return pa.array([[e | {"attrs": list(e["attrs"].items())} for e in page] for page in found], _ELEMENT)


def _all_elements(html: pa.Array) -> pa.Array:
    return in_pieces(html, lambda own: _told([spans.identified(x) for x in own.to_pylist()]), _ELEMENT, PIECE)


def _wanted_elements(html: pa.Array, wanted: pa.Array) -> pa.Array:
    both = pa.StructArray.from_arrays([html, wanted], ["html", "wanted"])
    return in_pieces(both, lambda own: _told([spans.identified(x["html"], frozenset(x["wanted"] or ())) for x in own.to_pylist()]), _ELEMENT, PIECE)


def element_array(html: Column, wanted: Column | None = None) -> Column:
    """Identified elements of a page in order; ``wanted``: an array of the identifiers that are asked for, so that no others leave the scan."""
    return F.arrow_udf(_all_elements, ELEMENT)(html) if wanted is None else F.arrow_udf(_wanted_elements, ELEMENT)(html, wanted)


def measure(html: Column) -> Column:
    """Visible words, images, heading levels and table shapes of a page."""
    return measures.measure(html)


def element_table(pages: DataFrame, *keys: str, html: str = "html", wanted: Column | None = None) -> DataFrame:
    """One row an element: keys, pos, ir_id, tag, text, alt, empty, attrs; with ``wanted`` only the elements that a row's array names."""
    return pages.select(*keys, F.explode(element_array(F.col(html), wanted)).alias("e")).select(*keys, "e.*")


def last_of_each(elements: DataFrame, *keys: str) -> DataFrame:
    """Of elements with one id, the last in the document."""
    kept = F.max_by(F.struct("pos", "tag", "text", "alt", "empty", "attrs"), "pos").alias("e")
    return elements.groupBy(*keys, "ir_id").agg(kept).select(*keys, "ir_id", "e.*")


def valid_ids(html: Column) -> Column:
    """Distinct ids in double quotes, wherever they stand in the source."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('data-ir-id="([^"]+)"'), F.lit(1)))


def heading_levels(html: Column) -> Column:
    """Levels of the heading tags in order, by pattern."""
    return F.transform(F.regexp_extract_all(F.lower(html), F.lit(r"<h([1-6])[\s>]"), F.lit(1)), lambda x: x.cast("int"))


def tag_count(html: Column, tag: str) -> Column:
    return F.regexp_count(F.lower(html), F.lit(rf"<{tag}[\s>/]")).cast("long")


def word_count(html: Column) -> Column:
    """Visible words by pattern: scripts, styles and tags go, without a space in their place; entities stay."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    return F.regexp_count(F.regexp_replace(bare, r"(?s)<[^>]*>", ""), F.lit(r"\S+")).cast("long")


def heading_skips(levels: Column, most: int = 1) -> Column:
    """Steps down the outline by more than ``most`` levels: array of struct(from, to)."""
    steps = F.transform(levels, lambda x, i: F.struct(F.get(levels, i - 1).alias("from"), x.alias("to")))
    return F.filter(steps, lambda s: F.coalesce(s["to"] - s["from"] > most, F.lit(False)))
