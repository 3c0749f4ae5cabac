"""Markdown into typed blocks with stable identifiers, and blocks into HTML.

A line is blank, a heading, an item, the start of a table, or a paragraph; if no
line is a level-1 heading, the first line that is not blank becomes one as it
stands.  Without tables a line's kind depends on itself, its neighbours and two
facts of the document, so segmentation is one expression inside the row: no
window and no shuffle.  A table swallows the lines up to its end, which is
sequential; only documents with a table line go through an Arrow function.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumendoc.functions import text as X
from lumendoc.functions.arrow import in_pieces

BLOCK = "array<struct<kind string, level int, text string>>"
BULLETS = ("- ", "* ", "• ")
_HEADING = re.compile(r"(#+)\s+(.+)", re.S)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _block(kind: Column, level: Column, text: Column) -> Column:
    return F.struct(kind.alias("kind"), level.cast("int").alias("level"), text.alias("text"))


def native_blocks(markdown: Column) -> Column:
    """Blocks of a document without tables."""

    def of_lines(lines: Column) -> Column:
        facts = F.struct(F.exists(lines, lambda x: X.heading_depth(x) == 1).alias("h1"), F.array_position(F.transform(lines, lambda x: x != ""), True).alias("first"))
        return _let(facts, lambda f: F.flatten(F.transform(lines, lambda x, i: of_line(lines, f, x, i))))

    def is_item(x: Column) -> Column:
        return F.startswith(x, F.lit(BULLETS[0])) | F.startswith(x, F.lit(BULLETS[1])) | F.startswith(x, F.lit(BULLETS[2]))

    def of_line(lines: Column, f: Column, x: Column, i: Column) -> Column:
        forced = lambda k: ~f["h1"] & (k + 1 == f["first"])
        item = X.strip(F.substring(x, 3, 1 << 30))
        goes_on = F.coalesce(is_item(F.get(lines, i - 1)) & ~forced(i - 1), F.lit(False))
        li = _block(F.lit("li"), F.lit(0), item)
        ul = F.when(goes_on, F.array(li)).otherwise(F.array(_block(F.lit("ul"), F.lit(0), item), li))
        depth = X.heading_depth(x)
        return (
            F.when(x == "", F.array().cast(BLOCK))
            .when(forced(i), F.array(_block(F.lit("h1"), F.lit(1), x)))
            .when(depth > 0, F.array(_block(F.concat(F.lit("h"), F.least(depth, F.lit(6)).cast("string")), F.least(depth, F.lit(6)), X.heading_text(x))))
            .when(is_item(x), ul)
            .otherwise(F.array(_block(F.lit("p"), F.lit(0), x)))
        )

    return _let(F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n"), X.strip), of_lines)


def segment_text(markdown: str | None) -> list[tuple[str, int, str]]:
    """The general rule for one document, tables included."""
    lines = (markdown or "").split("\n")
    heads = [_HEADING.fullmatch(x.strip()) for x in lines]
    title_due = not any(h and len(h[1]) == 1 for h in heads)
    out: list[tuple[str, int, str]] = []
    in_list, skip_to = False, 0
    for k, line in enumerate(lines):
        if k < skip_to:
            continue
        s = line.strip()
        was_list, in_list = in_list, False
        if not s:
            continue
        if title_due:
            title_due = False
            out.append(("h1", 1, s))
        elif heads[k]:
            depth = min(len(heads[k][1]), 6)
            out.append((f"h{depth}", depth, heads[k][2]))
        elif s.startswith("<table"):
            skip_to = next((j + 1 for j in range(k, len(lines)) if "</table>" in lines[j]), len(lines))
            out.append(("table", 0, "\n".join(lines[k:skip_to])))
        elif s.startswith(BULLETS):
            item = s[2:].strip()
            if not was_list:
                out.append(("ul", 0, item))
            out.append(("li", 0, item))
            in_list = True
        else:
            out.append(("p", 0, s))
    return out


def has_table(markdown: Column) -> Column:
    return F.coalesce(markdown.contains("<table") & markdown.rlike(rf"(?U)(?m)^{X.WS}*<table"), F.lit(False))


#: Documents whose blocks are held as Python objects at a time.
PIECE = 64
_BLOCK = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))


def _segmented(markdown: pa.Array) -> pa.Array:
    """Blocks of the documents with tables; the others are null."""
    of = lambda x: None if x is None else [dict(zip(("kind", "level", "text"), b)) for b in segment_text(x)]
    return in_pieces(markdown, lambda own: pa.array([of(x) for x in own.to_pylist()], _BLOCK), _BLOCK, PIECE)


def with_blocks(docs: DataFrame, text: str = "text", out: str = "blocks") -> DataFrame:
    """Append the array of blocks; null and empty texts have none.

    One pass, in which only the texts with tables go through Python and nothing is shuffled.
    """
    md = F.col(text)
    told = docs.withColumn("_tabled", F.when(has_table(md), md)).withColumn("_general", F.arrow_udf(_segmented, BLOCK)(F.col("_tabled")))
    return told.withColumn(out, F.when(F.col("_tabled").isNotNull(), F.col("_general")).otherwise(native_blocks(md).cast(BLOCK))).drop("_tabled", "_general")


def explode_blocks(blocked: DataFrame, *keys: str, blocks: str = "blocks") -> DataFrame:
    """One row a block: keys, pos, kind, level, text, ir_id."""
    rows = blocked.select(*keys, F.posexplode(blocks).alias("pos", "b"))
    b = lambda k: F.col(f"b.{k}")
    return rows.select(*keys, "pos", b("kind").alias("kind"), b("level").alias("level"), b("text").alias("text"), X.element_id(X.id_salt(b("kind"), b("text"))).alias("ir_id"))


def duplicate_ids(rows: DataFrame, *keys: str) -> DataFrame:
    """Identifiers that a document has more than once."""
    return rows.groupBy(*keys, "ir_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# The page around the blocks.
HEAD = (
    "<!DOCTYPE html>", '<html lang="en">', "<head>", '  <meta charset="UTF-8">',
    '  <meta name="viewport" content="width=device-width, initial-scale=1.0">',
)
STYLE = (
    "  <style>",
    "    body { font-family: -apple-system, BlinkMacSystemFont, 'Segoe UI', sans-serif; max-width: 800px; margin: 0 auto; padding: 20px; line-height: 1.6; color: #1a1a1a; }",
    "    .skip-link { position: absolute; top: -40px; left: 0; background: #000; color: #fff; padding: 8px; text-decoration: none; }",
    "    .skip-link:focus { top: 0; }",
    "    table { border-collapse: collapse; width: 100%; margin: 1em 0; }",
    "    th, td { border: 1px solid #767676; padding: 8px; text-align: left; }",
    "    th { background: #eee; }",
    "    img { max-width: 100%; height: auto; }",
    "    figure { margin: 1.5em 0; }",
    "  </style>",
)
MAIN = ("</head>", "<body>", '  <a href="#main-content" class="skip-link">Skip to main content</a>', '  <main id="main-content">')
TAIL = ("  </main>", "</body>", "</html>")
LONG_CAPTION = "Complex image — a full long description is required."


def render_blocks(blocks: Column) -> Column:
    """The lines of HTML of an array of blocks."""

    def line(all_: Column, b: Column, i: Column) -> Column:
        ident = X.element_id(X.id_salt(b["kind"], b["text"]))
        open_ = lambda tag: F.concat(F.lit("<"), tag, F.lit(' data-ir-id="'), ident, F.lit('">'))
        leaf = lambda pad: F.concat(F.lit(pad), open_(b["kind"]), X.escape(b["text"]), F.lit("</"), b["kind"], F.lit(">"))
        ends = F.coalesce(F.get(all_, i + 1)["kind"], F.lit("")) != "li"
        start = F.locate("<table", b["text"])
        table = F.concat(F.substring(b["text"], F.lit(1), start - 1), F.lit('<table data-ir-id="'), ident, F.lit('"'), F.substring(b["text"], start + 6, F.length(b["text"])))
        return (
            F.when(b["kind"] == "ul", F.concat(F.lit("    "), open_(F.lit("ul"))))
            .when(b["kind"] == "li", F.concat(leaf("      "), F.when(ends, "\n    </ul>").otherwise("")))
            .when(b["kind"] == "table", F.concat(F.lit("    "), F.replace(table, F.lit("\n"), F.lit("\n    "))))
            .otherwise(leaf("    "))
        )

    return _let(blocks, lambda all_: F.transform(all_, lambda b, i: line(all_, b, i)))


def render_figures(images: Column) -> Column:
    """Lines of figures; images: array of struct(filename, data, alt_text, requires_long_desc)."""

    def lines(m: Column) -> Column:
        ident = lambda p: X.element_id(F.concat(F.lit(p), m["filename"]))
        caption = F.concat(F.lit('\n      <figcaption data-ir-id="'), ident("cap:"), F.lit(f'">{LONG_CAPTION}</figcaption>'))
        return F.concat(
            F.lit('    <figure data-ir-id="'), ident("fig:"), F.lit('">\n      <img data-ir-id="'), ident("img:"), F.lit('" src="'), X.data_uri(m["filename"], m["data"]),
            F.lit('" alt="'), X.escape_attribute(X.alt_or_name(m["alt_text"], m["filename"])), F.lit('">'),
            F.when(F.coalesce(m["requires_long_desc"], F.lit(False)), caption).otherwise(""), F.lit("\n    </figure>"),
        )

    return F.transform(F.coalesce(images, F.array().cast("array<struct<filename string, data binary, alt_text string, requires_long_desc boolean>>")), lines)


def page(lines: Column, title: Column) -> Column:
    """The whole page; the title is escaped as text is."""
    lit = lambda xs: F.array(*map(F.lit, xs))
    return F.array_join(F.concat(lit(HEAD), F.array(F.concat(F.lit("  <title>"), X.escape(title), F.lit("</title>"))), lit(STYLE), lit(MAIN), lines, lit(TAIL)), "\n")


def build_html(docs: DataFrame, text: str = "text", title: Column | None = None, images: str | None = None) -> DataFrame:
    """Append ``html`` to documents of markdown."""
    blocked = with_blocks(docs.withColumn("_md", X.strip_front_matter(F.coalesce(F.col(text), F.lit("")))), "_md", "_blocks")
    lines = render_blocks(F.col("_blocks"))
    if images:
        lines = F.concat(lines, render_figures(F.col(images)))
    return blocked.withColumn("html", page(lines, title if title is not None else F.lit("Document"))).drop("_md", "_blocks")
