"""Text expressions: white space, escapes, identifiers, headings, front matter.

White space here is Unicode's plus the four ASCII separators U+001C to U+001F.
Everything is a built-in expression, so it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
#: The same characters; a trim by them looks at the ends only, where a pattern would try every place of the text.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A block of front matter names one of these.
META_KEYS = ("primary_language", "is_rotation_valid", "rotation_correction", "is_table", "is_diagram", "total-input-tokens", "Page dimensions")
#: Fixed value: identifiers are of page 1.
ID_PREFIX = "block-1-"
ID_CHARS = 200
CLIP_CHARS = 20_000
CONTEXT_CHARS = 150


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U){WS}+", " "))


def element_id(salt: Column) -> Column:
    """Identifier of a block: the hash of its first characters, squeezed after the cut."""
    return F.concat(F.lit(ID_PREFIX), F.substring(F.sha2(squeeze(F.substring(salt, 1, ID_CHARS)), 256), 1, 8))


def id_salt(kind: Column, text: Column) -> Column:
    """What a block's identifier is made from."""
    prefix = F.when(kind == "ul", "ul:").when(kind == "table", "table:").when(kind == "figure", "fig:").when(kind == "img", "img:").when(kind == "figcaption", "cap:").otherwise("")
    return F.concat(prefix, F.when(kind == "table", F.substring(text, 1, 60)).otherwise(text))


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(c: Column) -> Column:
    return F.replace(escape(c), F.lit('"'), F.lit("&quot;"))


HEADING = rf"(?Us)\A(#+){WS}+(.+)\z"


def heading_depth(line: Column) -> Column:
    """Number signs of a (stripped) heading line, 0 if it is none; the pattern reads only lines that begin with one."""
    return F.when(~F.startswith(line, F.lit("#")), F.lit(0)).otherwise(F.length(F.regexp_extract(line, HEADING, 1)))


def heading_text(line: Column) -> Column:
    return F.regexp_extract(line, HEADING, 2)


def strip_front_matter(markdown: Column) -> Column:
    """Pieces between dash lines, without blank ones and those that hold metadata."""
    pieces = F.when(~markdown.contains("---"), F.array(markdown)).otherwise(F.split(markdown, r"(?md)^---\s*$"))
    is_meta = lambda p: p.contains(":") & _any_of(p, META_KEYS)
    return F.array_join(F.filter(F.transform(pieces, strip), lambda p: ~is_meta(p) & (p != "")), "\n\n")


def _any_of(c: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in needles:
        out = out | c.contains(x)
    return out


def page_count(markdown: Column, mark: str = "\n---\n") -> Column:
    """One more than the page marks, which do not overlap."""
    return (1 + (F.length(markdown) - F.length(F.replace(markdown, F.lit(mark), F.lit("")))) / len(mark)).cast("long")


#: Alternative texts that tell of a figure to be described at length.
LONG_DESCRIPTION_WORDS = ("longer description", "detailed description", "diagram", "chart", "graph", "map", "table", "data visualization")


def needs_long_description(alt: Column) -> Column:
    return _any_of(F.lower(alt), LONG_DESCRIPTION_WORDS)


def alt_or_name(alt: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(alt, F.lit("")), name)


def data_uri(name: Column, data: Column) -> Column:
    kind = F.when(F.endswith(name, F.lit(".png")), "image/png").otherwise("image/jpeg")
    whole = F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))  # Spark may break its lines
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), whole)


def context(page_text: Column) -> Column:
    return F.substring(squeeze(page_text), 1, CONTEXT_CHARS)


def clip(html: Column) -> Column:
    return F.substring(html, 1, CLIP_CHARS)
