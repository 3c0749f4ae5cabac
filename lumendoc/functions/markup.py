"""HTML as a fold over its tags, in native expressions: no tree and no Python.

``tokens`` cuts a page into start tags, end tags, text, comments and whole
scripts and styles.  ``measure`` is a push-down automaton over them: its stack
holds the open elements (with the closings that browsers imply), its counters
what the content gate compares.  Each page is read once.

A page that ends inside a tag or comment ends there; a ``<`` that begins none is
text.  Character references count as one visible character, but those that
stand for white space, and numbers that stand for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumendoc.functions import dom

_RAW = "|".join(sorted(dom.RAW))
#: Comments, scripts and styles with their content, declarations, tags (a quoted value may hold ">"), text.
TOKEN = (
    rf"(?is)<!--.*?(?:--!?>|\z)|<({_RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1(?=[\s/>])[^>]*>|\z)"
    r"|<[!?][^>]*(?:>|\z)|</?[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<"
)
#: White space as Python's str.split sees it.
_BLANKS = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WS = f"[{_BLANKS}]"
# Named references to white space, numbers of white space, and numbers that stand for no character.
_NAMED = "Tab;|NewLine;|nbsp;?|NonBreakingSpace;|ensp;|emsp;|emsp13;|emsp14;|numsp;|puncsp;|thinsp;|ThinSpace;|hairsp;|VeryThinSpace;|MediumSpace;|ThickSpace;"
_SPACES = (9, 10, 12, 13, 32, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_NOTHING = (*range(1, 9), 11, *range(14, 32), 127)


def _numbers(codes: tuple[int, ...]) -> str:
    return "|".join(x for c in codes for x in (f"0*{c}(?![0-9])", f"[xX]0*(?i:{c:x})(?![0-9a-fA-F])"))


SPACE_REFERENCE = rf"&(?:{_NAMED}|#(?:{_numbers(_SPACES)});?)"
NO_REFERENCE = rf"&#(?:{_numbers(_NOTHING)});?"


def tokens(html: Column) -> Column:
    """The page's pieces in order; together they are the page."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0))


def tag_name(token: Column) -> Column:
    """Lower-case name of a tag, null for anything else."""
    return F.nullif(F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1)), F.lit(""))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def visible(text: Column) -> Column:
    """Text with its references to white space as blanks, and those to nothing gone."""
    plain = F.regexp_replace(F.regexp_replace(text, NO_REFERENCE, ""), SPACE_REFERENCE, " ")
    return F.when(F.contains(text, F.lit("&")), plain).otherwise(text)


#: Words of text that comes in pieces: how many so far, and whether the last goes on.
_COUNT = "struct<n int, open boolean>"
_STATE = f"struct<stack array<string>, open_tables array<int>, body int, all {_COUNT}, inner {_COUNT}, images int, headings array<int>, tables array<struct<rows int, cells int>>>"
_FIELDS = ("stack", "open_tables", "body", "all", "inner", "images", "headings", "tables")
_CLOSES = {t: sorted(k for k, v in dom.CLOSED_BY.items() if t in v) for t in sorted(set().union(*dom.CLOSED_BY.values()))}


def _more_words(count: Column, piece: Column) -> Column:
    """Words go on across pieces: what is open joins a text that does not begin with a blank."""
    joins = count["open"] & piece["begins"]
    return F.struct((count["n"] + piece["n"] - joins.cast("int")).cast("int").alias("n"), piece["ends"].alias("open"))


def _opened(stack: Column, tag: Column) -> Column:
    """The stack before ``tag`` is put on it: what it closes by implication goes, up to the nearest wall."""
    closes = F.try_element_at(F.create_map(*(x for k, v in _CLOSES.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), tag)

    def cut(closed: Column) -> Column:
        walls = F.transform(stack, lambda x, i: F.when(x.isin(*sorted(dom.WALLS)), i + 1).otherwise(0))
        return _let(F.coalesce(F.array_max(walls), F.lit(0)), lambda wall: F.coalesce(
            F.array_min(F.filter(F.transform(stack, lambda x, i: F.when((i >= wall) & F.array_contains(closed, x), i)), lambda i: i.isNotNull())), F.size(stack)
        ))

    return F.when(closes.isNull(), stack).otherwise(_let(closes, lambda c: F.slice(stack, F.lit(1), cut(c))))


def _closed(stack: Column, tag: Column) -> Column:
    """The stack after an end tag: up to the last element of that name; without one it stays."""
    at = F.size(stack) - F.array_position(F.reverse(stack), tag)
    return F.when(F.array_contains(stack, tag), F.slice(stack, F.lit(1), at.cast("int"))).otherwise(stack)


def _step(s: Column, token: Column) -> Column:
    def state(**new: Column) -> Column:
        return F.struct(*(new.get(k, s[k]).alias(k) for k in _FIELDS))

    def still_open(stack: Column) -> Column:
        return F.slice(s["open_tables"], F.lit(1), F.size(F.filter(stack, lambda x: x == "table")))

    def in_body(stack: Column) -> Column:
        """Where the first body stands in the stack: 0 before it, -1 after it."""
        return F.when((s["body"] > 0) & (F.size(stack) < s["body"]), -1).otherwise(s["body"])

    def start(tag: Column) -> Column:
        return _let(F.struct(tag.alias("tag"), _opened(s["stack"], tag).alias("stack")), started)

    def started(x: Column) -> Column:
        tag, stack = x["tag"], x["stack"]
        open_ = still_open(stack)
        pushed = F.when(tag.isin(*sorted(dom.VOID)), stack).otherwise(F.concat(stack, F.array(tag)))
        body = F.when((tag == "body") & (s["body"] == 0), F.size(stack) + 1).otherwise(in_body(stack))
        row, cell = (tag == "tr").cast("int"), tag.isin("td", "th").cast("int")
        counted = F.transform(s["tables"], lambda t, i: F.when(F.array_contains(open_, i), F.struct((t["rows"] + row).alias("rows"), (t["cells"] + cell).alias("cells"))).otherwise(t))
        tables = F.when(row + cell > 0, counted).when(tag == "table", F.concat(s["tables"], F.array(F.struct(F.lit(0).alias("rows"), F.lit(0).alias("cells"))))).otherwise(s["tables"])
        level = F.when(tag.rlike(r"\Ah[1-6]\z"), F.substring(tag, 2, 1).cast("int"))
        return state(
            stack=pushed, open_tables=F.when(tag == "table", F.concat(open_, F.array(F.size(s["tables"])))).otherwise(open_), body=body.cast("int"),
            images=s["images"] + (tag == "img").cast("int"), headings=F.when(level.isNotNull(), F.concat(s["headings"], F.array(level))).otherwise(s["headings"]), tables=tables,
        )

    def end(stack: Column) -> Column:
        return _let(stack, lambda x: state(stack=x, open_tables=still_open(x), body=in_body(x).cast("int")))

    def shut(x: Column) -> Column:
        """After an element that ends itself: it leaves the stack again."""
        stack = F.slice(x["stack"], F.lit(1), F.size(x["stack"]) - 1)
        new = {"stack": stack, "body": F.when(x["body"] == F.size(x["stack"]), -1).otherwise(x["body"])}
        return F.struct(*(new.get(k, x[k]).alias(k) for k in _FIELDS))

    def text() -> Column:
        return state(all=_more_words(s["all"], token), inner=F.when(s["body"] > 0, _more_words(s["inner"], token)).otherwise(s["inner"]))

    tag = token["tag"]
    return (
        F.when(tag.isNull(), F.when(token["n"] < 0, s).otherwise(text()))
        .when(token["kind"] == 1, end(_closed(s["stack"], tag)))
        .when(token["kind"] == 2, _let(start(tag), shut))
        .otherwise(start(tag))
    )


def _piece(token: Column) -> Column:
    """A token for the fold: tag and kind (a start tag 0, an end tag 1, one that ends itself 2), or of text its words
    (n; -1 for what is not seen) and whether it begins and ends with one."""
    none = [F.lit(None).cast("string").alias("tag"), F.lit(0).alias("kind")]

    def of_text(x: Column) -> Column:
        n = F.when(x == "", -1).otherwise(F.regexp_count(x, F.lit(f"[^{_BLANKS}]+"))).cast("int")
        return F.struct(*none, n.alias("n"), (~x.rlike(rf"\A{WS}")).alias("begins"), (~x.rlike(rf"{WS}\z")).alias("ends"))

    unseen = F.struct(*none, F.lit(-1).alias("n"), F.lit(False).alias("begins"), F.lit(False).alias("ends"))

    def of_tag(tag: Column) -> Column:
        kind = F.when(second == "/", 1).when(F.endswith(token, F.lit("/>")) & ~tag.isin(*sorted(dom.VOID)), 2).otherwise(0)
        return F.when(tag.isin(*sorted(dom.RAW)) & (second != "/"), unseen).otherwise(F.struct(tag.alias("tag"), kind.alias("kind"), F.lit(-1).alias("n"), F.lit(False).alias("begins"), F.lit(False).alias("ends")))

    second = F.substring(token, 2, 1)
    return F.when(~F.startswith(token, F.lit("<")) | (token == "<"), _let(visible(token), of_text)).when(second.isin("!", "?"), unseen).otherwise(_let(tag_name(token), of_tag))


def measure(html: Column) -> Column:
    """Visible words (of the body, if there is one), images, heading levels, rows and cells of every table with all that it holds."""
    none = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"))
    zero = F.struct(
        F.array().cast("array<string>").alias("stack"), F.array().cast("array<int>").alias("open_tables"), F.lit(0).alias("body"), none.alias("all"), none.alias("inner"),
        F.lit(0).alias("images"), F.array().cast("array<int>").alias("headings"), F.array().cast("array<struct<rows int, cells int>>").alias("tables"),
    )
    done = lambda s: F.struct(F.when(s["body"] != 0, s["inner"]["n"]).otherwise(s["all"]["n"]).alias("words"), s["images"].alias("images"), s["headings"].alias("headings"), s["tables"].alias("tables"))
    return F.aggregate(F.transform(tokens(html), _piece), zero.cast(_STATE), _step, done)
