"""Attributes set in place: the named start tags of a page are rewritten, nothing else is read as a tree.

For pages as ``apply`` writes them, whose tags have one form (lower case, one blank
before each attribute, values in double quotes and escaped).
"""

from __future__ import annotations

import html as entities
import re

from lumendoc.functions.dom import IR_ID, RAW

_TAG = r"<(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?: [^\s\"=<>/]+=\"[^\"<>]*\")*)>"
#: What holds no tags is stepped over: comments, scripts and styles.
_ANY = re.compile(rf"<!--.*?-->|<({'|'.join(sorted(RAW))})(?=[ >])[^>]*>.*?</\1>|{_TAG}", re.S)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_ATTRIBUTE = re.compile(r" ([^\s\"=<>/]+)=\"([^\"]*)\"")


def starts(page: str, wanted: frozenset[str]) -> dict[str, re.Match]:
    """The start tags that bear these identifiers; of equal ones the last."""
    if not wanted:
        return {}
    out = {}
    for m in _ANY.finditer(page):
        attrs = m["attrs"]
        if attrs and IR_ID in attrs:
            ident = next((entities.unescape(v) for k, v in _ATTRIBUTE.findall(attrs) if k == IR_ID), None)
            if ident in wanted:
                out[ident] = m
    return out


def annotate(page: str, sets: list[tuple[str, str, str]]) -> str | None:
    """The page after (identifier, attribute, value) in order; None if one of the elements is not found, or elements stand before the doctype.

    One fold from left to right over the places of the named tags.
    """
    if "<" in _COMMENT.sub("", page[: max(page.find("<!DOCTYPE"), 0)]):
        return None
    found = starts(page, frozenset(i for i, _, _ in sets))
    new: dict[str, dict[str, str]] = {}
    for ident, name, value in sets:
        if ident not in found:
            return None
        own = new.setdefault(ident, dict(_ATTRIBUTE.findall(found[ident]["attrs"])))
        own[name.lower()] = entities.escape(value)
    out, at = [], 0
    for ident, m in sorted(found.items(), key=lambda x: x[1].start()):
        out += [page[at : m.start()], "<", m["tag"], *(f' {k}="{v}"' for k, v in new[ident].items()), ">"]
        at = m.end()
    return "".join(out) + page[at:]
