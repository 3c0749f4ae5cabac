"""Patches on HTML: all of a page's or none."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumendoc.functions.arrow import arrow_function
from lumendoc import model
from lumendoc.functions import dom, splice

DOCTYPE = "<!DOCTYPE html>"


class PatchError(ValueError):
    pass


def _set(el: dom.Node, p: dict) -> None:
    el.attrs[p["target_attribute"].lower()] = p["new_value"] or ""


def annotate(el: dom.Node, p: dict) -> str:
    _set(el, p)
    return f'set {p["target_attribute"]}="{p["new_value"]}"'


def replace(el: dom.Node, p: dict) -> str:
    """An attribute if one is named, else the text before the first child element."""
    if p.get("target_attribute"):
        _set(el, p)
        return f'now {p["target_attribute"]}="{p["new_value"]}"'
    lead = next((k for k, x in enumerate(el.children) if isinstance(x, dom.Node)), len(el.children))
    el.children[:lead] = [p["new_value"] or ""]
    return f'text now "{p["new_value"]}"'


def _parent(el: dom.Node, what: str) -> dom.Node:
    if el.parent is None or el.parent.parent is None:
        raise PatchError(f"the root element has no place to {what}")
    return el.parent


def wrap(el: dom.Node, p: dict) -> str:
    parent, at = _parent(el, "wrap"), el.place()
    outer = dom.Node(p["wrapper_tag"], dict(p.get("wrapper_attributes") or {}))
    parent.children[at] = outer
    outer.parent = parent
    outer.add(el)
    return f"wrapped in <{p['wrapper_tag']}>"


def insert(el: dom.Node, p: dict) -> str:
    parent, side = _parent(el, "insert beside"), p.get("position") or "after"
    if side not in ("before", "after"):
        raise PatchError(f"{side!r} is neither before nor after")
    new = next((x for x in dom.parse(p["new_element"] or "").children if isinstance(x, dom.Node)), None)
    if new is None:
        raise PatchError("nothing to insert")
    parent.add(new, el.place() + (side == "after"))
    return f"inserted {side}: {p['new_element']}"


OPERATIONS = {"annotate": annotate, "replace": replace, "wrap": wrap, "insert": insert}


def _entry(k: int, p: dict) -> dict:
    return {"index": k, "element_id": p["element_id"], "operation": p["operation"], "new_value": p["new_value"], "status": "applied", "detail": None, "error": None}


def splice_all(html: str, patches: list[dict]) -> dict | None:
    """``apply_all`` for a page that it has written itself and patches that only annotate, without a tree; None where that can't be told."""
    if any(p["operation"] != "annotate" or not p["target_attribute"] or p["element_id"] is None for p in patches):
        return None
    out = splice.annotate(html, [(p["element_id"], p["target_attribute"], p["new_value"] or "") for p in patches])
    log = [_entry(k, p) | {"detail": f'set {p["target_attribute"]}="{p["new_value"]}"'} for k, p in enumerate(patches)]
    return None if out is None else {"html": out, "ok": True, "error": None, "log": log}


def apply_all(html: str | None, patches, canonical: bool = False) -> dict:
    """Apply in order; the first failure leaves the page as it was.

    canonical: the page is a result of this function by patches that only
    annotate, so that it would be written as it stands.
    """
    html = html or ""
    if canonical:
        spliced = splice_all(html, list(patches if patches is not None else []))
        if spliced is not None:
            return spliced
    top, log = dom.parse(html), []
    by_id = dom.index(top)
    for k, p in enumerate(patches if patches is not None else []):
        p = dict(p)
        if not isinstance(p.get("wrapper_attributes"), dict):
            p["wrapper_attributes"] = dict(p.get("wrapper_attributes") if p.get("wrapper_attributes") is not None else ())
        entry = _entry(k, p)
        log.append(entry)
        try:
            el = by_id.get(p["element_id"])
            if el is None:
                raise PatchError(f"the page has no {p['element_id']!r}")
            if p["operation"] not in OPERATIONS:
                raise PatchError(f"{p['operation']!r} is not among the operations")
            entry["detail"] = OPERATIONS[p["operation"]](el, p)
            if p["operation"] == "insert":
                by_id = dom.index(top)
        except (PatchError, AttributeError, TypeError) as e:
            entry |= {"status": "failed", "error": str(e)}
            return {"html": html, "ok": False, "error": f"patch {k}: {e}; the page stays as it was", "log": log}
    at = html.lower().find("<!doctype")
    root = dom.root_of(top)
    out = (html[:at] if at >= 0 else "") + DOCTYPE + "\n" + (root.html() if root else "")
    return {"html": out, "ok": True, "error": None, "log": log}


@arrow_function(model.APPLIED)
def _apply(html: pd.Series, patches: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([apply_all(h, p) for h, p in zip(html, patches)], columns=["html", "ok", "error", "log"])


@arrow_function(model.APPLIED)
def _apply_known(html: pd.Series, patches: pd.Series, canonical: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([apply_all(h, p, bool(c)) for h, p, c in zip(html, patches, canonical)], columns=["html", "ok", "error", "log"])


def apply_patches(html: Column, patches: Column, canonical: Column | None = None) -> Column:
    """Struct of html, ok, error and log; ``patches``: array of PATCH; ``canonical``: whether a page stands as ``stays_canonical`` tells."""
    return _apply(html, patches) if canonical is None else _apply_known(html, patches, canonical)


def stays_canonical(patches: Column) -> Column:
    """Whether pages after these patches stand as they would be written again: no operation moved an element."""
    return F.forall(patches, lambda p: p["operation"] == "annotate")


def annotate_maps(attrs: Column, patches: Column) -> Column:
    """The attributes of one element after its ``annotate`` patches, without HTML: the last of a name wins."""
    sets = F.filter(F.coalesce(patches, F.array().cast(model.PATCHES)), lambda p: p["operation"] == "annotate")
    return F.aggregate(sets, attrs, lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["target_attribute"]), F.create_map(p["target_attribute"], p["new_value"])))
