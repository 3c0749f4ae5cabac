"""Accessibility scores: a protocol, a small offline rule set, and what is computed from rules.

The rules are this library's own and claim no parity with any browser engine.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumendoc.functions.arrow import arrow_function
from lumendoc import model
from lumendoc.functions import dom
from lumendoc.functions import reviews as R

#: HTML in, struct of SCORED out.
Scorer = Callable[[Column], Column]


def rule_results(html: str | None) -> dict:
    """Every rule that has something to look at passes, or is violated by so many nodes."""
    top = dom.parse(html or "")
    nodes = list(top.walk())
    of = lambda *tags: [x for x in nodes if x.tag in tags]
    ids = [x.attrs["id"] for x in nodes if "id" in x.attrs]
    named = lambda x: x.attrs.get("aria-label") or x.attrs.get("aria-labelledby")
    refs = [(x, r) for x in nodes for k in ("aria-describedby", "aria-labelledby") if k in x.attrs for r in x.attrs[k].split()]
    looked = [  # id, impact, nodes looked at, of them the bad ones
        ("html-has-lang", "serious", of("html"), [x for x in of("html") if not x.attrs.get("lang")]),
        ("document-title", "serious", of("html"), [x for x in of("html") if not any("".join(t.texts()).strip() for t in of("title"))]),
        ("page-has-heading-one", "moderate", of("body"), [x for x in of("body") if not of("h1")]),
        ("image-alt", "critical", of("img"), [x for x in of("img") if not x.attrs.get("alt") and x.attrs.get("role") != "presentation"]),
        ("landmark-one-main", "moderate", of("body"), [x for x in of("body") if len(of("main")) != 1]),
        ("link-name", "serious", of("a"), [x for x in of("a") if not "".join(x.texts()).strip() and not named(x)]),
        ("list", "serious", of("ul", "ol"), [x for x in of("ul", "ol") if any(isinstance(c, dom.Node) and c.tag not in ("li", "script", "template") for c in x.children)]),
        ("listitem", "serious", of("li"), [x for x in of("li") if x.parent.tag not in ("ul", "ol", "menu")]),
        ("empty-heading", "minor", of("h1", "h2", "h3", "h4", "h5", "h6"), [x for x in of("h1", "h2", "h3", "h4", "h5", "h6") if not "".join(x.texts()).strip()]),
        ("duplicate-id", "minor", ids, sorted({i for i in ids if ids.count(i) > 1})),
        ("aria-valid-reference", "serious", refs, [r for _, r in refs if r not in ids]),
        ("table-name", None, [x for x in of("table") if named(x)], []),
        ("list-role", None, [x for x in of("ul", "ol") if x.attrs.get("role") == "list"], []),
        ("image-name", None, [x for x in of("img") if named(x)], []),
    ]
    rules = [{"id": i, "impact": impact, "nodes": len(bad)} for i, impact, _, bad in looked if bad]
    return {"rules": rules, "passes": sum(bool(seen) and not bad for _, _, seen, bad in looked)}


@arrow_function(model.SCORED)
def _rules(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rule_results(x) for x in html], columns=["rules", "passes"])


def offline_scorer(html: Column) -> Column:
    return _rules(html)


def summary(scored: Column, nothing: float = 100.0) -> Column:
    """struct(score, violations, passes, critical_serious) of a SCORED struct."""
    violations = F.size(scored["rules"])
    grave = F.size(F.filter(scored["rules"], lambda r: r["impact"].isin("critical", "serious")))
    return F.struct(R.score_percent(scored["passes"], violations, nothing).alias("score"), violations.alias("violations"), scored["passes"].alias("passes"), grave.alias("critical_serious"))


IMPACTS = ("critical", "serious", "moderate", "minor")


def severity(scored: Column) -> Column:
    """Violated rules by impact; other impacts are not counted."""

    def count(impact: str) -> Column:
        return F.size(F.filter(scored["rules"], lambda r: r["impact"] == impact)).alias(impact)

    return F.struct(*map(count, IMPACTS))


def severity_histogram(violations: DataFrame, *keys: str, impact: str = "impact") -> DataFrame:
    """The same over rows of violations, one aggregation."""
    return violations.groupBy(*keys).agg(*(F.count_if(F.col(impact) == i).alias(i) for i in IMPACTS))
