"""The fold over tags, the interval index, spliced attributes and the loop's deltas, against the tree."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from lumendoc import model
from lumendoc.functions import dom, lateral, markup, spans, splice
from lumendoc.operators import apply, elements, loop, segment, structure
from lumendoc.session import workdir

TAGS = "html head body title p div ul li ol table tr td th tbody thead h1 h2 h3 h6 img br a b span dl dt dd select option form nav section".split()
TEXTS = ("one two", " x ", "&amp;", "a&nbsp;b", "&nbsp;", "&#160;", "&#xa0;c", "é　f", "\n", "word", "&copy; x", "&#32;y", "a&ensp;", "&#8195;q", "5 < 6 ", "&#x1F;", "R&D")


def random_page(rnd, tags=TAGS, ids=False):
    out = []
    for _ in range(rnd.randrange(60)):
        r, t = rnd.random(), rnd.choice(tags)
        name = t.upper() if rnd.random() < 0.1 else t
        own = f' data-ir-id="{rnd.choice("abcdef")}"' if ids and rnd.random() < 0.5 else ""
        if r < 0.4:
            out.append(f"<{name}{own}{rnd.choice(['', ' class=x', ' title=\"a > b\"', ' x=\'<p>\' y'])}>")
        elif r < 0.65:
            out.append(f"</{name}{rnd.choice(['', ' '])}>")
        elif r < 0.7:
            out.append(f"<{t}{own}/>" if rnd.random() < 0.5 else f"<{t}{own} />")
        elif r < 0.8:
            out.append(rnd.choice(["<!-- a <p data-ir-id=\"a\"> b -->", "<script>if (a<b) { x('</p>') }</script>", "<STYLE a=b>p{}</STYLE>", "<!DOCTYPE html>"]))
        else:
            out.append(rnd.choice(TEXTS))
    return "".join(out)


@pytest.fixture(scope="module")
def odd_pages():
    rnd = random.Random(5)
    nested = "<body><table><tr><td>a<table><tr><td>b</td><th>c</th></tr></table></td></tr><tr><td>d</table>after"
    return [None, "", "plain text", "<p>a<b>b</b>c", nested, "<p", "<!-- open", "<script>never shut", *(random_page(rnd) for _ in range(500))]


def test_measure_equals_the_tree(spark, odd_pages):
    rows = [(k, p) for k, p in enumerate(odd_pages) if p not in ("<p", "<!-- open", "<script>never shut")]
    got = spark.createDataFrame(rows, "k long, html string").select("k", markup.measure(F.col("html")).alias("m"))
    assert {r["k"]: r["m"].asDict(True) for r in got.collect()} == {k: dom.measure(p or "") for k, p in rows}
    cut = spark.createDataFrame([("<p",), ("<!-- open",), ("<script>never shut",)], "html string").select(markup.measure(F.col("html")).alias("m")).collect()
    assert all(r["m"]["images"] == 0 and r["m"]["tables"] == [] for r in cut)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_tokens_are_the_page(spark, odd_pages):
    df = spark.createDataFrame([(p or "",) for p in odd_pages], "html string")
    assert df.where(F.array_join(markup.tokens(F.col("html")), "") != F.col("html")).count() == 0


def tree_rows(html):
    """(tag, id, number of descendants, depth, text) of the tree's elements in order."""
    out = []

    def walk(node, depth):
        for x in node.children:
            if isinstance(x, dom.Node):
                raw = x.tag in dom.RAW
                out.append((x.tag, x.attrs.get(dom.IR_ID), sum(1 for _ in x.walk()) - 1, depth, "" if raw else "".join(x.texts(dom.RAW))))
                walk(x, depth + 1)

    walk(dom.parse(html or ""), 0)
    return out


def test_intervals_equal_the_tree(odd_pages):
    rnd = random.Random(8)
    for html in odd_pages + [random_page(rnd, ids=True) for _ in range(300)]:
        page = spans.scan(html)
        rows = page["elements"]
        inside = lambda a, b: a["pre"] < b["pre"] and b["post"] < a["post"]
        got = [(e["tag"], e["ir_id"], sum(inside(e, x) for x in rows), e["depth"], "" if e["tag"] in dom.RAW else page["text"][e["text_start"] : e["text_stop"]]) for e in rows]
        assert got == tree_rows(html)
        assert sorted([e["pre"] for e in rows] + [e["post"] for e in rows]) == list(range(2 * len(rows)))
        for e in rows:
            assert e["start"] < e["inner"] <= e["close"] <= e["stop"] <= len(html) and html[e["start"] + 1 :].lower().startswith(e["tag"])
            around = [x["pre"] for x in rows if inside(x, e)]
            assert e["parent"] == max(around, default=-1)


def test_identified_elements_equal_the_tree(odd_pages):
    rnd = random.Random(3)
    for html in odd_pages + [random_page(rnd, ids=True) for _ in range(300)]:
        want = dom.elements(html or "")
        assert spans.identified(html) == want
        for some in (frozenset(), frozenset("a"), frozenset("cz")):
            assert spans.identified(html, some) == [e for e in want if e["ir_id"] in some]


def test_table_shapes_and_siblings(spark):
    html = "<div>Prices <b>of</b> all</div><p> </p><table><tr><td>a<table><tr><td>b</td><th>c</th></tr><tr></tr></table></td></tr><tr><td>d</table><table></table>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>"), (4, "<table><tr></table>")], "k long, html string")
    got = sorted(tuple(r) for r in structure.table_shapes(df, "k").collect())
    assert got == [(1, 0, 0, 1, 4, 4, 2, 2), (1, 1, 1, 0, 2, 2, 2, 2), (1, 2, 0, 0, 0, 0, 0, 0), (4, 0, 0, 0, 1, 0, 1, 0)]
    near = {(r["k"], r["pre"]): (r["before_tag"], r["label"]) for r in structure.previous_siblings(df, "k").collect()}
    assert sorted(near.values(), key=str) == sorted([("p", "Prices of all"), (None, None), ("table", "abcd"), (None, None)], key=str)
    assert structure.element_spans(df, "k").where("k = 1 AND tag = 'table'").count() == 3


def sets(rnd):
    return [{"element_id": rnd.choice("abcdefz" if rnd.random() < 0.1 else "abcdef"), "operation": "annotate", "target_attribute": rnd.choice(["role", "Aria-Label", "title", "class"]), "new_value": rnd.choice(['a"b', "<x>", "", "plain", "a&b", None])} for _ in range(rnd.randrange(4))]


def test_splicing_equals_the_tree():
    rnd, spliced = random.Random(12), 0
    for _ in range(5000):
        page = apply.apply_all(random_page(rnd, ids=True), [])["html"]
        if apply.apply_all(page, [])["html"] != page:  # ids in odd places: not a page that is written as it stands
            continue
        patches = sets(rnd)
        want, quick = apply.apply_all(page, patches), apply.splice_all(page, patches)
        assert apply.apply_all(page, patches, True) == want
        spliced += quick is not None and bool(patches)
        assert quick is None or quick == want
    assert spliced > 300
    assert splice.annotate("<p>", [("a", "b", "c")]) is None
    assert apply.splice_all("<p></p>", [{"element_id": "a", "operation": "wrap", "target_attribute": None, "new_value": ""}]) is None


def test_wanted_elements_only_are_shuffled(spark):
    html = "".join(f'<p data-ir-id="e{k}">t{k}</p>' for k in range(200))
    df = spark.createDataFrame([(k, html, ["e7", "e9", "none"] if k == 1 else [] if k == 2 else None) for k in range(3)], "doc_id long, html string, wanted array<string>")
    got = elements.element_table(df, "doc_id", wanted=F.col("wanted")).collect()
    assert [(r["doc_id"], r["ir_id"], r["pos"]) for r in got] == [(1, "e7", 7), (1, "e9", 9)]
    assert elements.element_table(df, "doc_id").count() == 600


def written(spark, name):
    top = workdir(spark).removeprefix("file://")
    return {p: sum(os.path.getsize(f) for f in glob.glob(f"{p}/*.parquet")) for p in glob.glob(f"{top}/{name}-*")}


def test_rounds_write_what_is_still_active(spark):
    n = 400
    rnd = random.Random(1)
    texts = [(k, "# T\n" + " ".join(str(rnd.random()) for _ in range(60))) for k in range(n)]
    pages = segment.build_html(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", "html").repartition(2)

    def provider(turn, active):
        issue = 'map("gpt", array(named_struct("issue_id", "i", "wcag_criterion", "1", "element_id", id, "issue", "x", "impact", "minor", "confidence", 0.5D, "suggested_fix", "Set aria-label=\\"{0}\\"", "fix_type", "deterministic", "hallucinated", false)))'
        at = active.withColumn("id", F.get(elements.valid_ids(F.col("html")), 0))
        told = F.expr(issue.replace("{0}", f"n{turn}")).cast(model.REVIEWS)
        return at.select("doc_id", F.when((F.col("doc_id") == 7) | F.lit(turn == 1), told).alias("reviews"), F.lit(False).alias("failed"))

    before = written(spark, "loop-round")
    runs, rounds = loop.run_loop(pages, provider)
    got = {r["doc_id"]: r["stopped_reason"] for r in runs.collect()}
    assert got == {k: "max_rounds_reached" if k == 7 else "no_more_reviews" for k in range(n)}
    sizes = sorted((v for p, v in written(spark, "loop-round").items() if p not in before), reverse=True)
    assert len(sizes) == 3 and sizes[2] < sizes[0] / 10
    assert rounds.count() == n + 2
    assert runs.where("doc_id = 7").first()["final_html"].count('aria-label="n3"') == 1
    assert {tuple(h["reviewer"] for h in r["reviewer_health"]) for r in runs.collect()} == {()}


def test_table_functions(spark):
    lateral.register(spark)
    docs = spark.createDataFrame([(1, "# T\n- a\n- b\n<table>\n</table>"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(tuple(r) for r in spark.sql("SELECT doc_id, pos, kind, level, b.text FROM {docs}, LATERAL blocks(text) b", docs=docs).collect())
    want = segment.explode_blocks(segment.with_blocks(docs), "doc_id").select("doc_id", "pos", "kind", "level", "text")
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) == 5
    html = segment.build_html(docs).select("doc_id", "html")
    seen = spark.sql("SELECT doc_id, e.* FROM {html}, LATERAL elements(html) e", html=html)
    assert sorted(map(str, seen.collect())) == sorted(map(str, elements.element_table(html, "doc_id").collect()))
    with pytest.raises(Exception, match="takes one text"):
        spark.sql("SELECT * FROM blocks(1)").collect()
