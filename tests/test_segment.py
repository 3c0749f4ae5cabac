import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumendoc.functions import text as X
from lumendoc.operators import segment

LINES = ["# Top", "## Two", "####### deep", "#no", "- a", "* b", "•  c ", "-", "", "   ", "plain", "<b>x & \"y\"</b>", "a b\tc", "x" * 250, "# Top  trailing ", "# a\rb", "## a\x85b", "# a\u2028b", "#\x1cc", "#\x1f\x1fd e", "- a\u2028b"]


def expected_id(salt):
    return "block-1-" + hashlib.sha256(" ".join(salt[:200].split()).encode()).hexdigest()[:8]


def rows_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = segment.with_blocks(df).orderBy("doc_id").collect()
    return [[(b["kind"], b["level"], b["text"]) for b in r["blocks"]] for r in got]


def test_known_ids(spark):
    salts = {"Introduction to Physics": "cd967709", "Course Syllabus": "a4bf20ea", "Course Objectives": "63483697", "img:syllabus_img_1.png": "844ada8f", "fig:syllabus_img_1.png": "f8b7cb32"}
    got = spark.createDataFrame([(k,) for k in salts], "s string").select("s", X.element_id(F.col("s")).alias("i")).collect()
    assert {r["s"]: r["i"] for r in got} == {k: f"block-1-{v}" for k, v in salts.items()}


def test_ids_cut_before_they_squeeze(spark):
    salts = ["a  b c\x1fd", "x " * 150, "x" * 199 + "  y", "x" * 200 + "one", "x" * 200 + "two", "", "  lead", "é" * 300]
    got = spark.createDataFrame([(k, s) for k, s in enumerate(salts)], "k int, s string").select("k", X.element_id(F.col("s")).alias("i")).collect()
    assert {r["k"]: r["i"] for r in got} == {k: expected_id(s) for k, s in enumerate(salts)}


def test_kinds(spark):
    texts = [
        None, "", "\n \n", "first\n# Title\nlast", "- item first\n- then\n\n- again", "<table>\n- x\n</table>", "# T\n<table>one</table>\nafter", "# T\n<table>\nopen\n- x",
        "# T\n- a\n* b\nmid\n• c", "# T\n## S\n#### Q\n####### deep", "# T\n  <table class='x'>\n\n# in\n</table> tail\nnext", "<table>\n# Top",
    ]
    got = rows_of(spark, texts)
    assert got[:3] == [[], [], []]
    assert got[3] == [("p", 0, "first"), ("h1", 1, "Title"), ("p", 0, "last")]
    assert [k for k, _, _ in got[4]] == ["h1", "ul", "li", "ul", "li"] and got[4][0][2] == "- item first"
    assert [k for k, _, _ in got[5]] == ["h1", "ul", "li", "p"]
    assert got[6] == [("h1", 1, "T"), ("table", 0, "<table>one</table>"), ("p", 0, "after")]
    assert got[7] == [("h1", 1, "T"), ("table", 0, "<table>\nopen\n- x")]
    assert [k for k, _, _ in got[8]] == ["h1", "ul", "li", "li", "p", "ul", "li"]
    assert [x for _, x, _ in got[9]] == [1, 2, 4, 6]
    assert got[11] == [("table", 0, "<table>\n# Top")]
    assert got[10] == [("h1", 1, "T"), ("table", 0, "  <table class='x'>\n\n# in\n</table> tail"), ("p", 0, "next")]


def test_native_is_the_general_rule(spark):
    import random

    rnd = random.Random(2)
    texts = ["\n".join(rnd.choice(LINES) for _ in range(rnd.randrange(12))) for _ in range(150)]
    assert rows_of(spark, texts) == [segment.segment_text(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*LINES, "<table>", "</table>", "<table>x</table>"]), max_size=12))
def test_every_line_is_in_one_block(lines):
    got = segment.segment_text("\n".join(lines))
    kinds = [k for k, _, _ in got]
    # a level-1 heading inside a table's lines counts as the title, though no block shows it
    assert not got or "h1" in kinds or any(k == "table" and any(segment._HEADING.fullmatch(x.strip()) for x in t.split("\n")) for k, _, t in got)
    assert all(kinds[k - 1] in ("ul", "li") for k, kind in enumerate(kinds) if kind == "li")
    assert all(kinds[k + 1] == "li" for k, kind in enumerate(kinds) if kind == "ul")


def test_front_matter(spark):
    cases = {
        "a\n---\nis_table: False\nx: y\n---\nb": "a\n\nb", "---\nis_table\n---": "is_table", "a\n---  \nb:c": "a\n\nb:c", "": "", " \n": "", "x --- y": "x --- y", "---\nPage dimensions: 1\n---\n\n": "",
    }
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", X.strip_front_matter(F.col("s")).alias("o")).collect()
    assert {r["s"]: r["o"] for r in got} == cases


def test_page(spark):
    df = spark.createDataFrame([(1, "A & B\n- x < y\n- z\n<table>\n<tr></tr>\n</table>")], "doc_id long, text string")
    html = segment.build_html(df, title=F.lit("T & t")).first()["html"]
    i = expected_id
    assert f'    <h1 data-ir-id="{i("A & B")}">A &amp; B</h1>\n    <ul data-ir-id="{i("ul:x < y")}">\n      <li data-ir-id="{i("x < y")}">x &lt; y</li>' in html
    assert f'</li>\n    </ul>\n    <table data-ir-id="{i("table:" + "<table>\n<tr></tr>\n</table>")}">\n    <tr></tr>\n    </table>\n  </main>' in html
    assert "<title>T &amp; t</title>" in html and html.startswith("<!DOCTYPE html>\n<html lang") and html.endswith("</body>\n</html>")


@pytest.mark.parametrize("text,depth", [("# a", 1), ("#######  b c", 7), ("#x", 0), ("# ", 0), ("a # b", 0), ("#\ta", 1)])
def test_headings(spark, text, depth):
    assert spark.createDataFrame([(text,)], "s string").select(X.heading_depth(F.col("s")).alias("d")).first()["d"] == depth


def test_duplicates_and_small_functions(spark):
    df = spark.createDataFrame([(1, "T\n----\n----\nx"), (2, "----")], "doc_id long, text string")
    dup = segment.duplicate_ids(segment.explode_blocks(segment.with_blocks(df), "doc_id"), "doc_id").collect()
    assert [(r["doc_id"], r["n"]) for r in dup] == [(1, 2)] and dup[0]["ir_id"] == expected_id("----")
    one = spark.range(1).select(
        X.page_count(F.lit("a\n---\nb\n---\nc")).alias("pages"), X.page_count(F.lit("\n---\n---\n")).alias("overlap"), X.needs_long_description(F.lit("A Flow DIAGRAM")).alias("long"),
        X.alt_or_name(F.lit(""), F.lit("f.png")).alias("alt"), X.data_uri(F.lit("a.PNG"), F.lit("x").cast("binary")).alias("uri"), X.context(F.lit(" a \n b ")).alias("ctx"),
        X.escape_attribute(F.lit('<&">')).alias("esc"), F.length(X.clip(F.repeat(F.lit("x"), 30000))).alias("clip"),
    ).first()
    assert (one["pages"], one["overlap"], one["long"], one["alt"], one["ctx"], one["esc"], one["clip"]) == (3, 2, True, "f.png", "a b", "&lt;&amp;&quot;&gt;", 20000)
    assert one["uri"] == "data:image/jpeg;base64,eA=="


def test_figures(spark):
    docs = spark.createDataFrame([(1, "T"), (2, "U")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 1, 0, 7, "png", b"a", " p  1 "), (1, 2, 0, 7, "png", b"b", "p2"), (1, 2, 1, 8, "jpg", b"c", "p2")], "doc_id long, page int, i int, xref int, ext string, data binary, page_text string")
    from lumendoc.sources import readers

    images = readers.number_images(found)
    assert [(r["filename"], r["page"], r["context"]) for r in images.orderBy("n").collect()] == [("syllabus_img_1.png", 1, "p 1"), ("syllabus_img_2.jpg", 2, "p2")]
    told = lambda df: df.withColumn("answer", F.when(F.col("n") == 1, F.struct(F.lit('A "map"').alias("alt_text"), F.lit(None).cast("boolean").alias("requires_long_desc"), F.lit(0.9).alias("confidence"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))))
    described = readers.describe_images(images, told)
    assert [(r["alt_text"], r["requires_long_desc"], r["confidence"]) for r in described.orderBy("n").collect()] == [('A "map"', True, 0.9), ("syllabus_img_2.jpg", False, 0.0)]
    pages = segment.build_html(readers.attach_images(docs, described), images="images").orderBy("doc_id").collect()
    assert 'alt="A &quot;map&quot;">\n      <figcaption' in pages[0]["html"] and f'<figure data-ir-id="{expected_id("fig:syllabus_img_2.jpg")}">' in pages[0]["html"]
    assert "<figure" not in pages[1]["html"]
