"""Small cases of the findings of round 3."""

import difflib
import random
import time

import duckdb
from pyspark.sql import functions as F

from lumendoc.functions import markup, measures
from lumendoc.functions import text as X
from lumendoc.operators import elements, providers, segment
from lumendoc.operators.reviews import FUZZY, similar
from lumendoc.plans import catalogue
from lumendoc.session import spread

from .test_structure import random_page


def test_capitals_of_more_letters_are_the_same_text():
    """in long texts the ratio leaves out frequent characters, and "ß" in capitals is two."""
    text = "ßa" * 150
    assert difflib.SequenceMatcher(None, text.lower(), text.upper().lower()).ratio() < FUZZY
    assert similar(text, text.upper()) and similar("ß", "SS") and not similar(text, "#" * len(text))


def test_siblings_of_texts_cut_within_a_reference(spark, tmp_path):
    """a title that is cut within "&amp;" ends as the SQL reads it."""
    html = '<html><body><div class="ad">x &amp</div><article><h1>a &amp; b &amp</h1><p>C &quo</p>&quot; &am</article><footer>z</footer></body></html>'
    spark.createDataFrame([(1, html)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLES["previous_siblings"])
    got = catalogue.QUERIES["previous_siblings"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_measures_equal_the_fold_and_the_tree(spark):
    """the gate's scan tells what the native fold tells, far faster."""
    rnd = random.Random(3)
    pages = [None, "", "plain", "<body>a</body>b", "<table/><table><tr><td>x", "<p", "<!-- open", "<script>never shut", *(random_page(rnd) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(pages)), "k long, html string")
    both = df.select("k", elements.measure(F.col("html")).alias("new"), markup.measure(F.col("html")).alias("old"))
    assert both.where(~F.col("new").eqNullSafe(F.col("old"))).count() == 0
    took = time.time()
    for _ in range(2000):
        measures.measured(pages[40])
    assert time.time() - took < 4


def test_few_rows_are_spread_over_the_cores(spark):
    """F1, F2, F9, F15: pages of a table with one file split are scored and patched by many tasks, also under adaptive plans."""
    pages = spread(spark.range(100).coalesce(1).select(F.col("id").alias("doc_id")), "doc_id")
    used = pages.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= spark.sparkContext.defaultParallelism


def test_segmentation_reads_its_input_once(spark):
    """F8, F14, F5: documents with and without tables go through one pass, and keep their order by keys."""
    docs = spark.createDataFrame([(1, "# a\n<table>\n</table>\nb"), (2, "x\n- y"), (3, None), (4, "")], "doc_id long, text string")
    out = segment.with_blocks(docs)
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: [b["kind"] for b in r["blocks"]] for r in out.collect()} == {1: ["h1", "table", "p"], 2: ["h1", "ul", "li"], 3: [], 4: []}


def test_reviews_are_made_inside_the_row(spark, tmp_path):
    """a page goes to its reviewers once, and what they say is neither shuffled nor joined back by doc_id, which may be null or repeat."""
    log = tmp_path / "calls"
    log.write_text("")

    def flags(html):
        with open(log, "a") as f:
            f.write("call\n")
        return '[{"id": "a"}, 7, {"id": "none"}, {"id": "b", "confidence": "0.25", "fix": "lang"}]' if html else "{}"

    page = '<p data-ir-id="a">x</p><p data-ir-id="b">y</p>'
    active = spark.createDataFrame([(1, page), (1, None), (None, page)], "doc_id long, html string")
    out = providers.reviewer_provider({"f": flags, "n": lambda h: "no JSON"}, backoff=0.0)(1, active)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    issues = [("f-0", "a", 0.75, ""), ("f-3", "b", 0.25, "lang")]
    got = [(r["doc_id"], [(i["issue_id"], i["element_id"], i["confidence"], i["suggested_fix"]) for i in r["reviews"]["f"]], r["failed"], r["health"]) for r in out.collect()]
    health = {"f": "success", "n": "failed"}
    assert sorted(got, key=str) == sorted([(1, issues, False, health), (1, [], False, health), (None, issues, False, health)], key=str)
    assert log.read_text().count("call") == 3


def test_pages_dealt_out_give_the_same_reviews(spark):
    """with ``partitions`` or several calls at once the answers stay with their pages and reviewers."""
    active = spark.createDataFrame([(k, f'<p data-ir-id="e{k}">x</p>') for k in range(20)], "doc_id long, html string")
    says = {n: (lambda n: lambda h: f'[{{"id": "{h[15:].partition(chr(34))[0]}", "issue": "{n}"}}]')(n) for n in ("z", "a", "m")} | {"down": lambda h: 1 / 0}
    runs = [providers.reviewer_provider(says, backoff=0.0, **how)(1, active) for how in ({}, {"at_once": 4}, {"partitions": 3})]
    told = [sorted(map(str, r.select("doc_id", "reviews", "failed", "health").collect())) for r in runs]
    assert told[0] == told[1] == told[2]
    first = runs[2].where("doc_id = 7").select("*", F.map_entries("reviews").alias("r")).first()
    assert [(x["key"], [(i["element_id"], i["issue"]) for i in x["value"]]) for x in first["r"]] == [(n, [("e7", n)]) for n in "zam"]
    assert not first["failed"] and first["health"] == {"z": "success", "a": "success", "m": "success", "down": "failed"}


def test_strip_looks_at_the_ends_only(spark):
    """white space is the same as by pattern, and a long run inside a text costs no more than its length."""
    rnd = random.Random(5)
    odd = [chr(c) for c in range(0x3001) if chr(c).isspace()] + list("\u200b\ufeff\u180eé€a-")
    texts = [None, "", " ", *odd, *("".join(rnd.choices(odd, k=8)) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    by_pattern = F.regexp_replace("t", rf"(?U)\A{X.WS}+|{X.WS}+\z", "")
    assert df.where(~X.strip(F.col("t")).eqNullSafe(by_pattern)).count() == 0
    assert {r["k"]: r["s"] for r in df.select("k", X.strip(F.col("t")).alias("s")).collect()} == {k: t and t.strip() for k, t in enumerate(texts)}
    long_ = spark.range(4).select(F.concat(F.lit("x"), F.repeat(F.lit(" "), 60_000), F.col("id").cast("string")).alias("t"))
    took = time.time()
    assert {r["n"] for r in long_.select(F.length(X.strip(F.col("t"))).alias("n")).collect()} == {60_002}
    assert time.time() - took < 3


def test_front_matter_without_needless_passes(spark):
    """texts without a dash line keep their result; pieces are stripped once."""
    texts = [None, "", "  a \n", "a --- b", "---\nprimary_language: de\n---\n\n x \n---\n\t\n--- \n y:\n", "---", "a\n---\r\nb"]
    got = [r["s"] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(X.strip_front_matter(F.col("t")).alias("s")).collect()]
    assert got == [None, "", "a", "a --- b", "x\n\ny:", "", "a\n\nb"]
