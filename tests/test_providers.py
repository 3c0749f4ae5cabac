import json

from pyspark.sql import functions as F

from lumendoc.operators import elements, loop, providers, segment
from lumendoc.sources import readers


def page(spark):
    return segment.build_html(spark.createDataFrame([(1, "# T\nwords"), (2, "# U\nmore")], "doc_id long, text string")).select("doc_id", "html")


def names_first(html):
    import re

    eid = re.search(r'data-ir-id="([^"]+)"', html)[1]
    return "```json\n" + json.dumps({"violations": [{"element_id": eid, "suggested_fix": 'lang="de"', "issue": "language"}, {"element_id": "made-up"}]}) + "\n```"


def fails(html):
    raise RuntimeError("secret-key")


def test_reviewers(spark):
    got = {r["doc_id"]: r for r in providers.reviewer_provider({"a": names_first, "b": fails, "c": lambda h: "[]"}, backoff=0.01, partitions=2)(1, page(spark)).collect()}
    assert list(got[1]["reviews"]) == ["a", "c"] and len(got[1]["reviews"]["a"]) == 1 and got[1]["reviews"]["c"] == [] and not got[1]["failed"]
    failed = providers.reviewer_provider({"b": fails}, backoff=0.01)(1, page(spark)).collect()
    assert all(r["failed"] and r["reviews"] is None for r in failed)
    runs, rounds = loop.run_loop(page(spark), providers.reviewer_provider({"a": names_first}, backoff=0.01))
    assert {r["stopped_reason"] for r in runs.collect()} == {"converged"} and rounds.where("round = 2 AND patches_applied = 0").count() == 2
    assert all('lang="de"' in r["final_html"] for r in runs.collect())


def test_retry_and_availability():
    calls = []

    def second(x):
        calls.append(x)
        if len(calls) < 2:
            raise ValueError
        return "ok"

    assert providers.called(second, 1, backoff=0.01) == "ok" and len(calls) == 2
    assert providers.called(fails, 1, retries=0) is None
    assert list(providers.available({"a": fails, "b": fails, "c": fails}, {"B": "x"}, {"a": "A", "b": "B"})) == ["b", "c"]


def test_judge_image_and_ocr_providers(spark):
    html = '<html lang="en"><head><title>t</title></head><body><main><h1 data-ir-id="h">T</h1><img data-ir-id="i" alt="x"></main></body></html>'
    base = spark.createDataFrame([(1, html)], "doc_id long, html string")

    def asks_alt(h):
        return json.dumps([{"id": "i", "criterion": "1.1.1", "fix": "write alt text", "issue": "poor"}])

    alt = providers.alt_judge(lambda issue, fix, now: 'Sure {"new_value": "A long description", "safe": true, "confidence": 0.5}')
    runs, _ = loop.run_loop(base, providers.reviewer_provider({"a": asks_alt}), alt_provider=alt)
    r = runs.first()
    assert r["stopped_reason"] == "converged" and 'alt="A long description"' in r["final_html"]
    images = spark.createDataFrame([(1, 1, "a.png", b"x", 1, "ctx"), (1, 2, "b.png", b"bad", 1, "ctx")], "doc_id long, n int, filename string, data binary, page int, context string")

    def describe(data, ctx):
        if data == b"bad":
            raise RuntimeError
        return f"a chart of {ctx}"

    got = readers.describe_images(images, providers.alt_text_provider(describe)).orderBy("n").collect()
    assert [(x["alt_text"], x["requires_long_desc"], x["confidence"]) for x in got] == [("a chart of ctx", True, 0.9), ("b.png", False, 0.0)]
    files = spark.createDataFrame([("/d/a.pdf", b"x")], "path string, content binary")
    assert readers.ocr_result(providers.ocr_provider(lambda c, n: f"# {n}")(files)).first()["markdown"] == "# a.pdf"
    assert elements.element_table(base, "doc_id").where(F.col("tag") == "img").count() == 1


def test_ledger_calls_nobody_twice(spark, tmp_path):
    """Calls are counted by the lines that they leave in a file; the second reviewer fails at first and is asked again."""
    log = tmp_path / "calls"
    log.write_text("")

    def noted(name, html):
        with open(log, "a") as f:
            f.write(f"{name}\n")
        return names_first(html)

    def first(html):
        return noted("first", html)

    def second(html):
        noted("second", html)
        if len(open(log).read().split()) < 7:
            raise RuntimeError("not yet")
        return "[]"

    ask = providers.reviewer_provider({"first": first, "second": second}, retries=1, backoff=0.0, at_once=3, partitions=1, ledger=f"{tmp_path}/ledger")
    run = lambda turn: {r["doc_id"]: (sorted(r["reviews"]), r["failed"]) for r in ask(turn, page(spark)).collect()}
    count = lambda: {n: open(log).read().split().count(n) for n in ("first", "second")}
    assert run(1) == {1: (["first"], False), 2: (["first"], False)} and count() == {"first": 2, "second": 4}
    assert run(1) == {1: (["first", "second"], False), 2: (["first", "second"], False)} and count() == {"first": 2, "second": 6}
    assert run(1) == {1: (["first", "second"], False), 2: (["first", "second"], False)} and count() == {"first": 2, "second": 6}
    assert run(2)[1] == (["first", "second"], False) and count() == {"first": 4, "second": 8}
    kept = providers.Stage(spark, f"{tmp_path}/ledger", None).results()
    assert kept.count() == 8 and {r["tries"] for r in kept.collect()} == {1}
