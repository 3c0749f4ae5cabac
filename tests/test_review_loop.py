import json

import pytest
from pyspark.sql import functions as F

from lumendoc import model
from lumendoc.functions import dom
from lumendoc.functions import reviews as R
from lumendoc.operators import apply, elements, gate, judge, loop, report, reviews, score, segment

BASE = "<html><body><h1>Top</h1><h2>Sub</h2><p>one two three four five six seven eight nine ten</p><table><tr><th>a</th></tr><tr><td>b</td></tr></table><img src='x' alt='y'></body></html>"


def issue(eid, text, fix, **more):
    return {"issue_id": "i", "wcag_criterion": "1.3.1", "element_id": eid, "issue": text, "impact": "serious", "confidence": 0.8, "suggested_fix": fix, "fix_type": "deterministic", "hallucinated": False} | more


def review_rows(spark, *maps, rounds=None):
    rows = [(k, json.dumps(m)) for k, m in enumerate(maps)]
    return spark.createDataFrame(rows, "doc_id long, j string").select("doc_id", F.from_json("j", model.REVIEWS).alias("reviews"))


@pytest.mark.parametrize(
    "fix,target,value",
    [('Set ALT = "a b"', "alt", "a b"), ('x role=""', "role", ""), ("needs a better alt", "alt", None), ("exalted", None, None), ("", None, None), (None, None, None), ('aria-labelledby="z" role="q"', "aria-labelledby", "z"), ('salt="x"', "alt", "x")],
)
def test_parse_fix(spark, fix, target, value):
    r = spark.createDataFrame([(fix,)], "f string").select(R.fix_target(F.col("f")).alias("t"), R.fix_value(F.col("f")).alias("v")).first()
    assert (r["t"], r["v"]) == (target, value)


def test_consensus(spark):
    # by target, though the words differ; by words where no attribute is named; null keys are equal
    m = {
        "olmo": [issue("t1", "The grid lacks a name", 'aria-label="A"'), issue("t2", "cells lack any clear header", "restructure the header"), issue(None, "n", 'lang="x"')],
        "gemini": [issue("t1", "Unnamed", 'Add aria-label="B"'), issue("t2", "cells lack a clear header now", "fix it"), issue(None, "m", 'lang="y"')],
        "gpt": [issue("t1", "zzz", 'role="table"'), issue("t2", "wholly unrelated 12345", "other")],
    }
    rows = reviews.explode_reviews(review_rows(spark, m, {"olmo": [issue("a", "x", "y")], "gpt": []}), "doc_id")
    got = {(r["doc_id"], r["element_id"], r["suggested_fix"]): r for r in reviews.consensus(rows, "doc_id").collect()}
    assert len(got) == 6
    first = got[0, "t1", 'aria-label="A"']
    assert (first["reviewers"], first["confidence"], first["issue"], first["reviewer_confidences"]) == (["gemini", "olmo"], 0.8, "The grid lacks a name", [0.8, 0.8])
    assert got[0, "t1", 'role="table"']["confidence"] == 0.6
    assert got[0, "t2", "restructure the header"]["reviewers"] == ["gemini", "olmo"] and got[0, "t2", "other"]["n_reviewers"] == 1
    assert got[0, None, 'lang="x"']["n_reviewers"] == 2
    assert got[1, "a", "y"]["n_reviewers_all"] == 2


def test_normalize(spark):
    good = {"violations": [{"element_id": "a", "confidence": "0.4"}, 7, {"elementId": "b", "confidence": 0, "requires_human_review": True}, {"id": "zz"}]}
    answers = [
        ("r1", f"```json\n{json.dumps(good)}\n```"), ("r2", json.dumps([{"id": "a", "criterion": 4, "description": "d", "fix": "f", "hallucinated": True}]) + " and more"), ("r3", "no json"), ("r4", json.dumps({"issues": []})),
    ]
    raw = spark.createDataFrame([(1, r, t, ["a", "b"]) for r, t in answers], "doc_id long, reviewer string, text string, valid_ids array<string>")
    issues, failed = reviews.normalize(raw, "doc_id")
    got = [(r["issue_id"], r["element_id"], r["confidence"], r["fix_type"], r["wcag_criterion"], r["issue"], r["suggested_fix"], r["hallucinated"]) for r in issues.orderBy("reviewer", "issue_pos").collect()]
    assert got == [("r1-0", "a", 0.4, "deterministic", "1.3.1", "", "", False), ("r1-2", "b", 0.75, "needs_human", "1.3.1", "", "", False), ("r2-0", "a", 0.75, "deterministic", "4", "d", "f", True)]
    assert [r["reviewer"] for r in failed.collect()] == ["r3"]
    h = reviews.health(raw, "doc_id").first()
    assert h["reviewer_status"]["r3"] == "failed" and not h["all_failed"]


CASES = [
    (None, 'role="list"', False, "hallucinated"), ("p", "alt text", False, "hallucinated"), ("p", 'aria-label="x"', True, "hallucinated"), ("table", 'aria-label="reading order"', False, "needs_human"),
    ("img", 'alt="x"', False, "llm_safe"), ("p", 'aria-labelledby="x"', False, "needs_human"), ("p", 'role="checkbox"', False, "needs_human"), ("p", 'ROLE="List"', False, "deterministic"),
    ("table", 'aria-label="x"', True, "deterministic"), ("p", 'lang=""', False, "needs_human"), ("p", "do better", False, "needs_human"),
]


def decided(spark, provider=None):
    g = spark.createDataFrame([(k, str(k), "1.3.1", "issue", c[1], ["gpt", "olmo"], 2, 3, 0.8, [0.8], [False], ["x"], k) for k, c in enumerate(CASES)], "doc_id long, element_id string, wcag_criterion string, issue string, suggested_fix string, reviewers array<string>, n_reviewers int, n_reviewers_all int, confidence double, reviewer_confidences array<double>, hallucinated_hints array<boolean>, fix_type_hints array<string>, first_pos int")
    e = spark.createDataFrame([(k, str(k), c[0], "", c[2], {"lang": "x"}) for k, c in enumerate(CASES) if c[0]], "doc_id long, ir_id string, tag string, alt string, empty boolean, attrs map<string,string>")
    return judge.decide(judge.classify(g, e, "doc_id"), provider)


def test_classify_and_audit(spark):
    d = decided(spark).cache()
    got = {r["doc_id"]: r for r in d.collect()}
    assert [got[k]["decision"] for k in range(len(CASES))] == [c[3] for c in CASES]
    assert got[4]["status"] == "DEFERRED_LLM" and got[7]["patch"]["new_value"] == "List" and got[7]["status"] == "ACCEPT"
    a = judge.audit(d, "doc_id")
    assert a.count() == len(CASES) and a.where("doc_id = 7").first()["dedup_status"] == "2/3 agree (confidence 0.8)"
    assert judge.rejected(d, "doc_id").count() == len(CASES) - 2
    m = {r["doc_id"]: r for r in judge.manifests(d, "doc_id").collect()}
    assert len(m[7]["patches"]) == 1 and m[4]["n_deferred"] == 1 and m[0]["n_rejected"] == 1


@pytest.mark.parametrize("safe,status,conf", [(True, "ACCEPT", 0.33), (False, "NEEDS_HUMAN", None), (None, "NEEDS_HUMAN", None)])
def test_alt_provider(spark, safe, status, conf):
    answer = F.struct(F.lit("a dog").alias("new_value"), F.lit(safe).alias("safe"), F.lit(0.333).alias("confidence"), F.lit("sure").alias("reasoning")) if safe is not None else F.lit(None).cast(model.MODEL_ANSWER)
    r = decided(spark, lambda df: df.withColumn("answer", answer.cast(model.MODEL_ANSWER))).where("doc_id = 4").first()
    assert r["status"] == status and (r["patch"]["confidence"] == conf and r["patch"]["llm_safe"] if conf else r["patch"] is None)


def test_elements(spark):
    html = '<p data-ir-id="a"></p><div data-ir-id="b"> x <b>y </b> z<img data-ir-id="i" alt="q"></div><p data-ir-id="a" role="r">last</p><!-- data-ir-id="c" -->'
    df = spark.createDataFrame([(1, html)], "doc_id long, html string")
    got = {r["ir_id"]: r for r in elements.last_of_each(elements.element_table(df, "doc_id"), "doc_id").collect()}
    assert got["a"]["text"] == "last" and got["a"]["attrs"]["role"] == "r" and got["b"]["text"] == "xyz" and got["i"]["alt"] == "q" and not got["i"]["empty"]
    assert df.select(elements.valid_ids(F.col("html")).alias("v")).first()["v"] == ["a", "b", "i", "c"]


GATES = [
    ("same", BASE, BASE, []), ("empty", BASE, "<html><body></body></html>", ["text_coverage", "image_count", "table_structure"]),
    ("text", BASE, BASE.replace("one two three four five six seven eight nine ten", "one"), ["text_coverage"]),
    ("table", BASE, BASE.replace("<table><tr><th>a</th></tr><tr><td>b</td></tr></table>", ""), ["table_structure"]),
    ("img", BASE, BASE.replace("<img src='x' alt='y'>", ""), ["image_count"]), ("skip", BASE, BASE.replace("h2>", "h3>"), ["heading_order"]),
    ("more", BASE, BASE.replace("<img", "<img><img"), []), ("attr", BASE, BASE.replace("<table", "<table aria-label='x'"), []),
    ("was empty", "<html><body></body></html>", BASE, []), ("deep first", "<h3>x</h3>", "<h3>x</h3>", []), ("none", "", "", []),
]


def test_gate(spark):
    df = spark.createDataFrame([(n, o, p) for n, o, p, _ in GATES], "case string, original string, patched string")
    got = {r["case"]: r for r in gate.run_gate(df).collect()}
    assert {n: got[n]["gate_failed"] for n, *_ in GATES} == {n: f for n, _, _, f in GATES}
    assert all(got[n]["gate_passed"] == (not f) for n, _, _, f in GATES)
    assert dom.measure(BASE) == {"words": 10, "images": 1, "headings": [1, 2], "tables": [{"rows": 2, "cells": 2}]}


def patch(eid, op, **kw):
    return dict.fromkeys(("target_attribute", "new_value", "wrapper_tag", "wrapper_attributes", "new_element", "position")) | {"element_id": eid, "operation": op} | kw


PAGE = '<!-- note --><!doctype html><html><body><h1 data-ir-id="h">T <b>x</b> tail</h1><img data-ir-id="i" alt="a">after</body></html>'


def test_patches():
    ok = apply.apply_all(PAGE, [patch("h", "annotate", target_attribute="role", new_value='a"b'), patch("h", "annotate", target_attribute="role", new_value="c"), patch("i", "replace", target_attribute="alt", new_value="<new>"), patch("h", "replace", new_value="N "), patch("h", "wrap", wrapper_tag="section", wrapper_attributes={"aria-label": "s"}), patch("i", "insert", new_element='<p data-ir-id="n">cap</p>', position="after"), patch("n", "annotate", target_attribute="lang", new_value="de")])
    assert ok["ok"] and [e["status"] for e in ok["log"]] == ["applied"] * 7
    assert ok["html"] == '<!-- note --><!DOCTYPE html>\n<html><body><section aria-label="s"><h1 data-ir-id="h" role="c">N <b>x</b> tail</h1></section><img data-ir-id="i" alt="&lt;new&gt;"><p data-ir-id="n" lang="de">cap</p>after</body></html>'
    good = patch("h", "annotate", target_attribute="role", new_value="x")
    for bad in (patch("zz", "annotate", target_attribute="a", new_value="b"), patch("h", "paint"), patch("i", "insert", new_element="<p></p>", position="inside")):
        out = apply.apply_all(PAGE, [good, bad])
        assert not out["ok"] and out["html"] == PAGE and [e["status"] for e in out["log"]] == ["applied", "failed"]
    rooted = PAGE.replace("<html>", '<html data-ir-id="r">')
    for op in (patch("r", "wrap", wrapper_tag="x"), patch("r", "insert", new_element="<p></p>")):
        assert "root" in apply.apply_all(rooted, [op])["error"]
    assert apply.apply_all(PAGE, [])["ok"]


def test_annotate_maps_is_the_patch(spark):
    p = json.dumps([{"element_id": "e", "operation": "annotate", "target_attribute": "role", "new_value": v} for v in ("a", "b")])
    r = spark.createDataFrame([({"role": "z", "id": "q"}, p)], "attrs map<string,string>, p string").select(apply.annotate_maps(F.col("attrs"), F.from_json("p", model.PATCHES)).alias("m")).first()
    assert r["m"] == {"role": "b", "id": "q"}


def pages(spark, *texts):
    return segment.build_html(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "html")


def test_loop_converges(spark):
    runs, rounds = loop.run_loop(pages(spark, "# T\nPrices\n<table>\n<tr><td>1</td></tr>\n</table>\n- a", "plain words"))
    got = {r["doc_id"]: r for r in runs.collect()}
    assert [(got[k]["stopped_reason"], got[k]["rounds_accepted"], got[k]["final"]["violations"]) for k in (0, 1)] == [("converged", 3, 0), ("converged", 1, 0)]
    assert 'aria-label="Prices"' in got[0]["final_html"] and 'role="list"' in got[0]["final_html"]
    assert sorted((r["doc_id"], r["round"], r["patches_applied"]) for r in rounds.collect()) == [(0, 1, 1), (0, 2, 1), (0, 3, 0), (1, 1, 0)]
    base = pages(spark, "# T\nPrices\n<table>\n<tr><td>1</td></tr>\n</table>\n- a", "plain words").withColumnRenamed("html", "baseline_html")
    added = report.page_enhancements(base.join(runs.select("doc_id", "final_html"), "doc_id"), "doc_id").cache()
    assert [(r["attribute"], r["value"]) for r in added.orderBy("doc_id", "pos", "key_pos").collect()] == [("role", "list"), ("aria-label", "Prices")] or {r["attribute"] for r in added.collect()} == {"role", "aria-label"}
    snaps = report.snapshots(runs, rounds, added)
    assert {(r["doc_id"], r["enhancements"], r["rounds"]) for r in report.snapshot_index(snaps).collect()} == {(0, 2, 3), (1, 0, 1)}
    s = report.round_summaries(rounds, "doc_id").where("doc_id = 0 AND round = 1").first()
    assert (s["accepted"], s["reviewers"]) == (1, ["gemini", "gpt", "olmo"])
    assert "| 0 | 0 / 9 | 1 → 10p | 1 → 11p | 0 → 11p | 11 | converged |" in [r["line"] for r in report.comparison(runs, rounds).collect()]


@pytest.mark.parametrize("case", ["no_more_reviews", "reviewers_failed", "applicator_rollback", "gate_failed", "axe_regression", "max_rounds_reached"])
def test_loop_stops(spark, case):
    html = pages(spark, "words here")
    ident = html.select(elements.valid_ids(F.col("html")).alias("v")).first()["v"][0]
    scorer, hook, applicator = score.offline_scorer, [], apply.apply_patches

    def provider(turn, active):
        m = {"gpt": [issue(ident, "x", f'lang="l{turn}"')]}
        out = active.select("doc_id", F.from_json(F.lit(json.dumps(m)), model.REVIEWS).alias("reviews"), F.lit(False).alias("failed"))
        if case == "no_more_reviews":
            out = out.withColumn("reviews", F.when(F.lit(turn == 1), F.col("reviews")))
        return out.withColumn("failed", F.lit(case == "reviewers_failed"))

    if case == "applicator_rollback":
        applicator = lambda h, p, c: F.struct(h.alias("html"), F.lit(False).alias("ok"), F.lit("e").alias("error"), F.array().cast("array<string>").alias("log"))
    if case == "gate_failed":
        applicator = lambda h, p, c: F.struct(F.lit("<p></p>").alias("html"), F.lit(True).alias("ok"), F.lit("").alias("error"), F.array().cast("array<string>").alias("log"))
    if case == "axe_regression":
        scorer = lambda h: F.when(h.contains('lang="l1"'), F.from_json(F.lit('{"rules":[{"id":"a","impact":"minor","nodes":1}],"passes":1}'), model.SCORED)).otherwise(F.from_json(F.lit('{"rules":[],"passes":1}'), model.SCORED))
    runs, rounds = loop.run_loop(html, provider, scorer=scorer, applicator=applicator, on_round=lambda t, df: hook.append(df.count()))
    r, status = runs.first(), [x["status"] for x in rounds.orderBy("round").collect()]
    want = {"no_more_reviews": (1, ["accepted", "no_more_reviews"]), "reviewers_failed": (0, ["reviewers_failed"]), "applicator_rollback": (0, ["applicator_rollback"]), "gate_failed": (0, ["gate_failed_reverted"]), "axe_regression": (0, ["axe_regression_reverted"]), "max_rounds_reached": (3, ["accepted"] * 3)}[case]
    assert (r["stopped_reason"], r["rounds_accepted"]) == (case, want[0])
    assert status == [s for s in want[1] if s != "no_more_reviews"]
    assert ('lang="l' in r["final_html"]) == (want[0] > 0) and sum(hook) == want[0]
    if case == "axe_regression":
        assert rounds.first()["regression"] == "0 -> 1 violations"


def test_loop_without_documents(spark):
    runs, rounds = loop.run_loop(spark.createDataFrame([], "doc_id long, html string"))
    assert runs.count() == 0 and rounds.count() == 0


def test_scores(spark):
    s = score.summary(score.offline_scorer(F.col("h")))
    got = spark.createDataFrame([("",), ("<html><body><img></body></html>",)], "h string").select(s.alias("s")).collect()
    assert got[0]["s"]["score"] == 100.0 and got[1]["s"]["critical_serious"] == 3
    sev = spark.createDataFrame([("<html><body><img></body></html>",)], "h string").select(score.severity(score.offline_scorer(F.col("h"))).alias("s")).first()["s"]
    assert (sev["critical"], sev["serious"], sev["moderate"]) == (1, 2, 2)


def test_comment(spark):
    scored = F.from_json(F.lit('{"rules":[{"id":"image-alt","impact":"critical","nodes":2}],"passes":9}'), model.SCORED)
    c = report.comment_block(score.summary(scored, 0.0), score.severity(scored), scored["rules"], F.lit(3), F.array(F.lit("b"), F.lit("a")), F.lit("now"))
    text = spark.range(1).select(c.alias("c")).first()["c"]
    assert text.startswith("<!--\n") and text.endswith("\n-->") and "image-alt [critical] x2" in text and "    a, b" in text and "90.0%" in text


def test_model_json(spark):
    texts = ['{"new_value": "a", "safe": true}', 'Sure: {"new_value": "b", "safe": false} ok', "none"]
    got = [r["j"] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(reviews.model_json(F.col("t")).alias("j")).collect()]
    assert got[0]["new_value"] == "a" and got[1]["new_value"] == "b" and got[2] is None


def test_gate_takes_other_checks(spark):
    df = spark.createDataFrame([(BASE, BASE.replace("<img src='x' alt='y'>", ""))], "original string, patched string")
    no_images = lambda o, p: F.struct(F.lit("no_images").alias("name"), (p["images"] == 0).alias("passed"), F.lit("").alias("detail"))
    r = gate.run_gate(df, checks=[gate.text_coverage, no_images]).first()
    assert r["gate_passed"] and [c["name"] for c in r["gate_checks"]] == ["text_coverage", "no_images"]
    assert [c["name"] for c in gate.run_gate(df).first()["gate_checks"]] == [c.__name__ for c in gate.CHECKS]


def test_comment_before_the_page(spark):
    df = spark.createDataFrame([("<!DOCTYPE html>\n<p>x</p>", "<!--\n  a -- b --> c\n-->")], "html string, c string")
    out = report.with_comment(df, F.col("c")).first()["html"]
    assert out == "<!--\n  a - - b - -> c\n-->\n<!DOCTYPE html>\n<p>x</p>" and dom.measure(out)["words"] == 1
    assert apply.apply_all(out, [])["html"].startswith(out[: out.index("<!DOCTYPE")])
