"""Registered queries on what reviewers, judges and image models answer, and on what is told of a run, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lumendoc import model
from lumendoc.functions import text as X
from lumendoc.operators import elements, judge, loop, providers, report, reviews, score, segment
from lumendoc.sources import readers

from .catalogue import _ESC, _ID, _LINES, _SQUEEZE, ORACLES, _t, query, supplier_pages, synthetic_reviews


def _flags_first(html: str) -> str:
    """A reviewer that flags the first identified element; without one it fails."""
    return f'[{{"id": "{re.search(r"data-ir-id=.([^\"]+)", html)[1]}", "fix": "lang", "confidence": 0.5}}]'


def _is_down(html: str) -> str:
    raise ConnectionError("no answer")


@query(f"""
WITH {_LINES}, first AS (SELECT doc_id, ir_id FROM e WHERE pos = 0)
SELECT d.doc_id, ir_id IS NULL AS failed, ir_id AS element_id, CASE WHEN ir_id IS NOT NULL THEN 'a success,b failed,c failed' END AS health FROM documents d LEFT JOIN first USING (doc_id)""")
def live_reviews(spark, d):
    """Every page to three reviewers, of which one is down and one gives no JSON: a page fails only if all of them do."""
    pages = segment.build_html(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "html")
    ask = providers.reviewer_provider({"a": _flags_first, "b": _is_down, "c": lambda html: "nothing to say"}, retries=1, backoff=0.0)
    out = ask(1, pages)
    told = F.array_join(F.array_sort(F.transform(F.map_entries("health"), lambda x: F.concat_ws(" ", x["key"], x["value"]))), ",")
    return out.select("doc_id", "failed", F.get(F.col("reviews")["a"], 0)["element_id"].alias("element_id"), told.alias("health"))


@query("SELECT doc_id, lang <> 'en' AS all_failed, 'failed' AS first, CASE WHEN lang = 'en' THEN 'success' ELSE 'failed' END AS second FROM documents WHERE lang IS NOT NULL")
def reviewer_answers(spark, d):
    """Two answers a document, of which the second is JSON for some languages."""
    rows = _t(spark, d, "documents").where("lang IS NOT NULL")
    raw = rows.select("doc_id", F.explode(F.array(F.struct(F.lit("first").alias("reviewer"), F.col("lang").alias("text")), F.struct(F.lit("second").alias("reviewer"), F.when(F.col("lang") == "en", '```json\n{"issues": []}\n```').otherwise(F.col("lang")).alias("text")))).alias("x")).select("doc_id", "x.*")
    h = reviews.health(raw, "doc_id")
    return h.select("doc_id", "all_failed", F.col("reviewer_status")["first"].alias("first"), F.col("reviewer_status")["second"].alias("second"))


@query("""
SELECT doc_id, CASE WHEN length(text) % 3 < 2 THEN source END AS new_value, CASE WHEN length(text) % 3 < 2 THEN length(text) % 2 = 0 END AS safe, CASE WHEN length(text) % 3 < 2 THEN 0.25 END::double AS confidence
FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")
def judge_answers(spark, d):
    """A judging model's answers: JSON, JSON within other words, and words alone."""
    rows = _t(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    n = F.length("text")
    plain = F.concat(F.lit('{"new_value": "'), F.col("source"), F.lit('", "safe": '), (n % 2 == 0).cast("string"), F.lit(', "confidence": 0.25}'))
    answer = F.when(n % 3 == 0, plain).when(n % 3 == 1, F.concat(F.lit("Sure:\n"), plain, F.lit("\nDone."))).otherwise(F.col("source"))
    return rows.select("doc_id", reviews.model_json(answer).alias("m")).select("doc_id", "m.new_value", "m.safe", "m.confidence")


def _describe(data: bytes, context: str) -> str:
    if len(data) % 5 == 0:
        raise ValueError("unreadable")
    return f"{'A chart' if len(data) % 2 else 'Prose'}: {context}"


_ALT = f"CASE WHEN strlen(text) % 2 = 1 THEN 'A chart: ' ELSE 'Prose: ' END || {_SQUEEZE('text')}[1:150]"


@query(f"""
WITH x AS (SELECT doc_id, strlen(text) % 5 > 0 AS ok, {_ALT} AS alt FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN ok THEN sha256(alt) ELSE sha256('img_1.png') END AS alt_sha256, ok AND regexp_matches(lower(alt), '{'|'.join(X.LONG_DESCRIPTION_WORDS)}') AS long, CASE WHEN ok THEN 0.9 ELSE 0 END::double AS confidence FROM x""")
def image_texts(spark, d):
    """Documents as images of their text, described by a model that can't read every fifth: then the file's name stands in."""
    docs = _t(spark, d, "documents").where("text IS NOT NULL")
    found = docs.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("i"), F.lit(1).alias("xref"), F.lit("png").alias("ext"), F.encode("text", "UTF-8").alias("data"), F.col("text").alias("page_text"))
    told = readers.describe_images(readers.number_images(found, "img_"), providers.alt_text_provider(_describe))
    return told.select("doc_id", F.sha2("alt_text", 256).alias("alt_sha256"), F.col("requires_long_desc").alias("long"), "confidence")


_NAME = "'p' || doc_id || '.png'"
_IDENT = lambda p: _ID(f"('{p}' || {_NAME})")


@query(f"""
SELECT doc_id, '    <figure data-ir-id="' || {_IDENT("fig:")} || '">' || chr(10) || '      <img data-ir-id="' || {_IDENT("img:")} || '" src="data:image/png;base64,' || base64(encode(source)) || '" alt="' || replace({_ESC.format("lang")}, '"', '&quot;') || '">'
       || CASE WHEN length(text) % 2 = 0 THEN chr(10) || '      <figcaption data-ir-id="' || {_IDENT("cap:")} || '">{segment.LONG_CAPTION}</figcaption>' ELSE '' END || chr(10) || '    </figure>' AS html
FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang <> ''""")
def figures(spark, d):
    """A figure a document; with a caption where the image must be described at length."""
    rows = _t(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL AND lang <> ''")
    image = F.struct(F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit(".png")).alias("filename"), F.encode("source", "UTF-8").alias("data"), F.col("lang").alias("alt_text"), (F.length("text") % 2 == 0).alias("requires_long_desc"))
    return rows.select("doc_id", F.array_join(segment.render_figures(F.array(image)), "\n").alias("html"))


@query(f"SELECT doc_id, 'e:1.3.1' AS issue_id, n_reviewers || '/3 agree (confidence ' || confidence || ')' AS dedup_status, false AS model_call FROM ({ORACLES['consensus_confidence']})")
def audit_lines(spark, d):
    """How the audit tells of the agreement behind every group."""
    groups = reviews.consensus(reviews.explode_reviews(synthetic_reviews(spark, d), "doc_id"), "doc_id")
    none = groups.select("doc_id", F.lit("e").alias("ir_id"), F.lit("ul").alias("tag"), F.lit("").alias("alt"), F.lit(False).alias("empty"), F.create_map().cast("map<string,string>").alias("attrs"))
    told = judge.audit(judge.decide(judge.classify(groups, none, "doc_id")), "doc_id")
    return told.select("doc_id", "issue_id", "dedup_status", F.coalesce("model_call", F.lit(False)).alias("model_call"))


@query("""
WITH x AS (SELECT lang, length(text) % 3 AS k, source FROM documents WHERE text IS NOT NULL)
SELECT lang, count(*) FILTER (k = 0) AS accepted, count(*) FILTER (k = 1) AS needs_human, count(*) FILTER (k = 2) AS hallucinations, string_agg(DISTINCT source, ',' ORDER BY source) AS reviewers FROM x GROUP BY lang""")
def decision_reviewers(spark, d):
    """Decisions by language with all who took part, sorted; sources of documents stand for reviewers."""
    k = F.length("text") % 3
    decision = F.when(k == 0, "ACCEPT").when(k == 1, "NEEDS_HUMAN").otherwise("REJECT_HALLUCINATED")
    rows = _t(spark, d, "documents").where("text IS NOT NULL").select("lang", decision.alias("decision"), F.filter(F.array("source"), lambda x: x.isNotNull()).alias("reviewers"))
    return report.decision_counts(rows, "lang").withColumn("reviewers", F.nullif(F.array_join("reviewers", ","), F.lit("")))


@query("SELECT s_suppkey::bigint AS doc_id, 9 AS baseline_passes, 11 AS final_passes, 2 AS enhancements, 3 AS rounds FROM supplier")
def snapshot_rows(spark, d):
    """The index of stored runs over suppliers' pages."""
    pages = supplier_pages(spark, d)
    runs, rounds = loop.run_loop(pages)
    both = pages.withColumnRenamed("html", "baseline_html").join(runs.select("doc_id", "final_html"), "doc_id")
    return report.snapshot_index(report.snapshots(runs, rounds, report.page_enhancements(both, "doc_id")))


@query("SELECT event_type, 100.0::double * count(*) FILTER (user_id % 3 = 0) / count(*) AS score, count(*) FILTER (user_id % 3 > 0)::int AS violations, count(*) FILTER (user_id % 3 = 1)::int AS critical_serious FROM events GROUP BY event_type")
def score_summaries(spark, d):
    """Scores from rules: some pass, some are violated, and of these some gravely."""
    k = F.col("user_id") % 3
    rule = F.struct(F.col("event_id").cast("string").alias("id"), F.when(k == 1, "serious").otherwise("minor").alias("impact"), F.lit(1).alias("nodes"))
    scored = _t(spark, d, "events").groupBy("event_type").agg(F.struct(F.collect_list(F.when(k > 0, rule)).alias("rules"), F.count_if(k == 0).cast("int").alias("passes")).alias("s"))
    s = score.summary(F.col("s").cast(model.SCORED))
    exact = 100 * F.col("s.passes") / (F.col("s.passes") + F.size("s.rules"))
    return scored.select("event_type", F.when(F.round(exact, 1) == s["score"], exact).alias("score"), s["violations"].alias("violations"), s["critical_serious"].alias("critical_serious"))


@query(f"""
WITH {_LINES}, n AS (SELECT doc_id, ir_id, count(*) AS n FROM e GROUP BY ALL), twice AS (SELECT doc_id, string_agg(ir_id, ', ' ORDER BY ir_id) AS ids FROM n WHERE n.n > 1 GROUP BY doc_id)
SELECT doc_id, '<!--' || chr(10) || '  Generated: now' || chr(10) || chr(10) || '  Accessibility audit summary:' || chr(10) || '    Score (passes / passes+violations): 90.0%' || chr(10)
       || '    Violations: 1  (critical 1, serious 0, moderate 0, minor 0)' || chr(10) || '    Passes: 9' || chr(10) || '    Images with generated alt text: 3' || chr(10) || '    Violation rules:' || chr(10) || '      - image-alt [critical] x2' || chr(10)
       || coalesce(chr(10) || '  Repeated identifiers (not blocking):' || chr(10) || '    ' || ids || chr(10), '') || '-->' || chr(10) || '<!DOCTYPE html>' AS head FROM documents LEFT JOIN twice USING (doc_id)""")
def commented_pages(spark, d):
    """Pages with the audit comment before them, which names identifiers that repeat."""
    scored = F.from_json(F.lit('{"rules":[{"id":"image-alt","impact":"critical","nodes":2}],"passes":9}'), model.SCORED)
    docs = _t(spark, d, "documents").select("doc_id", "text")
    blocks = segment.explode_blocks(segment.with_blocks(docs), "doc_id")
    twice = segment.duplicate_ids(blocks, "doc_id").groupBy("doc_id").agg(F.collect_list("ir_id").alias("twice"))
    pages = segment.build_html(docs).select("doc_id", "html").join(twice, "doc_id", "left")
    comment = report.comment_block(score.summary(scored), score.severity(scored), scored["rules"], F.lit(3), F.coalesce("twice", F.array().cast("array<string>")), F.lit("now"))
    return report.with_comment(pages, comment).select("doc_id", F.regexp_extract("html", r"(?s)\A.*?-->\n<!DOCTYPE html>", 0).alias("head"))


@query(f"""
WITH {_LINES} SELECT doc_id, 'ul' AS tag, {_ID("('ul:' || text)")} AS ir_id FROM e WHERE pos = 0 UNION ALL SELECT doc_id, 'table', {_ID("('table:' || left('<table>' || text || '</table>', 60))")} FROM e WHERE pos = 0""")
def salted_ids(spark, d):
    """Identifiers of a list and a table that a document's first line is made into."""
    rows = segment.explode_blocks(segment.with_blocks(_t(spark, d, "documents").select("doc_id", "text")), "doc_id").where("pos = 0")
    parts = F.array(F.struct(F.lit("ul").alias("tag"), F.col("text").alias("t")), F.struct(F.lit("table").alias("tag"), F.concat(F.lit("<table>"), F.col("text"), F.lit("</table>")).alias("t")))
    return rows.select("doc_id", F.explode(parts).alias("x")).select("doc_id", "x.tag", X.element_id(X.id_salt(F.col("x.tag"), F.col("x.t"))).alias("ir_id"))


@query(f"""
WITH {_LINES}, h AS (SELECT doc_id, max(ir_id) FILTER (pos = 0) AS first, max_by(ir_id, pos) AS last FROM e GROUP BY doc_id)
SELECT doc_id, 'first' AS named, ir_id, tag FROM (SELECT h.doc_id, first AS ir_id, max_by(kind, pos) AS tag FROM h JOIN e ON e.doc_id = h.doc_id AND e.ir_id = h.first GROUP BY ALL)
UNION ALL SELECT doc_id, 'last', ir_id, tag FROM (SELECT h.doc_id, last AS ir_id, max_by(kind, pos) AS tag FROM h JOIN e ON e.doc_id = h.doc_id AND e.ir_id = h.last WHERE first <> last GROUP BY ALL)""")
def named_elements(spark, d):
    """Of every page only the elements that are asked for leave the scan: the first and the last identifier."""
    pages = segment.build_html(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "html")
    ids = elements.valid_ids(F.col("html"))
    pages = pages.withColumn("last", F.get(F.regexp_extract_all("html", F.lit('data-ir-id="([^"]+)"'), F.lit(1)), F.size(F.regexp_extract_all("html", F.lit('data-ir-id="([^"]+)"'), F.lit(1))) - 1)).withColumn("first", F.get(ids, 0))
    found = elements.last_of_each(elements.element_table(pages, "doc_id", "first", wanted=F.array_compact(F.array("first", "last"))), "doc_id", "first")
    return found.select("doc_id", F.when(F.col("ir_id") == F.col("first"), "first").otherwise("last").alias("named"), "ir_id", "tag")
