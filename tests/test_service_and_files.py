import datetime as dt
import json

from pyspark.sql import functions as F

from lumendoc.operators import loop, report, segment, service
from lumendoc.sources import readers, stages, writers
from lumendoc.streaming import intake


def test_quota(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(k, day + dt.timedelta(minutes=k // 2)) for k in range(25)] + [(100, day + dt.timedelta(days=1))]
    got = {r["event_id"]: r for r in service.daily_quota(spark.createDataFrame(rows, "event_id long, ts timestamp")).collect()}
    assert [got[k]["allowed"] for k in range(25)] == [k < 20 for k in range(25)] and got[100]["count_after"] == 1


def test_jobs(spark):
    log = spark.createDataFrame([("a", 1, "html", "running", None), ("a", 2, "done", None, "<p>"), ("b", 1, "lost", "running", None)], "id string, seq int, stage string, status string, final_html string")
    got = {r["id"]: r for r in service.job_status(service.latest_jobs(log)).collect()}
    assert (got["a"]["stage"], got["a"]["status"], got["a"]["stage_index"], got["a"]["has_html"]) == ("done", "running", 8, True)
    assert got["b"]["stage_index"] == 0 and "final_html" not in got["b"].asDict()
    steps = service.replay(spark.createDataFrame([("a", 1)], "id string, max_rounds int")).orderBy("step").collect()
    assert [r["stage"] for r in steps] == ["extracting", "alt_text", "html", "axe_baseline", "round1", "done"]


def test_health(spark):
    h = lambda *s: F.array(*(F.struct(F.lit(k + 1).alias("round"), F.lit(x).alias("status")) for k, x in enumerate(s)))
    r = spark.range(1).select(loop.merge_health(h("failed", "success", "success")).alias("a"), loop.merge_health(h("success", "failed")).alias("b")).first()
    assert (r["a"]["status"], r["a"]["round"], r["a"]["rounds_ran"]) == ("success", 1, 2) and (r["b"]["status"], r["b"]["rounds_ran"]) == ("success", None)


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "b.txt").write_text("no")
    assert [r["n_bytes"] for r in readers.read_pdfs(spark, str(tmp_path)).collect()] == [4]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.md").write_text("# a\n\n---\nb")
    md = readers.ocr_result(readers.read_markdown(spark, str(tmp_path / "m"))).first()
    assert md["markdown"] == "# a\n\n---\nb" and md["page_count"] == 2
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.json").write_text(json.dumps({"id": "x", "final": {"score": 100.0}, "enhancements": [{"element_id": "e"}]}, indent=2))
    snap = readers.read_snapshots(spark, str(tmp_path / "s")).first()
    assert snap["final"]["score"] == 100.0 and snap["enhancements"][0]["element_id"] == "e"
    files = spark.createDataFrame([("r", "/d/z.md", 0, "top"), ("r", "/d/a/a.md", 1, "deep"), ("q", "/e/b/b.md", 1, "only")], "run string, path string, depth int, markdown string")
    assert {r["run"]: r["markdown"] for r in readers.first_markdown(files, "run").collect()} == {"r": "top", "q": "only"}
    assert readers.read_settings("A=1\n# c\nbad\nB = x=y\nA=2", {"Z": "0"}) == {"Z": "0", "A": "1", "B": "x=y"}
    df = spark.createDataFrame([(1, 2, "<p>")], "doc_id long, round int, html string")
    writers.write_json(df, f"{tmp_path}/j", "doc_id", "round")
    writers.write_html(df, f"{tmp_path}/h")
    writers.write_text(df, f"{tmp_path}/t")
    assert spark.read.json(f"{tmp_path}/j").first()["html"] == "<p>" and spark.read.parquet(f"{tmp_path}/h").count() == 1
    calls = []
    for use in (True, True, False):
        writers.cached(spark, f"{tmp_path}/c", lambda: calls.append(1) or df, use).count()
    assert len(calls) == 2


def test_snapshots_come_back(spark, tmp_path):
    pages = segment.build_html(spark.createDataFrame([(0, "# T\nPrices\n<table>\n<tr><td>1</td></tr>\n</table>"), (1, "plain")], "doc_id long, text string")).select("doc_id", "html")
    runs, rounds = loop.run_loop(pages)
    both = pages.withColumnRenamed("html", "baseline_html").join(runs.select("doc_id", "final_html"), "doc_id")
    snaps = report.snapshots(runs, rounds, report.page_enhancements(both, "doc_id"))
    writers.write_snapshots(snaps, f"{tmp_path}/s")
    writers.write_index(report.snapshot_index(snaps), f"{tmp_path}/i")
    back = {r["id"]: r for r in readers.read_snapshots(spark, f"{tmp_path}/s", lines=True).collect()}
    for r in snaps.collect():
        own = back[str(r["doc_id"])]
        assert (own["stopped_reason"], own["final_html"], own["baseline"], own["final"]) == (r["stopped_reason"], r["final_html"], r["baseline"], r["final"])
        assert [(x["round"], x["patches_applied"], x["score"], x["reviewers"]) for x in own["rounds"]] == [(x["round"], x["patches_applied"], x["score"], x["reviewers"]) for x in r["rounds"]]
        assert [tuple(x) for x in own["enhancements"] or []] == [tuple(x) for x in r["enhancements"] or []]
    assert {(r["doc_id"], r["enhancements"]) for r in spark.read.json(f"{tmp_path}/i").collect()} == {(0, 1), (1, 0)}


def test_stages_build_only_what_is_new(spark, tmp_path):
    built = []

    def build(asked):
        built.append(sorted(r[0] for r in asked.select("content").collect()))
        return asked.select("digest", F.length("content").alias("n"))

    docs = lambda texts: spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    run = lambda texts: sorted((r["k"], r["n"]) for r in stages.Stage(spark, f"{tmp_path}/st", build).run(docs(texts), "text").collect())
    texts = [f"text {k}" for k in range(100)] + [None, "", "text 1"]
    assert run([]) == []
    assert run(texts) == [(k, len(t or "")) for k, t in enumerate(texts)]
    texts[40] = "changed"
    assert run(texts) == [(k, len(t or "")) for k, t in enumerate(texts)] and built[-1] == ["changed"]
    n = len(built)
    assert run(texts[::-1])[0] == (0, 6) and len(built) == n
    # a part that no list names does not count, and what two drivers built is told once
    stage = stages.Stage(spark, f"{tmp_path}/st", build)
    extra = stage.results().withColumn("stage_part", F.lit("part-zz"))
    extra.withColumn("n", F.col("n") + 1).write.parquet(f"{tmp_path}/st/part-zz")
    assert run(texts) == [(k, len(t or "")) for k, t in enumerate(texts)]
    stage.publish("part-zz")
    assert len(run(texts)) == len(texts)


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "T\nx"), (2, "U")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/d")
    q = intake.stream_blocks(docs, "doc_id").writeStream.format("memory").queryName("blocks").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("blocks").count() == 3
    day = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(k, day + dt.timedelta(minutes=k), "u") for k in range(25)], "event_id long, ts timestamp, who string").coalesce(1).write.parquet(f"{tmp_path}/e")
    events = spark.readStream.schema("event_id long, ts timestamp, who string").parquet(f"{tmp_path}/e")
    q = intake.stream_quota(events, "who").writeStream.format("memory").queryName("quota").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("quota").where("allowed").count() == 20 and spark.table("quota").count() == 25


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and {"element_ids", "remediation_loop"} <= set(e.queries())


def test_quota_of_repeated_events(spark):
    rows = [(1, "2024-01-01 00:00:00")] * 3 + [(2, "2024-01-01 00:00:01"), (3, "2024-01-02 00:00:00"), (None, None), (None, None)]
    events = spark.createDataFrame(rows, "event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = sorted(((r["event_id"], r["allowed"], r["count_after"]) for r in service.daily_quota(events, limit=2).collect()), key=str)
    assert got == sorted([(1, True, 1), (1, True, 2), (1, False, 2), (2, False, 2), (3, True, 1), (None, True, 1), (None, True, 2)], key=str)
