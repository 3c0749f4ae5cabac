"""What is told of a run: added attributes, decision counts, tables and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elements import element_table, last_of_each
from .score import IMPACTS

#: Attributes that are reported, in this order.
REPORTED = ("aria-label", "role", "aria-describedby", "aria-labelledby")


def enhancements(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Attributes that the final elements have and the baseline's had not, or otherwise.

    Both tables: keys, ir_id, pos, attrs, one row an id.  Columns: keys,
    element_id, attribute, value, and pos and key_pos for the order.
    """
    was = before.select(*keys, "ir_id", F.col("attrs").alias("was"))
    at = after.join(was, [*keys, "ir_id"], "left")
    pairs = F.array(*(F.struct(F.lit(n).alias("key_pos"), F.lit(k).alias("attribute"), F.try_element_at("attrs", F.lit(k)).alias("value"), F.try_element_at("was", F.lit(k)).alias("old")) for n, k in enumerate(REPORTED)))
    rows = at.select(*keys, F.col("ir_id").alias("element_id"), "pos", F.explode(pairs).alias("x")).select(*keys, "element_id", "pos", "x.*")
    return rows.where((F.coalesce("value", F.lit("")) != "") & ~F.col("value").eqNullSafe(F.col("old"))).drop("old")


def page_enhancements(pages: DataFrame, *keys: str, baseline: str = "baseline_html", final: str = "final_html") -> DataFrame:
    """The same from two columns of HTML."""
    index = lambda c: last_of_each(element_table(pages, *keys, html=c), *keys)
    return enhancements(index(baseline), index(final), *keys)


def round_summaries(rounds: DataFrame, *keys: str) -> DataFrame:
    """Accepted rounds with counts of decisions and the sorted reviewers."""
    n = lambda d: F.size(F.filter(F.coalesce("judge_audit", F.array()), lambda a: a["decision"] == d))
    who = F.array_sort(F.array_distinct(F.flatten(F.transform("judge_audit", lambda a: a["reviewers"]))))
    return rounds.where("status = 'accepted'").select(
        *keys, "round", "patches_applied", "passes", "score", "violations", "gate_passed", "gate_checks",
        n("ACCEPT").alias("accepted"), n("NEEDS_HUMAN").alias("needs_human"), n("REJECT_HALLUCINATED").alias("hallucinations"), F.coalesce(who, F.array().cast("array<string>")).alias("reviewers"),
    )


def decision_counts(audit: DataFrame, *keys: str) -> DataFrame:
    """The counts from audit rows, with the sorted distinct reviewers: one aggregation over exploded rows would count twice, so sets are merged."""
    return audit.groupBy(*keys).agg(
        F.count_if(F.col("decision") == "ACCEPT").alias("accepted"), F.count_if(F.col("decision") == "NEEDS_HUMAN").alias("needs_human"), F.count_if(F.col("decision") == "REJECT_HALLUCINATED").alias("hallucinations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("reviewers")))).alias("reviewers"),
    )


def comparison(runs: DataFrame, rounds: DataFrame) -> DataFrame:
    """A line of a Markdown table for every document: baseline, three rounds, final, why it stopped."""
    cell = F.concat(F.col("patches_applied").cast("string"), F.lit(" → "), F.col("passes").cast("string"), F.lit("p"))
    wide = rounds.where("status = 'accepted'").groupBy("doc_id").pivot("round", [1, 2, 3]).agg(F.first(cell))
    at = runs.join(wide, "doc_id", "left")
    cells = [F.coalesce(F.col(f"`{r}`"), F.lit("—")) for r in (1, 2, 3)]
    base = F.concat(F.col("baseline.violations").cast("string"), F.lit(" / "), F.col("baseline.passes").cast("string"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("doc_id").cast("string"), base, *cells, F.col("final.passes").cast("string"), "stopped_reason"), F.lit(" |"))
    return at.select("doc_id", *(c.alias(f"round{k}") for k, c in enumerate(cells, 1)), line.alias("line"))


def comment_block(s: Column, severity: Column, rules: Column, n_images: Column, duplicates: Column, stamp: Column) -> Column:
    """The audit comment before a page; the lines on rules and repeated ids only where there are any."""
    some = lambda c, lines: F.when(F.size(c) > 0, lines).otherwise(F.array().cast("array<string>"))
    head = F.array(
        F.lit("<!--"), F.concat(F.lit("  Generated: "), stamp), F.lit(""), F.lit("  Accessibility audit summary:"),
        F.concat(F.lit("    Score (passes / passes+violations): "), s["score"].cast("string"), F.lit("%")),
        F.concat(F.lit("    Violations: "), s["violations"].cast("string"), F.lit("  ("), F.concat_ws(", ", *(F.concat(F.lit(f"{i} "), severity[i].cast("string")) for i in IMPACTS)), F.lit(")")),
        F.concat(F.lit("    Passes: "), s["passes"].cast("string")), F.concat(F.lit("    Images with generated alt text: "), n_images.cast("string")),
    )
    listed = F.transform(rules, lambda r: F.concat(F.lit("      - "), r["id"], F.lit(" ["), r["impact"], F.lit("] x"), r["nodes"].cast("string")))
    twice = F.array(F.lit(""), F.lit("  Repeated identifiers (not blocking):"), F.concat(F.lit("    "), F.array_join(F.array_sort(duplicates), ", ")))
    return F.array_join(F.concat(head, some(rules, F.concat(F.array(F.lit("    Violation rules:")), listed)), some(duplicates, twice), F.array(F.lit("-->"))), "\n")


def with_comment(pages: DataFrame, comment: Column, html: str = "html") -> DataFrame:
    """Pages with the audit comment before them; ``--`` inside it, which would end it, is parted."""
    inner = F.replace(F.substring(comment, F.lit(5), F.length(comment) - 7), F.lit("--"), F.lit("- -"))
    return pages.withColumn(html, F.concat(F.lit("<!--"), inner, F.lit("-->\n"), F.col(html)))


def snapshots(runs: DataFrame, rounds: DataFrame, added: DataFrame) -> DataFrame:
    """One row a document: baseline, its accepted rounds, final, and the added attributes."""
    r = round_summaries(rounds, "doc_id")
    r = r.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*r.columns[1:]))).alias("rounds"))
    e = F.transform(F.array_sort(F.collect_list(F.struct("pos", "key_pos", "element_id", "attribute", "value"))), lambda x: F.struct(x["element_id"].alias("element_id"), x["attribute"].alias("attribute"), x["value"].alias("value")))
    e = added.groupBy("doc_id").agg(e.alias("enhancements"))
    return runs.join(r, "doc_id", "left").join(e, "doc_id", "left")


def snapshot_index(snaps: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    return snaps.select("doc_id", F.col("baseline.passes").alias("baseline_passes"), F.col("final.passes").alias("final_passes"), n("enhancements").alias("enhancements"), n("rounds").alias("rounds"))
