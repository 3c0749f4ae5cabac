"""The remediation loop over all documents at once, for up to three rounds.

A round is one pass over the active documents: reviews, consensus, decisions,
patches, gate and score; then each document is accepted, put back or stopped by
expressions.  A round is written once, as a delta: the next one reads only those
of its rows that go on, the finished ones stay where they are.  What a round
writes thus follows the documents that are still active.  The driver holds
counts only.  A document's failure is a status, not a failed task.

Pages are read as little as the round needs: identified elements only for the
ids that the reviews name, patches that only annotate are spliced into pages
that the loop has written before, and pages that a round left as they were keep
their score.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumendoc.functions.arrow import arrow_function
from lumendoc import model
from lumendoc.functions import dom
from lumendoc.session import materialize, spread

from . import apply, elements, gate, judge, reviews, score

MAX_ROUNDS = 3
THRESHOLD = 95.0
#: (round, rows of doc_id and html) to rows of doc_id, reviews (REVIEWS; null: no more), failed, and if it
#: can tell, health (map of reviewer to "success" or another word).
ReviewsProvider = Callable[[int, DataFrame], DataFrame]
#: (html, patches, canonical) to APPLIED.
Applicator = Callable[[Column, Column, Column], Column]

_SYNTH = {
    1: ("table", "aria-label", "This table has no name that is read out.", 'Set aria-label="{}" on it.'),
    2: ("ul", "role", "This list does not state its role.", 'Set role="list" on it.'),
}
SYNTH_REVIEWERS = ("olmo", "gemini", "gpt")


def table_label(table: dom.Node, nth: int) -> str:
    """Text of the nearest sibling before with any, cut; else a numbered name."""
    for x in reversed(table.parent.children[: table.place()]):
        if isinstance(x, dom.Node) and (t := "".join(x.texts()).strip()):
            return t[:40]
    return f"Data table {nth}"


def synthesized(html: str | None, turn: int) -> list[dict]:
    """Round 1: tables without a name. Round 2: lists without a role. Then nothing."""
    if turn not in _SYNTH:
        return []
    tag, attribute, issue, fix = _SYNTH[turn]
    found = [x for x in dom.parse(html or "").walk() if x.tag == tag and dom.IR_ID in x.attrs]
    return [
        {"issue_id": f"synth-{x.attrs[dom.IR_ID]}", "wcag_criterion": "1.3.1", "element_id": x.attrs[dom.IR_ID], "issue": issue, "impact": "serious", "confidence": 0.85,
         "suggested_fix": fix.format(table_label(x, k)) if turn == 1 else fix, "fix_type": "deterministic", "hallucinated": False}
        for k, x in enumerate(found, 1) if not x.attrs.get(attribute)
    ]


def synth_provider(turn: int, active: DataFrame) -> DataFrame:
    """Three reviewers that agree on what the page's own elements lack."""
    one = "array<struct<issue_id:string,wcag_criterion:string,element_id:string,issue:string,impact:string,confidence:double,suggested_fix:string,fix_type:string,hallucinated:boolean>>"

    @arrow_function(one)
    def issues(html: pd.Series) -> pd.Series:
        return html.map(lambda x: synthesized(x, turn))

    got = active.select("doc_id", issues("html").alias("i"))
    full = F.create_map(*(x for r in SYNTH_REVIEWERS for x in (F.lit(r), F.col("i"))))
    return got.select("doc_id", F.when(F.size("i") > 0, full).otherwise(F.create_map().cast(f"map<string,{one}>")).alias("reviews"), F.lit(False).alias("failed"))


def file_provider(rounds: dict[int, DataFrame]) -> ReviewsProvider:
    """Stored reviews (doc_id, reviews) by round; a round without any stops. Every reviewer that has an entry counts as healthy."""

    def provide(turn: int, active: DataFrame) -> DataFrame:
        none = F.lit(None).cast("map<string,string>")
        if turn not in rounds:
            return active.select("doc_id", F.lit(None).cast(model.REVIEWS).alias("reviews"), F.lit(False).alias("failed"), none.alias("health"))
        health = F.transform_values("reviews", lambda k, v: F.lit("success"))
        return active.select("doc_id").join(rounds[turn], "doc_id", "left").select("doc_id", "reviews", F.lit(False).alias("failed"), health.alias("health"))

    return provide


#: One row a document: what the rounds so far have left.
_HEALTH = "array<struct<reviewer string, round int, status string>>"
_STATE = ("baseline", "last", "violations", "rounds_accepted", "canonical", "health")


def _round(turn: int, active: DataFrame, provider: ReviewsProvider, alt: judge.AltProvider | None, scorer: score.Scorer, threshold: float, applicator: Applicator) -> DataFrame:
    """The active documents after a round: doc_id, html, the state, and the round's figures with its status (null: none) and stop (null: it goes on)."""
    told = provider(turn, active.select("doc_id", "html"))
    health = F.col("health") if "health" in told.columns else F.lit(None).cast("map<string,string>")
    told = told.select("doc_id", "reviews", F.coalesce("failed", F.lit(False)).alias("failed"), F.when(~F.coalesce("failed", F.lit(False)), health).alias("told_health"))
    met = F.transform(F.map_entries(F.coalesce("told_health", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("reviewer"), F.lit(turn).alias("round"), e["value"].alias("status")))
    told = active.join(told, "doc_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False))).withColumn("health", F.concat("health", met)).drop("told_health")
    told = materialize(told, "loop-reviews")
    live = told.where("reviews IS NOT NULL AND NOT failed")
    groups = reviews.consensus(reviews.explode_reviews(live.select("doc_id", "reviews"), "doc_id"), "doc_id")
    named = F.array_distinct(F.transform(F.flatten(F.map_values("reviews")), lambda i: i["element_id"]))
    index = elements.last_of_each(elements.element_table(live, "doc_id", wanted=named), "doc_id")
    decided = materialize(judge.decide(judge.classify(groups, index, "doc_id"), alt), "loop-decisions")
    audits = judge.audit(decided, "doc_id")
    audits = audits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*audits.columns[1:]))).alias("judge_audit"))
    at = live.drop("reviews", "failed").join(judge.manifests(decided, "doc_id"), "doc_id", "left").join(audits, "doc_id", "left")
    at = at.withColumn("patches", F.coalesce("patches", F.array().cast(model.PATCHES))).withColumn("applied", applicator(F.col("html"), F.col("patches"), F.col("canonical")))
    at = gate.run_gate(at.withColumn("patched", F.col("applied.html")), "html", "patched")
    changed = ~F.col("patched").eqNullSafe(F.col("html"))
    at = at.withColumn("scored", scorer(F.when(changed, F.col("patched")))).withColumn("s", F.when(changed, score.summary(F.col("scored"))).otherwise(F.col("last")))
    status = (
        F.when(~F.col("applied.ok"), "applicator_rollback")
        .when(~F.col("gate_passed"), "gate_failed_reverted")
        .when(F.col("s.violations") > F.col("violations"), "axe_regression_reverted")
        .otherwise("accepted")
    )
    at = at.withColumn("status", status).withColumn("n", F.when(F.col("applied.ok"), F.size("patches")).otherwise(0))
    done = (F.col("status") == "accepted") & (F.col("s.score") >= threshold) & F.col("gate_passed") & (F.col("s.critical_serious") == 0) & (F.col("n") == 0)
    stop = (
        F.when(F.col("status") == "applicator_rollback", "applicator_rollback")
        .when(F.col("status") == "gate_failed_reverted", "gate_failed")
        .when(F.col("status") == "axe_regression_reverted", "axe_regression")
        .when(done, "converged")
    )
    took = F.col("status") == "accepted"
    keep = lambda new, old: F.when(took, new).otherwise(F.col(old))
    out = at.select(
        "doc_id", keep(F.col("patched"), "html").alias("html"), "baseline", keep(F.col("s"), "last").alias("last"), keep(F.col("s.violations"), "violations").alias("violations"),
        (F.col("rounds_accepted") + took.cast("int")).alias("rounds_accepted"), keep(apply.stays_canonical(F.col("patches")), "canonical").alias("canonical"), "health",
        "status", stop.alias("stop"), F.col("n").alias("patches_applied"),
        F.coalesce("n_rejected", F.lit(0)).cast("long").alias("rejected"), "s.score", "s.violations", "s.passes", "s.critical_serious", "gate_passed", F.col("gate_failed").alias("gate_failed_checks"), "gate_checks",
        F.when(F.col("status") == "axe_regression_reverted", F.concat(F.col("violations").cast("string"), F.lit(" -> "), F.col("s.violations").cast("string"), F.lit(" violations"))).alias("regression"),
        F.when(F.col("status") == "applicator_rollback", "No patch of this round was applied; the log names the first that failed.").alias("error"), "judge_audit",
    )
    state = ["doc_id", "html", *_STATE]
    figures = [f for f in out.schema.fields[len(state) :]]
    out = out.toDF(*state, *(f"r_{f.name}" for f in figures))
    failed = F.col("failed")
    gone = {
        "status": F.when(failed, "reviewers_failed"), "stop": F.when(failed, "reviewers_failed").otherwise("no_more_reviews"),
        "error": F.when(failed, "No reviewer gave a readable answer."),
    }
    off = told.where("reviews IS NULL OR failed").select(*state, *(gone.get(f.name, F.lit(None).cast(f.dataType)).alias(f"r_{f.name}") for f in figures))
    return materialize(out.unionByName(off).withColumn("r_round", F.lit(turn)), "loop-round")


def run_loop(
    baseline: DataFrame, provider: ReviewsProvider = synth_provider, *, alt_provider: judge.AltProvider | None = None, scorer: score.Scorer = score.offline_scorer,
    applicator: Applicator = apply.apply_patches, max_rounds: int = MAX_ROUNDS, threshold: float = THRESHOLD, on_round: Callable[[int, DataFrame], None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """baseline: doc_id and html.  Gives (runs, rounds).

    rounds: one row a document and round that has a status (a round that only
    found no more reviews has none).  runs: one row a document, with the health
    of its reviewers over the rounds.  The final score is the last accepted one,
    as the page has not changed since.  ``on_round`` gets the accepted rows of a
    round, with their health so far.
    """
    first = score.summary(scorer(F.col("html")))
    state = spread(baseline.select("doc_id", "html"), "doc_id").withColumn("s", first)
    state = state.select("doc_id", "html", F.col("s").alias("baseline"), F.col("s").alias("last"), F.col("s.violations").alias("violations"), F.lit(0).alias("rounds_accepted"), F.lit(False).alias("canonical"), F.array().cast(_HEALTH).alias("health"))
    active = materialize(state, "loop-state")
    finished, rounds = [], []
    as_round = lambda now: now.select("doc_id", *(F.col(c).alias(c[2:]) for c in now.columns if c.startswith("r_")), "health").where("status IS NOT NULL").drop("stop")
    for turn in range(1, max_rounds + 1):
        if active.isEmpty():
            break
        now = _round(turn, active, provider, alt_provider, scorer, threshold, applicator)
        rounds.append(as_round(now).drop("health"))
        if on_round:
            on_round(turn, as_round(now).where("status = 'accepted'"))
        finished.append(now.where("r_stop IS NOT NULL").select("doc_id", "html", *_STATE, F.col("r_stop").alias("stop")))
        active = now.where("r_stop IS NULL").select("doc_id", "html", *_STATE)
    every = functools.reduce(DataFrame.unionByName, finished, active.withColumn("stop", F.lit("max_rounds_reached")))
    who = F.array_distinct(F.transform("health", lambda x: x["reviewer"]))
    met = lambda r: F.transform(F.filter("health", lambda x: x["reviewer"] == r), lambda x: F.struct(x["round"].alias("round"), x["status"].alias("status")))
    health = F.transform(who, lambda r: F.struct(r.alias("reviewer"), merge_health(met(r)).alias("health")))
    runs = every.select("doc_id", "baseline", F.col("last").alias("final"), "rounds_accepted", F.col("stop").alias("stopped_reason"), F.col("html").alias("final_html"), health.alias("reviewer_health"))
    if not rounds:  # no documents, or no rounds asked for
        rounds = [as_round(_round(0, active.limit(0), synth_provider, None, scorer, threshold, applicator)).drop("health")]
    return runs, functools.reduce(DataFrame.unionByName, rounds)


def merge_health(rounds_health: Column) -> Column:
    """Fold of a reviewer's statuses over rounds (array of struct(round, status), in order).

    The first round's entry stays; a later success makes it a success and
    counts a round run; a later failure changes nothing.
    """
    first = F.get(rounds_health, 0)
    later = F.filter(F.slice(rounds_health, 2, 1 << 30), lambda x: x["status"] == "success")
    return F.struct(F.when(F.size(later) > 0, "success").otherwise(first["status"]).alias("status"), first["round"].alias("round"), F.nullif(F.size(later), F.lit(0)).alias("rounds_ran"))
