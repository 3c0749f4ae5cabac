"""Callables (remote models, stubs) as providers for the loop, the judge and the image step.

A call that fails is repeated ``retries`` times with growing pauses inside its
row; then its answer is null.  Errors are counted by kind only, so no message
with a secret reaches a column.  What calls gave is written before it is used;
with a ledger it is also kept by page, reviewer and round, so that a loop that is
run again calls nobody for an answer that is there.  A task that is lost before
its answers are written repeats its own calls only.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumendoc import model
from lumendoc.functions import text as X
from lumendoc.functions.arrow import arrow_function
from lumendoc.session import materialize
from lumendoc.sources.stages import Stage

from . import elements, reviews
from .loop import ReviewsProvider

RETRIES, BACKOFF = 1, 2.0
#: Between the parts of what a ledger keeps an answer for.
NUL = "\x00"


def tried(f: Callable, *args, retries: int = RETRIES, backoff: float = BACKOFF) -> tuple:
    """(result of a call, null after so many failures; calls made)."""
    for attempt in range(retries + 1):
        try:
            return f(*args), attempt + 1
        except Exception:  # noqa: BLE001  any failure of a provider is a missing answer
            if attempt < retries:
                time.sleep(backoff ** (attempt + 1))
    return None, retries + 1


def called(f: Callable, *args, **how):
    """The result of a call, null after so many failures."""
    return tried(f, *args, **how)[0]


def available(reviewers: dict[str, Callable[[str], str]], settings: dict[str, str], needs: dict[str, str]) -> dict[str, Callable[[str], str]]:
    """The reviewers whose setting (if they need one) is there."""
    return {n: f for n, f in reviewers.items() if n not in needs or settings.get(needs[n])}


def reviewer_provider(reviewers: dict[str, Callable[[str], str]], retries: int = RETRIES, backoff: float = BACKOFF, partitions: int | None = None, at_once: int = 1, ledger: str | None = None) -> ReviewsProvider:
    """Every active page goes to every reviewer; what they answer becomes issues.

    Pages are clipped for the reviewers, while valid ids come from the whole
    page.  One reviewer's failure leaves the others'; if all fail, so does the
    page's round.  The health tells who answered.  A page goes to Python once, for
    all its reviewers.  ``partitions`` bounds how many tasks make calls (then dealt
    out one by one), ``at_once`` how many a task makes at a time.  ``ledger``: a
    folder where answers are kept with the calls that they took, by what was
    sent, to whom and in which round; failures are not kept, so they are asked
    again.
    """
    names = list(reviewers)
    issues_type = model.REVIEWS[len("map<string,") : -1]

    @arrow_function("struct<text array<string>, tries array<int>>")
    def ask(who: pd.Series, html: pd.Series) -> pd.DataFrame:
        calls = [(w, h) for ws, h in zip(who, html) for w in ws]
        answer = lambda c: tried(reviewers[c[0]], c[1], retries=retries, backoff=backoff)
        if at_once > 1:
            with ThreadPoolExecutor(at_once) as pool:
                got = iter(list(pool.map(answer, calls)))
        else:
            got = map(answer, calls)
        by_page = [[next(got) for _ in ws] for ws in who]
        return pd.DataFrame({"text": [[text for text, _ in x] for x in by_page], "tries": [[n for _, n in x] for x in by_page]})

    def build(asked: DataFrame) -> DataFrame:
        """Answers for the ledger: (digest, content) to (digest, text, tries)."""
        part = lambda k: F.split("content", NUL, 3)[k]
        asked = asked.repartition(partitions, "digest") if partitions else asked
        told = asked.select("digest", ask(F.array(part(0)), part(2)).alias("a")).select("digest", F.col("a.text")[0].alias("text"), F.col("a.tries")[0].alias("tries"))
        return materialize(told, "ledger-answers").where("text IS NOT NULL")

    def one_by_one(turn: int, pages: DataFrame) -> DataFrame:
        """Calls dealt out to tasks or to the ledger each by itself; their texts are gathered by page."""
        fan = pages.select("*", F.posexplode(F.array(*map(F.lit, names))).alias("place", "reviewer"))
        if ledger:
            sent = fan.withColumn("sent", F.concat_ws(NUL, "reviewer", F.lit(str(turn)), F.coalesce("html", F.lit(""))))
            told = Stage(fan.sparkSession, ledger, build).run(sent, "sent", how="left")
        else:
            told = fan.repartition(partitions, "doc_id", "reviewer").withColumn("text", ask(F.array("reviewer"), "html")["text"][0])
        raw = materialize(told.select("doc_id", "place", "valid_ids", "text"), "reviewer-answers")
        texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
        return raw.groupBy("doc_id").agg(F.first("valid_ids").alias("valid_ids"), texts.alias("texts"))

    def judged(told: DataFrame) -> DataFrame:
        """A page's texts to its reviews, all inside the row."""
        told = told.select("doc_id", "valid_ids", *(reviews.answer_items(F.get("texts", F.lit(k)), F.col("valid_ids")).alias(f"items_{k}") for k in range(len(names))))
        each = [F.struct(F.lit(n).alias("reviewer"), reviews.issue_array(F.col(f"items_{k}"), F.lit(n), F.col("valid_ids")).alias("issues")) for k, n in enumerate(names)]
        told = told.select("doc_id", F.array(*each).cast(f"array<struct<reviewer:string,issues:{issues_type}>>").alias("each"))
        told = told.withColumn("ok", F.filter("each", lambda x: x["issues"].isNotNull()))
        met = F.transform("each", lambda x: F.struct(x["reviewer"], F.when(x["issues"].isNotNull(), "success").otherwise("failed")))
        answered = F.size("ok") > 0
        return told.select("doc_id", F.when(answered, F.map_from_entries("ok")).alias("reviews"), (~answered).alias("failed"), F.when(answered, F.map_from_entries(met)).alias("health"))

    def provide(turn: int, active: DataFrame) -> DataFrame:
        pages = active.select("doc_id", X.clip(F.col("html")).alias("html"), elements.valid_ids(F.col("html")).alias("valid_ids"))
        if ledger or partitions:
            return judged(one_by_one(turn, pages))
        texts = ask(F.array(*map(F.lit, names)), "html")["text"]
        return materialize(judged(pages.select("doc_id", "valid_ids", texts.alias("texts"))), "reviewer-answers")

    return provide


def alt_judge(answer: Callable[[str, str, str], str], retries: int = 0) -> Callable[[DataFrame], DataFrame]:
    """Provider for the judge: (issue, suggested fix, current alternative text) to a JSON answer."""

    @arrow_function("string")
    def ask(issue: pd.Series, fix: pd.Series, alt: pd.Series) -> pd.Series:
        return pd.Series([called(answer, i or "", f or "", a or "", retries=retries) for i, f, a in zip(issue, fix, alt)], dtype=object)

    def provide(rows: DataFrame) -> DataFrame:
        return rows.withColumn("answer", reviews.model_json(ask("issue", "suggested_fix", "el_alt")).cast(model.MODEL_ANSWER))

    return provide


def alt_text_provider(describe: Callable[[bytes, str], str], confidence: float = 0.9) -> Callable[[DataFrame], DataFrame]:
    """Provider for images: (data, context) to a description."""

    @arrow_function("string")
    def ask(data: pd.Series, context: pd.Series) -> pd.Series:
        return pd.Series([called(describe, d, c or "", retries=0) for d, c in zip(data, context)], dtype=object)

    def provide(images: DataFrame) -> DataFrame:
        said = images.withColumn("_said", ask("data", "context"))
        ok = F.col("_said").isNotNull()
        return said.withColumn(
            "answer",
            F.struct(
                F.col("_said").alias("alt_text"), F.when(ok, X.needs_long_description(F.col("_said"))).alias("requires_long_desc"), F.when(ok, F.lit(confidence)).otherwise(0.0).alias("confidence"),
                ok.alias("success"), F.when(~ok, "description failed").alias("error"),
            ),
        ).drop("_said")

    return provide


def ocr_provider(read: Callable[[bytes, str], str]) -> Callable[[DataFrame], DataFrame]:
    """Provider for PDFs: (content, name) to Markdown; null where it fails."""

    @arrow_function("string")
    def ask(content: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([called(read, c, p.rsplit("/", 1)[-1], retries=0) for c, p in zip(content, path)], dtype=object)

    return lambda files: files.withColumn("markdown", ask("content", "path"))
