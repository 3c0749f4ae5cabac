"""Reviewers' raw output into issues, and issues into consensus groups."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumendoc.functions.arrow import arrow_function
from lumendoc import model
from lumendoc.functions import reviews as R

FUZZY = 0.50
DEFAULTS = {"criterion": "1.3.1", "impact": "moderate", "confidence": 0.75, "fix_type": "deterministic"}
MEMBER = ("reviewer", "reviewer_pos", "issue_pos", "issue", "impact", "suggested_fix", "confidence", "fix_type", "hallucinated")


def explode_reviews(df: DataFrame, *keys: str, reviews: str = "reviews") -> DataFrame:
    """One row an issue, in the map's order; reviewers without issues give none but count in n_reviewers_all."""
    df = df.withColumn("n_reviewers_all", F.size(F.map_keys(reviews)))
    by = df.select(*keys, "n_reviewers_all", F.posexplode(reviews).alias("reviewer_pos", "reviewer", "issues"))
    return by.select(*keys, "n_reviewers_all", "reviewer_pos", "reviewer", F.posexplode("issues").alias("issue_pos", "i")).select(*keys, "n_reviewers_all", "reviewer_pos", "reviewer", "issue_pos", "i.*")


def read_reviews(spark, path: str) -> DataFrame:
    """JSON files of {reviewer: [issue, ...]}, one map a file."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return raw.select("path", F.from_json("value", model.REVIEWS).alias("reviews"))


def salvage(text: str | None):
    """The JSON value in a reviewer's answer: fences go, then the whole, then the first value; None if there is none."""
    s = (text or "").strip()
    if s.startswith("```"):
        s = re.sub(r"\n?```\Z", "", re.sub(r"\A```[A-Za-z]*\n?", "", s)).strip()
    try:
        return json.loads(s)
    except ValueError:
        at = min((k for k in (s.find("{"), s.find("[")) if k >= 0), default=-1)
        if at < 0:
            return None
        try:
            return json.JSONDecoder().raw_decode(s, at)[0]
        except ValueError:
            return None


@arrow_function("array<string>")
def _items(texts: pd.Series) -> pd.Series:
    """The issues of an answer as JSON texts (null where an item is no object); null if the answer holds no JSON."""

    def of(text):
        got = salvage(text)
        if got is None:
            return None
        if isinstance(got, dict):
            got = got.get("violations") or got.get("issues") or []
        if not isinstance(got, list):
            got = []
        return [json.dumps(x) if isinstance(x, dict) else None for x in got]

    return texts.map(of)


def model_json(text: Column) -> Column:
    """A model's answer: the text as JSON, else from its first to its last brace; null if neither reads."""
    whole = F.from_json(text, model.MODEL_ANSWER.replace("struct<", "").rstrip(">"))
    inner = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), model.MODEL_ANSWER.replace("struct<", "").rstrip(">"))
    read = lambda c: c["new_value"].isNotNull() | c["safe"].isNotNull() | c["confidence"].isNotNull() | c["reasoning"].isNotNull()
    return F.when(read(whole), whole).when(read(inner), inner)


def normalize(raw: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """raw: keys, reviewer, text, valid_ids.  Gives (issues, failures).

    An issue keeps its place in the answer; those that name no valid id, and
    items that are no objects, are dropped.  A reviewer whose answer holds no
    JSON, or an issue with a valid id and a confidence that is no number, has
    failed, with all its issues.
    """
    got = raw.withColumn("items", answer_items(F.col("text"), F.col("valid_ids")))
    rows = got.where("items IS NOT NULL").select(*keys, "reviewer", "valid_ids", F.posexplode("items").alias("issue_pos", "item"))
    rows = rows.where("item IS NOT NULL").withColumn("i", F.from_json("item", model.RAW_ISSUE))
    out = rows.select(*keys, "reviewer", "issue_pos", "valid_ids", *_fields(F.col("i"), F.col("reviewer"), F.col("issue_pos")))
    return out.where(F.array_contains("valid_ids", F.col("element_id"))).drop("valid_ids"), got.where("items IS NULL").select(*keys, "reviewer")


def _fields(i: Column, reviewer: Column, pos: Column) -> list[Column]:
    """An issue's columns from what a reviewer wrote (``RAW_ISSUE``), but for its place."""
    said = lambda *names: F.coalesce(*(F.nullif(i[n], F.lit("")) for n in names))
    flag = lambda n: F.coalesce(~F.lower(i[n]).isin("false", "0", "", "null", "[]", "{}"), F.lit(False))
    number = i["confidence"].try_cast("double")
    return [
        F.coalesce(said("issue_id"), F.concat(reviewer, F.lit("-"), pos)).alias("issue_id"),
        F.coalesce(said("wcag_criterion", "criterion"), F.lit(DEFAULTS["criterion"])).alias("wcag_criterion"),
        said("element_id", "elementId", "id").alias("element_id"),
        F.coalesce(said("issue", "description"), F.lit("")).alias("issue"),
        F.coalesce(said("impact"), F.lit(DEFAULTS["impact"])).alias("impact"),
        F.when(number.isNull() | (number == 0), F.lit(DEFAULTS["confidence"])).otherwise(number).alias("confidence"),
        F.coalesce(said("suggested_fix", "fix"), F.lit("")).alias("suggested_fix"),
        F.when(flag("requires_human_review") | flag("requires_long_desc"), "needs_human").otherwise(F.coalesce(said("fix_type"), F.lit(DEFAULTS["fix_type"]))).alias("fix_type"),
        flag("hallucinated").alias("hallucinated"),
    ]


def issue_array(items: Column, reviewer: Column, valid_ids: Column) -> Column:
    """What ``normalize`` makes of an answer's items, as an array inside the row; null if the reviewer failed."""
    read = F.transform(items, lambda x: F.from_json(x, model.RAW_ISSUE))
    told = F.transform(read, lambda i, pos: F.struct(*_fields(i, reviewer, pos)))
    return F.filter(told, lambda x: F.array_contains(valid_ids, x["element_id"]))


def answer_items(text: Column, valid_ids: Column) -> Column:
    """An answer's issues as JSON texts; null if the reviewer failed (see ``normalize``)."""
    items = _items(text)

    def bad(item: Column) -> Column:
        i = F.from_json(item, model.RAW_ISSUE)
        ident = F.coalesce(*(F.nullif(i[n], F.lit("")) for n in ("element_id", "elementId", "id")))
        said = F.lower(F.coalesce(i["confidence"], F.lit("")))
        number = F.trim(said).rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$") | said.isin("", "false", "true", "null", "[]", "{}", "nan", "inf", "infinity")
        return F.coalesce(F.array_contains(valid_ids, ident) & ~number, F.lit(False))

    return F.when(~F.exists(items, bad), items)


def health(raw: DataFrame, *keys: str) -> DataFrame:
    """Per keys: reviewers' status, and whether all of them failed."""
    valid = F.col("valid_ids") if "valid_ids" in raw.columns else F.array().cast("array<string>")
    got = raw.withColumn("ok", answer_items(F.col("text"), valid).isNotNull())
    status = F.map_from_entries(F.collect_list(F.struct("reviewer", F.when(F.col("ok"), "success").otherwise("failed"))))
    return got.groupBy(*keys).agg(status.alias("reviewer_status"), (~F.bool_or("ok")).alias("all_failed"))


def similar(a: str, b: str) -> bool:
    """Whether the ratio of matching blocks reaches FUZZY.

    Texts that differ by case only are the same, also where capitals are more
    letters ("ß"): the ratio of long ones leaves out their frequent characters.

    Two bounds of it that cost linear time come first: by the lengths, and by
    the characters that both hold, however placed.  Only texts that pass both
    have their blocks matched.
    """
    if a.lower() == b.lower() or a.upper().casefold() == b.upper().casefold():
        return True
    a, b = a.lower(), b.lower()
    matcher = difflib.SequenceMatcher(None, a, b)
    return matcher.real_quick_ratio() >= FUZZY and matcher.quick_ratio() >= FUZZY and matcher.ratio() >= FUZZY


@arrow_function("array<int>")
def _greedy(targets: pd.Series, issues: pd.Series) -> pd.Series:
    """Each member joins the first cluster whose first member is the same issue."""

    def of(ts, xs):
        heads, out = [], []
        for t, x in zip(ts, xs):
            x = x or ""
            same = (k for k, (ht, hx) in enumerate(heads) if (ht == t if ht and t else similar(hx, x)))
            k = next(same, len(heads))
            if k == len(heads):
                heads.append((t, x))
            out.append(k)
        return out

    return pd.Series([of(t, x) for t, x in zip(targets, issues)])


def consensus(issues: DataFrame, *keys: str) -> DataFrame:
    """Groups of issues that mean the same, with the agreement of their reviewers.

    Issues on one element and criterion are gathered (few, by nature) in
    reviewer and issue order.  Where all name a target attribute, the groups
    are the targets, by an expression; else the texts are compared in order.
    Null keys group together.
    """
    members = F.array_sort(F.collect_list(F.struct("reviewer_pos", "issue_pos", *(c for c in MEMBER if c not in ("reviewer_pos", "issue_pos")), "target")))
    extra = [c for c in ("n_reviewers_all",) if c in issues.columns]
    at = issues.withColumn("target", R.fix_target(F.col("suggested_fix"))).groupBy(*keys, "element_id", "wcag_criterion").agg(members.alias("m"), *(F.max(c).alias(c) for c in extra))
    targets = F.transform("m", lambda x: x["target"])
    plain = F.forall("m", lambda x: x["target"].isNotNull())
    by_target = at.where(plain).withColumn("label", F.transform("m", lambda x: (F.array_position(F.array_distinct(targets), x["target"]) - 1).cast("int")))
    by_text = at.where(~plain).withColumn("label", _greedy(targets, F.transform("m", lambda x: x["issue"])))
    all_ = by_target.unionByName(by_text).withColumn("g", F.explode(F.array_distinct("label")))
    mine = F.filter("m", lambda x, i: F.get(F.col("label"), i) == F.col("g"))
    out = all_.select(*keys, "element_id", "wcag_criterion", *extra, mine.alias("m"))
    first, each = F.get("m", 0), lambda c: F.transform("m", lambda x: x[c])
    out = out.select(
        *keys, "element_id", "wcag_criterion", *extra,
        F.struct(first["reviewer_pos"], first["issue_pos"]).alias("first_pos"),
        first["issue"].alias("issue"), first["impact"].alias("impact"), first["suggested_fix"].alias("suggested_fix"), first["target"].alias("target"),
        F.array_sort(F.array_distinct(each("reviewer"))).alias("reviewers"),
        each("confidence").alias("reviewer_confidences"), each("hallucinated").alias("hallucinated_hints"), each("fix_type").alias("fix_type_hints"),
    )
    return out.withColumn("n_reviewers", F.size("reviewers")).withColumn("confidence", R.confidence(F.col("n_reviewers")))


def group_total(groups: DataFrame, *keys: str) -> DataFrame:
    """``all_reviewers``: the reviewers of all groups, each counted in every group it is in."""
    return groups.groupBy(*keys).agg(F.sum("n_reviewers").cast("long").alias("all_reviewers"))
