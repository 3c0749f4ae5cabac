"""Quality scores by Bradley-Terry ranking of document pairs.

A labelled good document is preferred to a labelled bad one.  The chance that i
is preferred to j is ``1 / (1 + exp(s_j - s_i))`` with ``s = w . x`` linear in
the features of a text, so the weights follow from logistic loss on feature
differences (Newton steps with a ridge).  Pairs: every good row of the sample
is paired with ``PAIRS`` bad ones, and every bad one with ``PAIRS`` good ones,
at fixed strides.

Threshold: the quantile of the sample's scores at the share of bad rows, taken
half way to the next score.  The reported score is the logistic function of the
distance to that threshold, moved so that the threshold is ``CUT``.

The labelled sample holds at most ``MAX_LABELLED`` rows, those with the
smallest hash of doc_id; only for them features are sent to the driver (some
100 bytes a row).  All documents are scored by built-in functions in one scan;
labels, lang, source and doc_id are no features.

Cases: null text counts as empty; empty texts get the score of their (zero)
features; labels that are null or of held-out rows are never read; a doc_id
that is labelled twice counts twice; if there are no labelled rows of either
kind, all weights are 0 and all scores are CUT, predicted 1; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, materialize, table

MAX_LABELLED = 20_000
PAIRS = 4
RIDGE = 1e-3
CUT = 0.3


def feature_columns(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    count = lambda chars: F.char_length(F.regexp_replace(t, f"[^{chars}]+", "")).cast("double")
    words = let(
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("double").alias("n"), F.size(F.array_distinct(w)).cast("double").alias("distinct")),
    )
    lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), lambda x: F.struct(F.size(x).cast("double").alias("n"), F.size(F.array_distinct(x)).cast("double").alias("distinct")))
    return {
        "words": words, "lines": lines, "wc": F.char_length(F.regexp_replace(t, SPACE, "")).cast("double"), "symbols": count("#*$%&<>"), "upper": count(r"\p{Lu}"),
        "loud": count("!"), "bars": count("|"), "digits": count("0-9"), "stops": count(".,;:?"), "letters": count(r"\p{L}"),
    }


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and an array ``x`` of the text's features."""
    raw = docs.select(*keep, F.struct(*(c.alias(k) for k, c in feature_columns(F.col("text")).items())).alias("f"))
    f = lambda k: F.col(f"f.{k}")
    per_char = lambda k: f(k) / (f("wc") + 1)
    n = f("words.n")
    return raw.select(
        *keep,
        F.array(
            F.log1p(n) / 10,
            per_char("symbols"),
            F.sqrt(per_char("symbols")),
            per_char("upper"),
            F.sqrt(per_char("upper")),
            per_char("loud"),
            F.sqrt(per_char("loud")),
            f("bars") / (n + 1),
            F.sqrt(f("bars") / (n + 1)),
            per_char("digits"),
            per_char("stops"),
            F.log((n + 1) / (f("words.distinct") + 1)),
            F.log((n + 1) / (f("words.distinct") + 1)) / (1 + F.log1p(n)),
            (f("lines.n") - f("lines.distinct")) / (f("lines.n") + 1),
            f("letters") / (n + 1) / 10,
        ).alias("x"),
    )


def learnable(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, *, most: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """(weights, threshold) from the labelled rows that may be learned from."""
    sample = labels.where(learnable(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    sample = materialize(sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled-sample")
    rows = features(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "doc_id", "quality").orderBy("doc_id").select("quality", "x").toPandas()
    if not rows["quality"].isin([0]).any() or not rows["quality"].isin([1]).any():
        width = len(rows["x"][0]) if len(rows) else 15
        return np.zeros(width), 0.0
    x, y = np.stack(rows["x"].to_numpy()), rows["quality"].to_numpy()
    scale = x.std(0) + 1e-9
    good, bad = x[y == 1] / scale, x[y == 0] / scale
    turns = [(k * 7919 + 1) for k in range(PAIRS)]
    d = np.concatenate(
        [good - bad[(np.arange(len(good)) + t) % len(bad)] for t in turns] + [good[(np.arange(len(bad)) + t) % len(good)] - bad for t in turns]
    )
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        slope = d.T @ p / len(d) - RIDGE * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w)), slope)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    w = w / scale
    s = np.sort(x @ w)
    k = int((y == 0).sum())
    return w, float((s[k - 1] + s[k]) / 2)


def score(docs: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    logit = math.log(CUT / (1 - CUT))
    x = features(docs, "doc_id")
    s = reduce(lambda a, b: a + b, (F.col("x")[k] * float(w) for k, w in enumerate(weights)))
    x = x.select("doc_id", (s - threshold).alias("over"))
    return x.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), (1 / (1 + F.exp(-(F.col("over") + logit)))).alias("score"), (F.col("over") >= 0).cast("int").alias("predicted")).select(
        "doc_id", "held_out", F.when(F.col("predicted") == 1, F.greatest("score", F.lit(CUT))).otherwise(F.least("score", F.lit(CUT - 1e-12))).alias("score"), "predicted"
    )


def classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs, table(spark, sf_dir, "labels")))
