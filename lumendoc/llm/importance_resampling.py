"""Importance resampling of documents towards a target distribution.

Features are the words of a text (A-Z lower-cased; runs of digits, letters and
characters beyond ASCII), repeats counted, in ``BUCKETS`` buckets by the CRC-32
of their UTF-8 bytes.  A bucket's gain is the rounded-down log ratio of its
smoothed share in the target and in the documents; a document's weight is the
sum of its words' gains, looked up in one array.  Gumbel noise that depends on
the seed and the doc_id alone turns "the highest scores" into a weighted draw
without replacement.

The draw is an external merge.  Where the scores lie, every task sorts its
eligible rows into runs and cuts them at common splitters (approximate
quantiles of the score around the part that is drawn); the runs are written to
the shared folder.  Counts of the ranges give each range's first rank.  Then one
task a range merges its segments of all runs by a tournament tree, and stops
after the exact number of rows that the draw still takes.  Ranges that the draw
does not reach are not read.

A range holds some ``RANGE_ROWS`` rows, or beyond ``MOST_RANGES`` ranges the
draw's share of them.  Rows that are equal in id, score and weight are one entry
with a count, so a repeated document gathers nowhere.

Cases: a null or empty text has no features and weight 0; a null doc_id counts
as empty in the noise and comes last among ties; rows that repeat a doc_id are
each a candidate of their own; fewer than ``100 / percent`` eligible documents:
nothing is drawn; an empty target: its counts are 0; an empty table: no rows;
texts of any length are read in stretches; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .tokens import STRETCH, _bytes_of, row_groups

BUCKETS, SCALE = 10_000, 1000
MIN_WORDS, PERCENT, SEED = 20, 10, 2024
#: Words of more bytes are hashed one by one.
LONG_WORD = 32
#: Rows of a sorted run, and of a range that one task merges.
RUN_ROWS, RANGE_ROWS, MOST_RANGES = 1 << 20, 1 << 12, 1024
#: The rank of a splitter is off by at most one in so many of the rows.
ACCURACY = 50_000

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: Bytes of a word, after lower-casing.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (x & np.uint32(1)))
    return x


_CRC = _crc_table()


def word_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every word of all texts in order, where each text's words begin and the last's end)."""
    raw, rows = _bytes_of(texts)
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[rows[:-1]] = True
    found, places = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    start = 0
    while start < len(raw):
        end = min(start + STRETCH, len(raw))
        while end < len(raw) and not begins[end] and _WORD[_lower[raw[end]]]:  # a word is not cut
            end += 1
        part = _lower[raw[start:end]]
        word = _WORD[part]
        first = np.flatnonzero(word & np.concatenate([[True], ~word[:-1] | begins[start + 1 : end]]))
        last = np.flatnonzero(word & np.concatenate([~word[1:] | begins[start + 1 : end], [True]]))
        n = last - first + 1
        crc = np.full(len(first), 0xFFFFFFFF, np.uint32)
        for k in range(min(LONG_WORD, int(n.max(initial=0)))):
            on = np.flatnonzero(n > k) if k else slice(None)
            now = crc[on]
            crc[on] = _CRC[(now ^ part[first[on] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        crc = ~crc
        for k in np.flatnonzero(n > LONG_WORD):
            crc[k] = zlib.crc32(part[first[k] : last[k] + 1].tobytes())
        found.append(crc % np.uint32(buckets))
        places.append(first + start)
        start = end
    return np.concatenate(found), np.searchsorted(np.concatenate(places), rows)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket over all texts; every task counts its own, so ``buckets`` numbers a task are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for group in row_groups(batch, "text"):
                n += np.bincount(word_buckets(group.column(0), buckets)[0], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a fixed number
        out[r[0]] = r[1]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rounded-down log ratios of the buckets' smoothed shares."""
    b, s_all, t_all = float(len(source)), float(source.sum()), float(target.sum())
    ratio = lambda s, t: (float(t) + 1) * (s_all + b) / ((float(s) + 1) * (t_all + b))
    return np.array([math.floor(SCALE * math.log(ratio(s, t))) for s, t in zip(source, target)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, by the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scores(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight and score of every document; written once."""
    sent = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, buckets), bucket_counts(target, buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in row_groups(batch, "text"):
                found, at = word_buckets(group.column(1), buckets)
                sums = np.concatenate([[0], np.cumsum(sent.value[found])])
                yield pa.RecordBatch.from_arrays([group.column(0), pa.array(np.diff(at)), pa.array(sums[at[1:]] - sums[at[:-1]])], names=["doc_id", "n_features", "weight"])

    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_features long, weight long")
    return materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resampling-scores")


# --- the draw ---------------------------------------------------------------

#: An entry of a run: what it is sorted by, then how often it stands there.
ENTRY = ("score", "doc_id", "n_features", "weight", "times")
END = ((math.inf,),)


def _key(score: int, doc: int | None, n: int, weight: int) -> tuple:
    return (-score, doc is None, doc or 0, n, weight)


def tournament(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted lists: inner nodes of a tree keep the loser of their match,
    so after each winner its next entry plays only those on its way up."""
    k = 1 << max(0, (len(runs) - 1).bit_length())
    streams = [iter(r) for r in runs] + [iter(())] * (k - len(runs))
    head = [next(s, END) for s in streams]
    won, lost = list(range(-k, k)), [0] * k  # won: the lists that won below each node
    for node in range(k - 1, 0, -1):
        a, b = won[2 * node], won[2 * node + 1]
        won[node], lost[node] = (a, b) if head[a] <= head[b] else (b, a)
    best = won[1] if k > 1 else 0
    while head[best] is not END:
        yield head[best]
        head[best] = next(streams[best], END)
        node = (best + k) // 2
        while node:
            if head[lost[node]] < head[best]:
                lost[node], best = best, lost[node]
            node //= 2


def sorted_runs(eligible: DataFrame, splitters: list[int], run_rows: int = RUN_ROWS) -> DataFrame:
    """range and the arrays of ``ENTRY``: each task's rows as sorted runs, cut at the splitters (descending); written once."""
    cuts = -np.array(splitters, np.int64)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(rows: pa.Table) -> pa.RecordBatch:
            group = rows.group_by(["score", "doc_id", "n_features", "weight"]).aggregate([([], "count_all")]).rename_columns(list(ENTRY))
            group = group.sort_by([("score", "descending"), ("doc_id", "ascending"), ("n_features", "ascending"), ("weight", "ascending")])  # null ids last
            which = np.searchsorted(cuts, -group.column("score").to_numpy())  # splitters above the score
            at = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            ends = pa.array(np.append(at, len(which)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, group.column(c).combine_chunks()) for c in ENTRY]
            return pa.RecordBatch.from_arrays([pa.array(which[at], pa.int32()), *lists], names=["range", *ENTRY])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= run_rows:
                yield run(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield run(pa.Table.from_batches(held))

    runs = eligible.select(*ENTRY[:-1]).mapInArrow(sort, "range int, " + ", ".join(f"{c} array<bigint>" for c in ENTRY))
    return materialize(runs, "resampling-runs")


def draw(scored: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``scored`` with ``rank``: 1 and on for the drawn, null for the others."""
    fit = scored.where(F.col("n_features") >= min_words)
    n = fit.count()
    take = percent * n // 100
    if not take:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    ranges = max(1, min(MOST_RANGES, math.ceil(take / range_rows)))
    # the last one lies below the draw, whatever the quantiles are off by
    quantiles = [1 - take / n * k / ranges for k in range(1, ranges)] + [max(0.0, 1 - take / n - 3 / ACCURACY)]
    near = fit.agg(F.percentile_approx("score", quantiles, ACCURACY)).first()[0]
    splitters = sorted(set(near), reverse=True)
    runs = sorted_runs(fit.where(F.col("score") >= splitters[-1]) if quantiles[-1] else fit, splitters, run_rows)
    sizes = {r[0]: r[1] for r in runs.select("range", F.explode("times").alias("t")).groupBy("range").agg(F.sum("t")).collect()}  # MOST_RANGES and one
    left, first, starts = take, 1, {}
    for k in sorted(sizes):
        if left > 0:
            starts[k] = (first, min(left, sizes[k]))
            first, left = first + sizes[k], left - sizes[k]
    last = max(starts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, segments = None, []
        for batch in batches:
            for row in batch.to_pylist():
                which = row["range"]
                segments.append([(_key(*x[:-1]), x) for x in zip(*(row[c] for c in ENTRY))])
        if which is None:
            return
        rank, room = starts[which]
        drawn, over, entries = [], [], tournament(segments)
        for _, x in entries:
            some = min(x[-1], room)
            drawn.append((*x[:-1], rank, some))
            if some < x[-1]:
                over.append((*x[:-1], None, x[-1] - some))
            rank, room = rank + some, room - some
            if not room:
                break
        rest = [(*x[:-1], None, x[-1]) for _, x in entries]  # of the last range, undrawn
        cols = list(zip(*(drawn + over + rest)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["score", "doc_id", "n_features", "weight", "first", "times"])

    merged = runs.where(F.col("range") <= last).repartitionById(last + 1, F.col("range")).mapInArrow(merge, "score long, doc_id long, n_features long, weight long, first long, times long")
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("nth")
    told = merged.select("doc_id", "n_features", "weight", "score", "first", nth).withColumn("rank", F.col("first") + F.col("nth")).drop("first", "nth")
    below = F.col("n_features") < min_words
    if last < len(splitters):
        below = below | (F.col("score") < splitters[last])
    return told.unionByName(scored.where(below).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED, **how) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank."""
    return draw(scores(docs, target, buckets=buckets, seed=seed), percent=percent, min_words=min_words, **how)


def resample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` drawn towards the words of ``benchmark``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


RESAMPLE_SQL = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
words AS (SELECT word FROM dw UNION SELECT word FROM b),
hashed AS (SELECT word, xor(list_reduce(list_transform(range(octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::bigint),
           lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295) % {BUCKETS} AS bucket FROM words, crc),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor({SCALE} * ln((coalesce(t, 0) + 1)::double * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::double
         / ((coalesce(s, 0) + 1)::double * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::double)))::bigint AS gain FROM s FULL JOIN t USING (bucket)),
weight AS (SELECT doc_id, sum(n * gain)::bigint AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w)::bigint AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-{SCALE} * ln(-ln((('0x' || left(sha256('{SEED}:' || doc_id), 8))::bigint + 0.5::double) / 4294967296)))::bigint AS score FROM d LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS k, (SELECT count(*) FROM scored WHERE n_features >= {MIN_WORDS}) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND k <= {PERCENT} * n // 100 THEN k END AS rank FROM ranked"""
