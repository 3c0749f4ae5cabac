"""Language-model scoring with a log-frequency Bloom filter.

Training counts words and pairs of neighbouring words over all training
documents.  A count c is quantised to the level ``1 + floor(log c / log
RATIO)``, and an n-gram of level q is put into a Bloom filter q times, as
(n-gram, 1) to (n-gram, q).  A count is read back by probing levels 1, 2, ...
until one is missing; the level's mean count stands for it.  The filter is cut
into parts by the n-gram's hash.  Each part is made by one task from its own
n-grams and sized by its own entries (``BITS`` bits an entry), so nothing has
to be known beforehand and the filter grows with the corpus.

Scores are log10 probabilities of the text and its end,
``p(w | v) = (1 - weight) * p1(w) + weight * c(v, w) / c(v)``, with p1 the
add-0.1 estimate and all counts read from the filter.  Every pair of training
is stored, those seen once too, which are most of them.  The weight is learned
from all pairs of training (``pair_weight``).  Workers get the filter
by broadcast, a slice of parts of at most ``SLICE_BYTES`` at a time: below that
size one pass scores everything, above it each slice has a pass of its own over
the pairs that fall in it, and the passes' sums are added.

The base score needs exact counts.  The counts of at most ``TOP``
most frequent words (16 bytes each, so a proven bound) are broadcast; the other words of a document
are joined with the count table by a shuffle, where no such word is frequent.

Map-side, an Arrow batch is reduced to its distinct n-grams with numpy and
shipped as one packed row a part, which is what keeps the shuffle small.

Cases: null or empty text is scored for its end alone; a null doc_id's
remainder is that of the empty string; repeated doc_ids are scored row by row;
without training documents all counts are 0 (N = V = 0 and the base
probability of every token is 1); texts of any length are read whole; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .tokens import U, join2, mix, row_groups, word_hashes

#: Hash of the end of a text, also the context of its first word.
END = U(0x5851F42D4C957F2D)
RATIO = 1.5
BITS, PROBES = 8, 4
#: Bounds of the pairs' weight, so that neither words nor pairs ever go unheard.
LEAST_WEIGHT, MOST_WEIGHT = 0.1, 0.9
TOP = 1 << 18
SLICE_BYTES = 80 << 20
#: Text bytes a part of the filter is made from, on the average; most parts.
PART_BYTES, MOST_PARTS = 8 << 20, 1 << 14
LEVELS = 128
#: Pairs a task holds, summed by stretches of text, before it ships them.
HELD = 1_000_000

_steps = np.power(RATIO, np.arange(LEVELS))
#: Mean count of a level (index 0: not in the filter).
LEVEL_COUNTS = np.concatenate([[0.0], (np.ceil(_steps - 1e-9) + np.maximum(np.ceil(_steps - 1e-9), np.ceil(_steps * RATIO - 1e-9) - 1)) / 2])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_steps - 1e-9, counts, "right").astype(np.int64)


def held_out(doc_id) -> object:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end after each, and the texts' offsets."""
    words, at = word_hashes(texts)
    n = len(at) - 1
    ends = at[1:] + np.arange(n)
    out = np.empty(len(words) + n, U)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[ends] = True
    out[is_end] = END
    out[~is_end] = words
    return out, np.concatenate([[0], ends + 1])


def pairs_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair hashes, contexts): each token with the one before; a text's first comes after END, as texts follow each other."""
    context = np.concatenate([[END], tokens[:-1]]) if len(tokens) else tokens
    return join2(context, tokens), context


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts are equal ranges of the hash's upper 32 bits."""
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _positions(h: np.ndarray, level: int, k: int, sizes: np.ndarray) -> np.ndarray:
    x = mix(h + U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return (x + U(k) * (mix(x) | U(1))) % sizes


class Filter:
    """Parts ``first`` to ``last`` of a log-frequency filter, for probing."""

    def __init__(self, data: bytes, sizes: np.ndarray, first: int, parts: int):
        """data: the parts' bytes one after the other; sizes: how many bytes each has."""
        self.first, self.last, self.parts = first, first + len(sizes), parts
        self.sizes = sizes.astype(np.int64) * 8
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(data, np.uint8)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Counts of n-grams, all of which fall in these parts."""
        part = part_of(h, self.parts) - self.first
        start, size = self.starts[part].astype(U), self.sizes[part].astype(U)
        levels = np.zeros(len(h), np.int64)
        live = np.flatnonzero(size > 0)
        for level in range(1, LEVELS + 1):
            for k in range(PROBES):
                at = start[live] + _positions(h[live], level, k, size[live])
                live = live[(self.data[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1]
            if not len(live):
                break
            levels[live] = level
        return LEVEL_COUNTS[levels]


def make_bits(h: np.ndarray, counts: np.ndarray) -> bytes:
    """The bits of one part from its distinct n-grams."""
    levels = level_of(counts)
    size = 64 * math.ceil(BITS * int(levels.sum()) / 64)
    bits = np.zeros(size, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        h = h[levels >= level]
        levels = levels[levels >= level]
        for k in range(PROBES):
            bits[_positions(h, level, k, U(size)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def pair_weight(once: int, twice: int, distinct: int, total: int) -> float:
    """The pairs' share of a probability, from how many distinct pairs there are, and how many stand once and twice.

    Leaving one out, a pair's count is too high by ``once / (once + 2 * twice)``
    on the average (Ney, Essen and Kneser 1994); what all distinct pairs give
    up by that, as a share of all pairs, goes to the single words.
    """
    discount = once / (once + 2 * twice) if once else 0.0
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 - discount * distinct / max(total, 1)))


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[new], np.add.reduceat(n, new) if len(new) else n


def count_ngrams(train: DataFrame, parts: int) -> DataFrame:
    """Exact word counts (rows of h, c) and both filters' parts (rows of part, words, pairs, and figures of its pairs), written once."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = -(-(np.arange(parts + 1, dtype=object) << 32) // parts)  # least upper half of each part
        edges = np.array([min(int(e), (1 << 32) - 1) for e in edges[:-1]], dtype=U) << U(32)

        def ship(held: list) -> pa.RecordBatch:
            packed = []
            for kind in (0, 1):
                h, n = _summed(np.concatenate([x[kind][0] for x in held]), np.concatenate([x[kind][1].astype(np.uint32) for x in held]))
                cuts = np.concatenate([np.searchsorted(h, edges), [len(h)]])
                packed.append([(h[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes()) for a, b in zip(cuts[:-1], cuts[1:])])
            words, pairs = packed
            rows = [k for k in range(parts) if words[k][0] or pairs[k][0]]
            cols = [pa.array(rows, pa.int32())] + [pa.array([x[k][i] for k in rows], pa.binary()) for x in (words, pairs) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(cols, names=["part", "wh", "wn", "ph", "pn"])

        held, size = [], 0
        for batch in batches:
            for group in row_groups(batch, "text", 2 << 20):
                tokens, _ = sequences(group.column(0))
                held.append([np.unique(x, return_counts=True) for x in (tokens, pairs_of(tokens)[0])])
                size += len(held[-1][1][0])
                if size >= HELD:
                    yield ship(held)
                    held, size = [], 0
        if held:
            yield ship(held)

    def merge(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        out = []
        for hs, ns in (("wh", "wn"), ("ph", "pn")):
            h = np.frombuffer(b"".join(rows.column(hs).to_pylist()), U)
            n = np.frombuffer(b"".join(rows.column(ns).to_pylist()), np.uint32).astype(np.int64)
            out.append(_summed(h, n))
        (h, c), (ph, pc) = out
        bits = [make_bits(h, c), make_bits(ph, pc)]
        figures = [int((pc == 1).sum()), int((pc == 2).sum()), len(pc)]
        n = len(h)
        return pa.table(
            {
                "h": pa.array(np.append(h, U(0)).view(np.int64), mask=np.arange(n + 1) == n),
                "c": pa.array(np.append(c, 0), mask=np.arange(n + 1) == n),
                "part": pa.array([None] * n + [part], pa.int32()),
                "words": pa.array([None] * n + bits[:1], pa.binary()),
                "pairs": pa.array([None] * n + bits[1:], pa.binary()),
                **{k: pa.array([None] * n + [v], pa.int64()) for k, v in zip(("once", "twice", "distinct"), figures)},
            }
        )

    packed = train.select("text").mapInArrow(partial, "part int, wh binary, wn binary, ph binary, pn binary")
    return materialize(packed.groupBy("part").applyInArrow(merge, "h long, c long, part int, words binary, pairs binary, once long, twice long, distinct long"), "ngram-counts")


def _slices(sizes: list[tuple[int, int]], parts: int, most: int) -> list[tuple[int, int]]:
    """Ranges of parts whose pair filters hold ``most`` bytes together, and one part at least."""
    size = dict(sizes)
    out, start, held = [], 0, 0
    for k in range(parts):
        if k > start and held + size.get(k, 0) > most:
            out.append((start, k))
            start, held = k, 0
        held += size.get(k, 0)
    return [*out, (start, parts)]


def _least_count(words: DataFrame, top: int) -> int:
    """A count that at most ``top`` words reach, found from how many words each level of counts has."""
    level = F.floor(F.log2("c") * 16)
    found = words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.col("level").desc()).collect()  # 16 a doubling
    least, held = (1 << 62), 0
    for r in found:
        held += r["n"]
        if held > top:
            break
        least = r["c"]
    return least


def score(docs: DataFrame, *, slice_bytes: int = SLICE_BYTES, top: int = TOP, part_bytes: int = PART_BYTES) -> DataFrame:
    """Score every row of ``docs``; see the module for the columns' meaning."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(MOST_PARTS, -(-n_bytes // part_bytes)))
    made = count_ngrams(docs.where(~F.col("held_out")), parts)
    words = made.where(F.col("part").isNull()).select("h", "c")
    total, distinct = words.agg(F.sum("c"), F.count(F.lit(1))).first()
    total = total or 0
    share = 0.1 * (distinct + 1)
    least = _least_count(words, top)
    frequent = words.where(F.col("c") >= least).toPandas()
    top_h, top_c = frequent["h"].to_numpy(np.int64), frequent["c"].to_numpy(np.int64)

    sizes = made.where(F.col("part").isNotNull()).select("part", F.octet_length("pairs"), "once", "twice", "distinct").collect()
    cuts = _slices([tuple(r)[:2] for r in sizes], parts, slice_bytes)
    weight = pair_weight(*(sum(r[k] for r in sizes) for k in ("once", "twice", "distinct")), total)

    def fetch(name: str, a: int, b: int) -> tuple[bytes, np.ndarray]:
        """A slice's bits: as large as the slice's bound allows."""
        got = {r[0]: bytes(r[1]) for r in made.where(F.col("part").between(a, b - 1)).select("part", name).toLocalIterator()}
        each = [got.pop(k, b"") for k in range(a, b)]
        return b"".join(each), np.array([len(x) for x in each])

    word_bits = spark.sparkContext.broadcast((*fetch("words", 0, parts), top_h, top_c))

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    if len(cuts) > 1:  # all passes must number the rows alike
        numbered = materialize(numbered, "lm-rows")
    passes = None
    for turn, (a, b) in enumerate(cuts):
        pair_bits = spark.sparkContext.broadcast(fetch("pairs", a, b))
        scored = numbered.mapInArrow(_scorer(word_bits, pair_bits, a, parts, total, share, weight, turn == 0), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare_h array<long>, rare_n array<int>")
        scored = materialize(scored, "lm-pass")
        pair_bits.destroy()
        passes = scored if passes is None else passes.unionByName(scored)
    word_bits.destroy()
    if len(cuts) > 1:
        passes = passes.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"), F.flatten(F.collect_list("rare_h")).alias("rare_h"), F.flatten(F.collect_list("rare_n")).alias("rare_n"))

    rare = passes.select("row", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("r")).select("row", F.col("r.rare_h").alias("h"), F.col("r.rare_n").alias("n"))
    known = rare.join(words, "h").groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * (F.log10(F.col("c") + 0.1) + 1)).alias("more"))
    out = passes.drop("rare_h", "rare_n").join(known, "row", "left")
    norm = math.log10(total + share)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), "score",
    )


def _scorer(word_bits, pair_bits, first: int, parts: int, total: int, share: float, weight: float, base_too: bool):
    """One pass: the sums over the tokens whose pair falls in this slice, and in the first pass the base.

    A word outside the broadcast counts as unseen (log10 of 0.1 is -1) and is
    listed, so that the join adds the difference.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, sizes, top_h, top_c = word_bits.value
        words = Filter(data, sizes, 0, parts)
        pairs = Filter(*pair_bits.value, first, parts)
        top_h = top_h.view(U)
        order = np.argsort(top_h)
        top_h, top_c = top_h[order], top_c[order]
        for batch in (group for whole in batches for group in row_groups(whole, "text", 1 << 20)):
            tokens, at = sequences(batch.column(batch.schema.get_field_index("text")))
            n = np.diff(at)
            kinds, which = np.unique(tokens, return_inverse=True)
            counts = words.counts(kinds)
            single = (counts + 0.1) / (total + share)
            grams, context = pairs_of(tokens)
            in_slice = np.ones(len(grams), bool) if pairs.first == 0 and pairs.last == parts else np.isin(part_of(grams, parts), np.arange(pairs.first, pairs.last))
            distinct, back = np.unique(grams[in_slice], return_inverse=True)
            both = pairs.counts(distinct)[back]
            before = np.empty(len(tokens), np.int64)
            if len(tokens):
                before[1:] = which[:-1]
                before[0] = np.searchsorted(kinds, END)
            seen = np.maximum(counts[before[in_slice]], both)
            logs = np.zeros(len(tokens))
            logs[in_slice] = np.log10((1 - weight) * single[which[in_slice]] + weight * np.divide(both, seen, out=np.zeros(len(both)), where=seen > 0))
            sums = np.add.reduceat(logs, at[:-1]) if len(n) else logs
            nulls = pa.nulls(len(n), pa.list_(pa.int64()))
            out = [batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id", "held_out")] + [pa.array(n)]
            if base_too:
                place = np.minimum(np.searchsorted(top_h, kinds), max(len(top_h) - 1, 0))
                hit = top_h[place] == kinds if len(top_h) else np.zeros(len(kinds), bool)
                kind_log = np.full(len(kinds), -1.0)
                kind_log[hit] = np.log10(top_c[place[hit]] + 0.1)
                out += [pa.array(np.add.reduceat(hit[which].astype(np.int64), at[:-1]) if len(n) else np.zeros(0, np.int64)), pa.array(np.add.reduceat(kind_log[which], at[:-1]) if len(n) else np.zeros(0)), pa.array(sums)]
                # the rest: (row, word) pairs, counted within the row
                rest = np.flatnonzero(~hit[which])
                row = np.searchsorted(at, rest, "right") - 1
                key, m = np.unique(row * np.int64(len(kinds) + 1) + which[rest], return_counts=True)
                offsets = np.searchsorted(key, np.arange(len(n) + 1) * np.int64(len(kinds) + 1))
                offsets = pa.array(offsets, pa.int32())
                out += [pa.ListArray.from_arrays(offsets, pa.array(kinds[key % (len(kinds) + 1)].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(m, pa.int32()))]
            else:
                out += [pa.array(np.zeros(len(n), np.int64)), pa.array(np.zeros(len(n))), pa.array(sums), nulls, pa.nulls(len(n), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare_h", "rare_n"])

    return run


def lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
