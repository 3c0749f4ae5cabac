"""Repeated passages, found as near-equal paragraphs by banded MinHash.

Paragraphs of a text are (a) its lines of ``MIN_WORDS`` words and more, and (b)
blocks of ``BLOCK`` words whose places depend on the words alone, so that
neither line breaks nor what stands before and after hides a passage: of every
run of ``PASSAGE`` words, the block with the least hash is one.  Two equal runs
of ``PASSAGE`` words anywhere thus hold an equal block.

Paragraphs are compared by the sets of their distinct 5-word shingles, and two
match when the Jaccard similarity is at least 0.8.  Paragraphs of equal words
are one class from the start.  Bands and rows of the MinHash are tuned: of all
with at most ``MOST_BANDS`` bands that find a pair at the threshold with
``RECALL`` probability, the ones that let through the fewest pairs below it.
Blocks, of which there are many, go into the first ``BLOCK_BANDS`` of the bands:
equal ones are a class already, and of unequal ones only those that differ in
an outermost word reach 0.8 (15 of 17 shingles), which these bands find with a
probability of 0.97.
Classes that collide in a band come into one cluster; in each, the exact
similarity decides, and the components of the matches are the repeated
passages.  The first paragraph of a component, by (doc_id, start), stays and the
others are removals; those of one document that go on together are merged.

Collisions meet as one packed entry a stretch and key (see ``collisions``), so
a passage that a third of all documents hold gathers nowhere; clusters are
verified in bundles, large ones in blocks (see ``jaccard_join``).

Cases: null text counts as empty; passages of fewer than ``PASSAGE`` words are
found if they are lines of ``MIN_WORDS`` words, else perhaps; paragraphs of one
document match each other as those of two do; rows that repeat both doc_id and
text are one document; of rows that repeat a
doc_id with other texts each has its own paragraphs, whose places bear that
doc_id; a null doc_id takes no part; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .collisions import HELD_KEYS, pack, part_of, parts_for, runs, unpack
from .common import WORD, materialize, table
from .components import connected_components
from .jaccard_join import CLUSTER_MEMBERS, CLUSTER_SETS, link_sets, verified_links
from .tokens import LONG, U, _bytes_of, _powers, digest, join2, mix, row_groups, word_hashes

MIN_WORDS, BLOCK, PASSAGE = 20, 20, 50
SIZE, PERCENT = 5, 80
RECALL, MOST_BANDS, BLOCK_BANDS = 0.99, 10, 4
#: Of clusters of so many paragraphs all pairs are looked at.
SMALL_CLUSTER = 16
#: Rows of a plan (some 50 bytes each) that are broadcast.
FEW_ROWS = 1 << 17
#: Text bytes that are cut into paragraphs at once.
GROUP_BYTES = 2 << 20


def tune(threshold: float, recall: float = RECALL, most_bands: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): recall at the threshold is reached, and the mean chance of pairs below it is least."""
    grid = np.linspace(0, threshold, 200)
    found = []
    for rows in range(1, 13):
        for bands in range(1, most_bands + 1):
            chance = lambda s, b=bands, r=rows: 1 - (1 - s**r) ** b
            if chance(threshold) >= recall:
                found.append((float(chance(grid).mean()), bands, rows))
                break
    return min(found)[1:]


def band_keys(members: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of many sets at once: one row of ``bands`` keys a set; ``members`` holds the sets one after the other."""
    out = np.empty((len(starts), bands), U)
    for b in range(bands):
        key = np.full(len(starts), b, U)
        for r in range(rows):
            odd = mix(np.array([b * rows + r + 1], U)) | U(1)
            key = join2(key, np.minimum.reduceat(members * odd, starts))
        out[:, b] = key
    return out


def _slide(pick, x: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x, have = pick(x[:-have], x[have:]), 2 * have
    return pick(x[:n], x[width - have : width - have + n])


class Words:
    """The words of some texts, one after the other, and hashes of their runs."""

    def __init__(self, texts: pa.Array):
        self.hashes, self.at, self.places = word_hashes(texts, places=True)
        self.text = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        breaks = np.flatnonzero(_bytes_of(texts)[0] == 10)
        self.line = np.searchsorted(breaks, self.places)
        power, self.inverse = _powers(len(self.hashes) + 1)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(self.hashes) * power[: len(self.hashes)], dtype=U)])

    def run_hashes(self, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A hash of the ``n`` words from each start on."""
        out = mix((self.sums[starts + n] - self.sums[starts]) * self.inverse[starts] + mix(n.astype(U)))
        for k in np.flatnonzero(n > LONG):  # sums of so many can be made equal
            out[k] = digest(self.hashes[starts[k] : starts[k] + n[k]])
        return out

    def lines(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, lengths) of the lines of at least ``min_words`` words."""
        if not len(self.text):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.concatenate([[True], (self.text[1:] != self.text[:-1]) | (self.line[1:] != self.line[:-1])])
        starts = np.flatnonzero(new)
        n = np.diff(np.append(starts, len(self.text)))
        return starts[n >= min_words], n[n >= min_words]

    def blocks(self, block: int, passage: int) -> np.ndarray:
        """Starts of the blocks that are least in some run of ``passage`` words of one text."""
        if len(self.text) < passage:
            return np.zeros(0, np.int64)
        all_ = np.arange(len(self.text) - block + 1)
        h = self.run_hashes(all_, np.full(len(all_), block))
        width = passage - block + 1
        least = _slide(np.minimum, h, width)
        least[self.text[: len(least)] != self.text[passage - 1 :]] = 0  # no run of one text
        edge = np.zeros(width - 1, U)
        return np.flatnonzero((_slide(np.maximum, np.concatenate([edge, least, edge]), width) == h) & (h != 0))

    def paragraphs(self, min_words: int, block: int, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, lengths, classes): the class is a hash of the words."""
        lines, n = self.lines(min_words)
        blocks = np.setdiff1d(self.blocks(block, passage), lines[n == block])
        starts, n = np.concatenate([lines, blocks]), np.concatenate([n, np.full(len(blocks), block)])
        return starts, n, self.run_hashes(starts, n)

    def shingle_sets(self, starts: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(shingles of the runs one after the other, where each run's begin); runs have ``size`` words at least."""
        h = self.hashes[: len(self.hashes) - size + 1]
        for k in range(1, size):
            h = join2(h, self.hashes[k : len(self.hashes) - size + 1 + k])
        n = n - size + 1
        begin = np.cumsum(n) - n
        return h[np.repeat(starts - begin, n) + np.arange(int(n.sum()))], begin


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), "text")


def meetings(docs: DataFrame, min_words: int, size: int, bands: int, rows: int, block_bands: int) -> DataFrame:
    """(a, b) of classes, written once: links of classes that collide in a band, unverified, and (a, a) where a class stands in two places."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bands = min(bands, block_bands)
    per_word = 2 / (PASSAGE - BLOCK + 2) * (block_bands + 1) + 1 / (3 * min_words) * (bands + 1)
    parts = parts_for(n_bytes / 6 * per_word, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, holders, found, size_now = [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal keys, holders, found, size_now
            k, h, links = runs(np.concatenate(keys), np.concatenate(holders))
            packed = [(*x, b"", b"") for x in pack(k, h, parts)]
            if len(links):
                packed.append((-1 - TaskContext.get().partitionId() % parts, links[:, 0].tobytes(), b"", links[:, 1].tobytes(), b"", b""))
            classes, n = np.unique(np.concatenate(found), return_counts=True)
            part = part_of(classes, parts)
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                packed.append((int(part[a]), b"", b"", b"", classes[a:b][n[a:b] == 1].tobytes(), classes[a:b][n[a:b] > 1].tobytes()))
            keys, holders, found, size_now = [], [], [], 0
            cols = list(zip(*packed))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "keys", "marks", "holders", "once", "more"])

        for whole in batches:
            for batch in row_groups(whole, "text", GROUP_BYTES):
                words = Words(batch.column(0))
                starts, n, classes = words.paragraphs(min_words, BLOCK, PASSAGE)
                if not len(starts):
                    continue
                found.append(classes)
                own, first = np.unique(classes, return_index=True)
                is_block = n[first] == BLOCK
                for some, most in ((is_block, block_bands), (~is_block, bands)):
                    if some.any():
                        keys.append(band_keys(*words.shingle_sets(starts[first[some]], n[first[some]], size), most, rows).reshape(-1))
                        holders.append(np.repeat(own[some].view(np.int64), most))
                        size_now += len(keys[-1])
                size_now += len(classes)
                if size_now >= HELD_KEYS:
                    yield out()
        if found:
            yield out()

    def meet(rows: pa.Table) -> pa.Table:
        col = lambda c: rows.column(c).to_pylist()
        if rows.column("part")[0].as_py() < 0:
            a, b = (np.frombuffer(b"".join(col(c)), np.int64) for c in ("keys", "holders"))
        else:
            links = runs(*unpack(zip(col("keys"), col("marks"), col("holders"))))[2]
            more = np.frombuffer(b"".join(col("more")), np.int64)
            classes, n = np.unique(np.concatenate([np.frombuffer(b"".join(col("once")), np.int64), more, more]), return_counts=True)
            again = classes[n > 1]
            a, b = np.concatenate([links[:, 0], again]), np.concatenate([links[:, 1], again])
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    packed = _texts(docs).select("text").mapInArrow(ship, "part int, keys binary, marks binary, holders binary, once binary, more binary")
    return materialize(packed.groupBy("part").applyInArrow(meet, "a long, b long"), "paragraph-meetings")


def places(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """h, doc, start, n_words of every paragraph whose class is wanted (one column, h); written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_groups(whole, "text", GROUP_BYTES):
                words = Words(batch.column(1))
                starts, n, classes = words.paragraphs(min_words, BLOCK, PASSAGE)
                text = words.text[starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(classes.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(starts - words.at[text]), pa.array(n)], names=["h", "doc", "start", "n_words"]
                )

    found = _texts(docs).mapInArrow(run, "h long, doc long, start long, n_words long")
    return materialize(found.join(wanted, "h"), "paragraph-places")


def paragraph_texts(docs: DataFrame, first: DataFrame):
    """A function that adds the texts to a plan's rows (by rep, a class); first: one place a class (rep, doc, start, n_words).

    A plan of at most ``FEW_ROWS`` rows, as of large clusters' blocks, is
    broadcast; for more, documents are found by sort-merge, as most of them
    then hold a paragraph that collides with another.
    """
    plan_type = "rep long, cluster long, bundle long, known long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for batch in batches:
            for group in row_groups(batch, "text", GROUP_BYTES):
                texts, lists = group.column(0).to_pylist(), group.column(1)
                want = pa.RecordBatch.from_struct_array(lists.flatten())
                text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
                words = Words(group.column(0))
                start, n = want.column("start").to_numpy(), want.column("n_words").to_numpy()
                fits = start + n <= np.diff(words.at)[text]
                hashes = words.run_hashes((words.at[text] + start)[fits], n[fits]).view(np.int64)
                fits[fits] = hashes == want.column("rep").to_numpy()[fits]  # else another row's of this doc_id
                at, found, last = np.flatnonzero(fits), [], -1
                for k in at.tolist():
                    if text[k] != last:
                        last, own = text[k], word.findall(texts[text[k]])
                    found.append(" ".join(own[start[k] : start[k] + n[k]]))
                own = want.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("rep", "cluster", "bundle", "known")), pa.array(found, pa.string())], names=["rep", "cluster", "bundle", "known", "text"])

    def add(plan: DataFrame) -> DataFrame:
        placed = plan.select("rep", "cluster", F.col("bundle").cast("long").alias("bundle"), "known").join(first, "rep")
        want = placed.groupBy("doc").agg(F.collect_list(F.struct("rep", "cluster", "bundle", "known", "start", "n_words")).alias("want"), F.count(F.lit(1)).alias("n"))
        want = materialize(want, "wanted-paragraphs")
        few = want.agg(F.sum("n")).first()[0] or 0
        want = want.select("doc", "want")
        at = _texts(docs).join(F.broadcast(want), "doc") if few <= FEW_ROWS else _texts(docs).hint("merge").join(want, "doc")
        return at.select("text", "want").mapInArrow(run, f"{plan_type}, text string")

    return add


def pair_joiner(percent: int, size: int):
    """Links (rep, root) of a bundle's paragraphs: every pair of a small cluster
    by its exact similarity, all pairs at once; large clusters as in ``jaccard_join``."""

    def run(rows: pa.Table) -> pa.Table:
        words = Words(rows.column("text").combine_chunks())
        reps, cluster, known = (rows.column(c).to_numpy() for c in ("rep", "cluster", "known"))
        n = np.diff(words.at)
        members, _ = words.shingle_sets(words.at[:-1], n, size)
        owner = np.repeat(np.arange(len(n)), n - size + 1)
        own, first = np.unique(mix(members ^ mix(owner.astype(U) + U(1))), return_index=True)  # (owner, shingle) once each
        by_owner = np.lexsort((members[first], owner[first]))
        members, owner = members[first][by_owner], owner[first][by_owner]
        sizes = np.bincount(owner, minlength=len(n))
        begin = np.cumsum(sizes) - sizes

        order = np.lexsort((reps, cluster))
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(cluster[order]) != 0, [True]]))
        count = np.diff(cuts)
        out = [np.zeros((0, 2), np.int64)]
        for k in range(2, SMALL_CLUSTER + 1):
            groups = order[cuts[:-1][count == k][:, None] + np.arange(k)]
            for some in np.array_split(groups, max(1, len(groups) * k * k // 200_000)):
                i, j = (some[:, x].reshape(-1) for x in np.triu_indices(k, 1))
                pair = np.repeat(np.arange(len(i)), sizes[i])
                at = np.repeat(begin[i] - (np.cumsum(sizes[i]) - sizes[i]), sizes[i]) + np.arange(len(pair))
                asked = mix(members[at] ^ mix(j[pair].astype(U) + U(1)))
                hit = own[np.minimum(np.searchsorted(own, asked), len(own) - 1)] == asked
                shared = np.bincount(pair[hit], minlength=len(i))
                alike = 100 * shared >= percent * (sizes[i] + sizes[j] - shared)
                out.append(np.stack([reps[i[alike]], reps[j[alike]]], 1))
        for a, b in zip(cuts[:-1][count > SMALL_CLUSTER], cuts[1:][count > SMALL_CLUSTER]):
            group = order[a:b]
            labels = known[group].tolist() if (known[group] >= 0).all() else None
            root = link_sets([members[begin[k] : begin[k] + sizes[k]] for k in group], percent, labels)
            out.append(np.stack([reps[group], reps[group[root]]], 1))
        links = np.concatenate(out)
        links = links[links[:, 0] != links[:, 1]]
        return pa.table({"rep": pa.array(links[:, 0]), "root": pa.array(links[:, 1])})

    return run


def repeated(
    docs: DataFrame,
    *,
    min_words: int = MIN_WORDS,
    size: int = SIZE,
    percent: int = PERCENT,
    recall: float = RECALL,
    most_bands: int = MOST_BANDS,
    block_bands: int = BLOCK_BANDS,
    cluster_sets: int = CLUSTER_SETS,
    cluster_members: int = CLUSTER_MEMBERS,
) -> DataFrame:
    """Every paragraph of a component that has two which do not overlap: doc_id,
    start, n_words (words counted from 0 over the whole text), the component's
    first paragraph as keep_doc_id and keep_start, copies (paragraphs of the
    component), removed (all but the first and what overlaps it)."""
    if min_words < size:
        raise ValueError("a paragraph has at least one whole shingle")
    met = meetings(docs, min_words, size, *tune(percent / 100, recall, most_bands), block_bands)
    clusters = materialize(connected_components(met.where("a <> b")), "paragraph-clusters")
    wanted = materialize(met.where("a = b").select(F.col("a").alias("h")).unionByName(clusters.select(F.col("node").alias("h"))).distinct(), "wanted-classes")
    found = places(docs, wanted, min_words)
    place = F.struct("doc", "start", "n_words")
    classes = materialize(found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")), "paragraph-classes")

    at = clusters.join(classes, clusters["node"] == classes["h"])
    members = materialize(at.select(F.col("h").alias("rep"), F.col("component").alias("cluster"), F.col("first.n_words").alias("n_shingles"), "first.*"), "paragraph-members")
    with_texts = paragraph_texts(docs, members.select("rep", "doc", "start", "n_words"))
    links = verified_links(with_texts, members.select("rep", "cluster", "n_shingles"), percent, size, cluster_sets, cluster_members, pair_joiner(percent, size))
    comps = materialize(connected_components(links), "paragraph-components")

    labels = classes.join(comps, classes["h"] == comps["node"], "left").select("h", F.coalesce("component", "h").alias("label"), "first", "last", "n")
    labels = materialize(labels, "paragraph-labels")
    groups = labels.groupBy("label").agg(F.min("first").alias("keep"), F.max("last").alias("last"), F.sum("n").alias("copies"))
    # blocks of one document that overlap are alike, but no copies
    groups = materialize(groups.where("last.doc <> keep.doc OR last.start >= keep.start + keep.n_words").select("label", "keep", "copies"), "paragraph-groups")
    marked = materialize(labels.select("h", "label").join(groups, "label").select("h", "keep", "copies"), "repeated-classes")
    out = found.join(marked, "h")
    apart = (F.col("doc") != F.col("keep.doc")) | (F.col("start") >= F.col("keep.start") + F.col("keep.n_words"))
    return out.select(F.col("doc").alias("doc_id"), "start", "n_words", F.col("keep.doc").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), "copies", apart.alias("removed"))


def passages(docs: DataFrame, **how) -> DataFrame:
    """As ``repeated``, with paragraphs of one document merged that overlap or
    touch and whose first places go on alike; copies is the most of one of them."""
    rows = repeated(docs, **how).withColumn("shift", F.col("keep_start") - F.col("start")).withColumn("end", F.col("start") + F.col("n_words"))
    same = ["doc_id", "keep_doc_id", "shift", "removed"]
    order = Window.partitionBy(*same).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = rows.groupBy(*same, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("copies").alias("copies"))
    return merged.select("doc_id", "start", (F.col("end") - F.col("start")).alias("n_words"), "keep_doc_id", (F.col("start") + F.col("shift")).alias("keep_start"), "copies", "removed")


def removals(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the removed passages cut out of the texts, each word with
    the white space after it, and n_removed, the words that went; documents
    without removals stay as they are."""

    @F.pandas_udf("struct<text string, n long>")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        word = re.compile(WORD)
        out = []
        for text, ranges in zip(texts, gone):
            starts = [m.start() for m in word.finditer(text)] + [len(text)]
            left, n, at = [text[: starts[0]]], 0, 0
            for a, b in sorted((r["start"], r["end"]) for r in ranges):
                left.append(text[starts[at] : starts[max(a, at)]])
                n += max(b - max(a, at), 0)
                at = max(at, b)
            out.append(("".join(left) + text[starts[at] :], n))
        return pd.DataFrame(out, columns=["text", "n"])

    gone = passages(docs, **how).where("removed").groupBy("doc_id").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n_words")).alias("end"))).alias("gone"))
    gone = materialize(gone, "removed-passages").withColumnRenamed("doc_id", "gone_id")
    at = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left")
    hit = gone["gone"].isNotNull() & docs["text"].isNotNull()
    own = [docs[c] for c in docs.columns if c not in ("text", "n_removed")]
    touched = at.where(hit).select(*own, cut(docs["text"], gone["gone"]).alias("cut text")).select(*(c for c in docs.columns if c not in ("text", "n_removed")), F.col("cut text.text").alias("text"), F.col("cut text.n").alias("n_removed"))
    return at.where(~hit).select(*own, docs["text"], F.lit(0).cast("long").alias("n_removed")).unionByName(touched)


def repeats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages that stand in two places of ``documents`` or more."""
    return passages(table(spark, sf_dir, "documents"))
