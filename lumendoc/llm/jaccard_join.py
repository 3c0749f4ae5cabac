"""Near-duplicate documents by a count-vector R-tree.

A document's set holds its distinct word shingles; two documents link when
``100 * |intersection| >= percent * |union|``, and what is asked for are the
components of the links.

Index: a set's members are hashed into ``GROUPS`` groups, and the groups'
counts are a point.  Points are bulk-loaded into an R-tree.  Of two nodes, no
pair can share more members than the sum over groups of the smaller of the two
upper corners, and of two points no more than the sum of the smaller
coordinates; where that is too little for the sizes, the branch or pair is
dropped.  Surviving pairs are verified on the sets themselves.

Distribution: a single tree over all points cannot be cut into tasks by
coordinates, as hash counts of unrelated texts lie close together.  So the
points are first brought into clusters that no link leaves.  Sizes fall into
bands, a link joins sets of one band or of neighbouring ones, and within a
band's reach two linked sets differ in at most d members.  Hash space is cut
into more than d ranges.  A range counts if it holds at least q members (q
depends on the similarity asked for).  A set with more than d such ranges must
have one of them in common with any set that it links with, and both put its
key (a hash of the range's members) out, so they meet.  A set with fewer goes
on to the next rung: other hashes, then q = 1, and at last the prefix of its
members in one order for all sets, of which linked sets share a member.  Every
set puts out the keys of all rungs up to its last, so two linked sets meet at
the lower of theirs.  Nothing is lost by this for any text.

On the first rung members are left out that many documents hold (lines and
passages in wide use), as else they would bring unrelated texts together; what
is left of two sets differs in no more members than the sets do, so this loses
nothing either.  Which members those are is found on a sample of the documents
(one in ``SAMPLE_ONE_IN``, between ``SAMPLE_DOCS``); the sample decides on
speed alone, and every document is indexed.

Copies: equal sets meet by their keys like others and are then one class, of
which one is verified.  A key that many sets share is reduced to one entry in
every stretch of rows that meets it, so no task gathers a group.  Clusters of
more than ``CLUSTER_SETS`` sets or ``CLUSTER_MEMBERS`` members are cut into
blocks that all hold the cluster's first set; after that only blocks of
different components are compared, two at a time.  Texts of clusters are
shuffled once; where the rows that ask for them are at most ``PLAN_ROWS``, so
that they may be broadcast, no other text is shuffled at all.

Cases: null or empty text, or none but white space: the set is empty, links
with nothing and is its own component; with fewer words than a shingle the
whole sequence is the one member; repeated rows are equal sets; a null doc_id
has a null component and links nothing; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collisions import HELD_KEYS, pack, parts_for, runs, unpack
from .common import drop_keyed, keyed, materialize, table
from .components import connected_components
from .tokens import U, mix, row_groups, shingles, word_hashes

GROUPS = 64
LEAF = 32
CLUSTER_SETS, CLUSTER_MEMBERS = 2000, 2_000_000
#: Members that a task's bundle of small clusters holds on the average.
BUNDLE_MEMBERS = 500_000
#: Documents that a task holds before it ships them.
HELD_DOCS = 50_000
#: The sample on which frequent members are found, how often one must occur in it, and how many are used at most (1 MB).
SAMPLE_ONE_IN, SAMPLE_DOCS = 64, (1 << 12, 1 << 18)
FREQUENT, MOST_FREQUENT = 8, 1 << 17
#: Rows of a plan (32 bytes each) that are broadcast to the documents.
PLAN_ROWS = 1 << 20
#: One document, as it travels beside the keys.
DOC = np.dtype([("id", "<i8"), ("has_id", "u1"), ("n", "<i8"), ("key", "V16")])


class Cuts:
    """Bands of set sizes, and how a set's hash space is cut under each."""

    def __init__(self, percent: int):
        self.percent, self.starts, self.ranges = percent, [1], []
        self.least, self.spread = self.tune()

    def tune(self) -> tuple[int, float]:
        """(members that a counting range holds, ranges for each member that may differ).

        With members dealt to ranges by chance, the fewest ranges of which a
        tenth more than needed count.
        """
        per_differing = 1 / (self.differing(10**9, 10**9 * 100 // self.percent) / 10**9)
        least = max(1, int(per_differing / 2))
        spread = 1.0
        while spread < 2:
            mean = per_differing / spread
            few = sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(least))
            if spread * (1 - few) >= 1.1:
                break
            spread += 0.05
        return least, spread

    def reach(self, size: int) -> int:
        """The largest set that one of ``size`` can link with."""
        return size * 100 // self.percent

    def differing(self, a: int, b: int) -> int:
        """In how many members linked sets of these sizes differ at most."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.reach(self.starts[-1]) + 1)
            last = self.starts[-1] - 1
            self.ranges.append(math.ceil(self.spread * (self.differing(last, self.reach(last)) + 1)) + 1)
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def levels(self, size: int) -> list[tuple[int, int, int]]:
        """(band, ranges, most differing members) under which a set is cut: its own band, and the one below if it reaches it.

        Where nothing may differ there is no cut, as equal sets are one.
        """
        if not size:
            return []
        k = self.of(size)
        out = [(k, self.ranges[k], self.differing(size, self.reach(size)))]
        if k and size <= self.reach(self.starts[k] - 1):
            out.append((k - 1, self.ranges[k - 1], self.differing(size, self.starts[k] - 1)))
        return [x for x in out if x[2]]

    def prefix(self, size: int) -> int:
        """Of how many members, the first in an order for all sets, linked sets share one."""
        return size - -(-self.percent * size // 100) + 1


def range_keys(members: np.ndarray, cuts: Cuts, frequent: np.ndarray) -> np.ndarray:
    """The keys of a set (members sorted; frequent: members left out at first, sorted)."""
    levels = cuts.levels(len(members))
    if not levels:
        return np.zeros(0, U)
    often = np.zeros(len(members), bool)
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)] == members
    rungs = ((members[~often], cuts.least), (np.sort(mix(members ^ U(0x9E3779B97F4A7C15))), cuts.least), (np.sort(mix(members ^ U(0x3C6EF372FE94F82A))), 1))
    sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(h + U(1)), dtype=U)]) for h, _ in rungs]
    out = []
    for band, n, differing in levels:
        edges = (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(U)
        for rung, (h, least) in enumerate(rungs):
            at = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
            counts = np.flatnonzero(np.diff(at) >= least)
            out.append(mix((sums[rung][at[counts + 1]] - sums[rung][at[counts]]) ^ mix(counts.astype(U) + U((band * 8 + rung) << 32))))
            if len(counts) > differing:
                break
        else:
            first = np.concatenate([members[~often], members[often]])[: cuts.prefix(len(members))]
            out.append(mix(first ^ mix(np.array([band * 8 + 7], U))))
    return np.concatenate(out)


def frequent_members(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that many documents of a sample hold, sorted."""
    n_docs = docs.count()
    one_in = max(1, n_docs // min(max(n_docs // SAMPLE_ONE_IN, SAMPLE_DOCS[0]), SAMPLE_DOCS[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_groups(whole, "text"):
                words, at = word_hashes(batch.column(0))
                sets = [shingles(words[a:b], size) for a, b in zip(at[:-1], at[1:])]
                h, n = np.unique(np.concatenate([np.zeros(0, U), *sets]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text")
    found = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    most = found.where(F.col("n") >= FREQUENT).orderBy(F.col("n").desc(), "h").limit(MOST_FREQUENT)
    return np.sort(most.select("h").toPandas()["h"].to_numpy(np.int64).view(U))


def meetings(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Written once, from one pass over the texts: rows (a, b), links of all
    sets with an equal key, unverified; and rows doc_id, n_shingles, set_key
    (null if empty) of all documents, in which is_doc is true."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per_word = 2.2 * (1 + 100 / percent) * (100 - percent) / (100 + percent)
    parts = parts_for(n_bytes / 6 * per_word, int(spark.conf.get("spark.sql.shuffle.partitions")))
    frequent = frequent_members(docs, size)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = Cuts(percent)
        turn = TaskContext.get().partitionId()
        keys, holders, n_keys, found, same, known = [], [], 0, [], [], {}

        def out() -> pa.RecordBatch:
            nonlocal keys, holders, n_keys, found, same, known, turn
            k, h, links = runs(np.concatenate([np.zeros(0, U), *keys]), np.concatenate([np.zeros(0, np.int64), *holders]))
            rows = [(*x, None) for x in pack(k, h, parts)]
            links = np.concatenate([links, np.array(same, np.int64).reshape(-1, 2)])
            records = np.zeros(len(found), DOC)
            records["id"], records["has_id"], records["n"] = [x[0] or 0 for x in found], [x[0] is not None for x in found], [x[1] for x in found]
            records["key"] = np.frombuffer(b"".join(x[2] or bytes(16) for x in found), "V16")
            rows.append((-1 - turn % parts, links[:, 0].tobytes(), b"", links[:, 1].tobytes(), records.tobytes()))
            keys, holders, n_keys, found, same, known = [], [], 0, [], [], {}
            turn += 1
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "keys", "marks", "holders", "docs"])

        for whole in batches:
            for batch in row_groups(whole, "text"):
                words, at = word_hashes(batch.column(1))
                for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:]):
                    members = shingles(words[a:b], size)
                    ident = hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None
                    found.append((doc, len(members), ident))
                    if doc is None or ident is None:
                        continue
                    if ident in known:  # an equal set of this stretch has put the keys out
                        same.append((doc, known[ident]))
                        continue
                    known[ident] = doc
                    keys.append(range_keys(members, cuts, frequent))
                    holders.append(np.full(len(keys[-1]), doc, np.int64))
                    n_keys += len(keys[-1])
                if n_keys >= HELD_KEYS or len(found) >= HELD_DOCS:
                    yield out()
        if found:
            yield out()

    def meet(rows: pa.Table) -> pa.Table:
        records = np.zeros(0, DOC)
        if rows.column("part")[0].as_py() < 0:
            a, b = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64) for c in ("keys", "holders"))
            records = np.frombuffer(b"".join(rows.column("docs").to_pylist()), DOC)
        else:
            links = runs(*unpack(zip(*(rows.column(c).to_pylist() for c in ("keys", "marks", "holders")))))[2]
            a, b = links[:, 0], links[:, 1]
        n, m = len(a), len(records)
        link, doc = np.arange(n + m) >= n, np.arange(n + m) < n  # masks of what is null
        wide = lambda x: np.concatenate([np.zeros(n, np.int64), x])
        side = lambda x: np.concatenate([x, np.zeros(m, np.int64)])
        no_id = np.concatenate([np.ones(n, bool), records["has_id"] == 0])
        sets = [None if k == 0 else x.tobytes() for k, x in zip(records["n"], records["key"])]
        return pa.table(
            {
                "a": pa.array(side(a), mask=link),
                "b": pa.array(side(b), mask=link),
                "is_doc": pa.array(~doc),
                "doc_id": pa.array(wide(records["id"]), mask=no_id),
                "n_shingles": pa.array(wide(records["n"]), mask=doc),
                "set_key": pa.array([None] * n + sets, pa.binary()),
            }
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = rows.mapInArrow(ship, "part int, keys binary, marks binary, holders binary, docs binary")
    return materialize(packed.groupBy("part").applyInArrow(meet, "a long, b long, is_doc boolean, doc_id long, n_shingles long, set_key binary"), "meetings")


class RTree:
    """Bulk-loaded over count vectors: nodes are halved at the median of the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.root = self._load(np.arange(len(points)))

    def _load(self, rows: np.ndarray) -> tuple:
        """(upper corner, least size, rows of a leaf, children)."""
        mine = self.points[rows]
        top, least = mine.max(0), int(self.sizes[rows].min())
        if len(rows) <= LEAF:
            return top, least, rows, ()
        axis = int((top - mine.min(0)).argmax())
        order = rows[np.argsort(mine[:, axis], kind="stable")]
        return top, least, None, (self._load(order[: len(order) // 2]), self._load(order[len(order) // 2 :]))

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that may link, in batches: a leaf with itself or another."""
        enough = lambda shared, a, b: (100 + percent) * shared >= percent * (a + b)  # noqa: E731  |union| = a + b - shared
        stack = [(self.root, self.root)]
        while stack:
            a, b = stack.pop()
            if not enough(int(np.minimum(a[0], b[0]).sum()), a[1], b[1]):
                continue
            if a[2] is None:
                if a is b:
                    x, y = a[3]
                    stack += [(x, x), (y, y), (x, y)]
                else:
                    stack += [(c, b) for c in a[3]]
            elif b[2] is None:
                stack += [(a, c) for c in b[3]]
            else:
                shared = np.minimum(self.points[a[2]][:, None, :], self.points[b[2]][None, :, :]).sum(2)
                i, j = np.nonzero(enough(shared, self.sizes[a[2]][:, None], self.sizes[b[2]][None, :]))
                if a is b:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield a[2][i], b[2][j]


def link_sets(sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[int]:
    """The component (least index) of each set under verified links; ``known``
    gives components to start from, whose own pairs are not looked at."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def unite(a: int, b: int) -> None:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    if known is not None:
        first: dict[int, int] = {}
        for k, label in enumerate(known):
            unite(first.setdefault(label, k), k)
    points = np.stack([np.bincount((s >> U(20)).astype(np.int64) % GROUPS, minlength=GROUPS) for s in sets]).astype(np.int32)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    for a, b in RTree(points, sizes).pairs(percent):
        for i, j in zip(a.tolist(), b.tolist()):
            if find(i) == find(j):
                continue
            x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            shared = int((y[at] == x).sum())
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                unite(i, j)
    return [find(k) for k in range(len(sets))]


def _joiner(percent: int, size: int):
    """Of the texts of a bundle, each set's component within its cluster: rows of (rep, root)."""

    def run(rows: pa.Table) -> pa.Table:
        words, at = word_hashes(rows.column("text"))
        reps = rows.column("rep").to_numpy()
        cluster = rows.column("cluster").to_numpy()
        known = rows.column("known").to_numpy()
        out = []
        order = np.lexsort((reps, cluster))
        for group in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            labels = known[group].tolist() if (known[group] >= 0).all() else None
            found = link_sets([shingles(words[at[k] : at[k + 1]], size) for k in group], percent, labels)
            out += [(reps[k], reps[group[r]]) for k, r in zip(group, found)]
        a = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"rep": pa.array(a[:, 0]), "root": pa.array(a[:, 1])})

    return run


def _join(rows: DataFrame, joiner) -> DataFrame:
    """rows: bundle, cluster, rep, known (component so far, -1 if none), text."""
    return rows.groupBy("bundle").applyInArrow(joiner, "rep long, root long")


def texts_of(docs: DataFrame):
    """A function that adds the texts to a plan's rows (by rep, which is the
    doc_id): a plan of at most ``PLAN_ROWS`` rows is broadcast, so that only
    texts it names are shuffled; a larger one is joined by sort-merge."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")

    def add(plan: DataFrame) -> DataFrame:
        plan = materialize(plan, "text-plan")
        at = texts.join(F.broadcast(plan), "rep") if plan.count() <= PLAN_ROWS else texts.hint("merge").join(plan, "rep")
        return at.select(*plan.columns, "text")

    return add


def verified_links(with_texts, members: DataFrame, percent: int, size: int, cluster_sets: int, cluster_members: int, joiner=None) -> DataFrame:
    """(rep, root) links of all clusters; members: rep, cluster, n_shingles;
    ``with_texts`` adds the column text to rows with rep; ``joiner`` finds the
    links of a bundle (by default with an R-tree for each cluster)."""
    joiner = joiner or _joiner(percent, size)
    sizes = materialize(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("n_shingles").alias("members")).where("sets > 1"), "cluster-sizes")  # one set alone: its copies brought it here
    big = (F.col("sets") > cluster_sets) | (F.col("members") > cluster_members)
    small_total, n_big = sizes.agg(F.sum(F.when(~big, F.col("members"))), F.count_if(big)).first()
    bundles = max(4 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(small_total or 0) // BUNDLE_MEMBERS))

    small = members.join(sizes.where(~big).select("cluster"), "cluster")
    plan = small.select("rep", "cluster", F.pmod(F.xxhash64("cluster"), F.lit(bundles)).alias("bundle"), F.lit(-1).cast("long").alias("known"))
    links = _join(with_texts(plan), joiner)
    if not n_big:
        return links
    links = materialize(links, "small-links")

    # blocks of a big cluster, each with the cluster's first set
    large = materialize(members.join(sizes.where(big), "cluster"), "large-clusters")
    n_blocks = F.greatest(F.ceil(2 * F.col("sets") / cluster_sets), F.ceil(2 * F.col("members") / cluster_members)).cast("int")
    block = lambda key, n: F.pmod(F.xxhash64(key), n)
    mine = large.where("rep <> cluster").select("rep", "cluster", block("rep", n_blocks).alias("block"))
    firsts = large.where("rep = cluster").select("rep", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), (n_blocks - 1).cast("long"))).alias("block"))
    plan = mine.unionByName(firsts).select("rep", "cluster", F.xxhash64("cluster", "block").alias("bundle"), F.lit(-1).cast("long").alias("known"))
    begun = materialize(_join(with_texts(plan), joiner), "block-links")

    # then blocks of different components, two at a time
    comps = materialize(connected_components(begun), "block-components")
    at = large.join(comps, large["rep"] == comps["node"], "left").select("rep", "cluster", "n_shingles", F.coalesce("component", "rep").alias("known"))
    share = at.groupBy("cluster", "known").agg(F.count(F.lit(1)).alias("c_sets"), F.sum("n_shingles").alias("c_members"))
    own = (2 * F.col("c_sets") > cluster_sets) | (2 * F.col("c_members") > cluster_members)
    labelled = share.withColumn("home", F.when(own, F.col("known")).otherwise(F.lit(-1)))
    homes = labelled.groupBy("cluster", "home").agg(F.sum("c_sets").alias("h_sets"), F.sum("c_members").alias("h_members"))
    homes = homes.withColumn("n", F.greatest(F.ceil(2 * F.col("h_sets") / cluster_sets), F.ceil(2 * F.col("h_members") / cluster_members)).cast("int"))
    blocks = materialize(homes.select("cluster", "home", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")), "home-blocks")
    tiles = blocks.alias("a").join(blocks.alias("b"), "cluster").where("(a.home, a.k) <= (b.home, b.k) AND (a.home <> b.home OR a.home = -1)")
    tiles = tiles.select("cluster", F.monotonically_increasing_id().alias("bundle"), F.array_distinct(F.array(F.struct("a.home", "a.k"), F.struct("b.home", "b.k"))).alias("two"))
    tiles = materialize(tiles, "tiles").select("cluster", "bundle", F.explode("two").alias("x")).select("cluster", "bundle", "x.home", "x.k")
    where = materialize(labelled.join(homes.select("cluster", "home", "n"), ["cluster", "home"]).select("cluster", "known", "home", "n"), "homes")
    placed = at.join(where, ["cluster", "known"])
    placed = placed.withColumn("k", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    plan = placed.join(tiles, ["cluster", "home", "k"]).select("rep", "cluster", "bundle", "known")
    crossed = _join(with_texts(plan), joiner)
    return links.unionByName(begun).unionByName(crossed)


def near_duplicates(docs: DataFrame, *, percent: int = 90, size: int = 3, cluster_sets: int = CLUSTER_SETS, cluster_members: int = CLUSTER_MEMBERS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    met = meetings(docs, percent, size)
    sets = met.where("is_doc").select("doc_id", "n_shingles", "set_key")
    classes = materialize(sets.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles")), "set-classes")
    clusters = materialize(connected_components(met.where("NOT is_doc").select("a", "b")), "clusters")
    members = clusters.join(classes, clusters["node"] == classes["rep"]).select("rep", F.col("component").alias("cluster"), "n_shingles")
    members = materialize(members, "cluster-members")
    links = verified_links(texts_of(docs), members, percent, size, cluster_sets, cluster_members)
    comps = connected_components(links)
    labels = materialize(classes.join(comps, classes["rep"] == comps["node"], "left").select("set_key", F.coalesce("component", "rep").alias("label")), "set-labels")
    return sets.join(labels, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))


def keep_firsts(docs: DataFrame, **how) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id.

    Rows whose doc_id is null or repeats come after all others, in the order of
    a hash; those that are equal in every column are one document.
    """
    known, key = keyed(docs)
    found = near_duplicates(known.select(F.col(key).alias("doc_id"), "text"), **how)
    return drop_keyed(known, key, found.where("doc_id <> component_id").select("doc_id"))


def join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
