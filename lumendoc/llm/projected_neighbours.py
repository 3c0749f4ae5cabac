"""Approximate nearest neighbours by few stable projections and a kd-tree.

Vectors are taken to the unit sphere, where the largest cosine is the least
Euclidean distance, and projected on ``DIMS`` Gaussian directions.  A projected
squared distance over the true one is chi-square distributed, so once the
points come in order of projected distance ``r``, a nearer one than the worst
of those found (at distance ``d``) is still to come only with the probability
``1 - P(chi2 <= r*r / (d*d))``.  The search stops when that probability is below
``1 - CERTAIN``, and verifies each point that it meets in the original space.

The kd-tree has two levels.  Its top, cut at the medians of a sample of at most
``SAMPLE`` rows (the only thing that is sampled), deals all points out to cells,
a cell of more than ``CELL_ROWS`` rows in several blocks.  A task builds the tree
of its block, then streams the queries through it, whose number is not bounded:
leaves come by the distance of their boxes, points of a leaf only if the test
does not rule out their projected distance.  A query first searches the cell
that it lies in, which bounds ``d``; then the test at the boxes of the other cells
tells which of them it visits.

Equal vectors: of each, the ``k + 1`` smallest ids are points, as no other can be
in a result; queries of equal vectors are searched once.  So a vector that many
rows share gathers nowhere, and no row is lost.

Cases: null ids, and vectors that are null, empty, zero or hold null or
non-finite numbers take no part; vectors of fewer components count as filled up
with zeros; of rows that repeat an id the smallest vector counts; ties go to the
smaller id; fewer than ``k`` candidates: all of them; an empty table, or one
without queries: no rows; further columns are ignored.  Scores are sums over the
original numbers in double precision (scaled by a power of two, which is exact).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

K, STEP = 5, 50
DIMS, CERTAIN, SEED = 16, 0.985, 7
SAMPLE, CELL_ROWS, LEAF = 8192, 8192, 64
#: Queries that one task streams through a block.
QUERY_ROWS = 1 << 16
#: Added to squared distances where they are compared, as sums round.
SLACK = 1e-9


def chi_square_quantile(p: float, dims: int) -> float:
    """The value below which a chi-square variable of an even number of dimensions falls with probability ``p``."""
    def below(x: float) -> float:
        term = total = 1.0
        for k in range(1, dims // 2):
            term *= x / 2 / k
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors filled up to ``width`` and scaled by powers of two, their lengths)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    values, n = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    out = np.ldexp(out, -np.frexp(np.abs(out).max(1, initial=0))[1][:, None])
    return out, np.sqrt((out * out).sum(1))


class Projection:
    """Gaussian directions, and the top of the kd-tree over a sample's projections."""

    def __init__(self, width: int, dims: int, seed: int):
        self.width, self.axes = width, np.random.default_rng(seed).standard_normal((width, dims))
        self.cuts: list[tuple[int, float]] = []
        self.low, self.high = np.full((1, dims), -np.inf), np.full((1, dims), np.inf)

    def __call__(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (x / length[:, None]) @ self.axes

    def cut(self, sample: np.ndarray, levels: int) -> None:
        """Cut the space at medians of the widest sides, level by level, into ``2 ** levels`` cells."""
        groups = [sample]
        for _ in range(levels):
            low, high, halves = [], [], []
            for k, own in enumerate(groups):
                axis = int(np.argmax(np.ptp(own, 0))) if len(own) else 0
                at = float(np.median(own[:, axis])) if len(own) else 0.0
                self.cuts.append((axis, at))
                for side in (0, 1):
                    low.append(self.low[k].copy())
                    high.append(self.high[k].copy())
                    (high if side == 0 else low)[-1][axis] = at
                    halves.append(own[own[:, axis] <= at] if side == 0 else own[own[:, axis] > at])
            groups, self.low, self.high = halves, np.array(low), np.array(high)

    def cell(self, p: np.ndarray) -> np.ndarray:
        at, node, n = np.zeros(len(p), np.int64), 0, 1
        while n < len(self.low):
            axis, value = (np.array(x) for x in zip(*self.cuts[node : node + n]))
            at = 2 * at + (p[np.arange(len(p)), axis[at].astype(np.int64)] > value[at])
            node, n = node + n, 2 * n
        return at


def box_distance(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    off = np.maximum(np.maximum(low - p, p - high), 0)
    return (off * off).sum(1)


class Block:
    """A kd-tree over the projections of one block's points."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, length: np.ndarray, p: np.ndarray, leaf: int = LEAF):
        todo, leaves = [np.arange(len(ids))], []
        while todo:
            own = todo.pop()
            if len(own) <= leaf:
                leaves.append(own)
                continue
            axis = int(np.argmax(np.ptp(p[own], 0)))
            half = len(own) // 2
            own = own[np.argpartition(p[own, axis], half)]
            todo += [own[:half], own[half:]]
        order = np.concatenate(leaves)
        self.ids, self.x, self.length, self.p = ids[order], x[order], length[order], p[order]
        self.ends = np.cumsum([len(own) for own in leaves])
        self.starts = self.ends - [len(own) for own in leaves]
        self.low = np.array([p[own].min(0) for own in leaves])
        self.high = np.array([p[own].max(0) for own in leaves])

    def search(self, q: np.ndarray, length: float, p: np.ndarray, worst: float, most: int, quantile: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the ``most`` nearest found; ``worst``: squared distance that is known to suffice."""
        boxes = box_distance(self.low, self.high, p)
        order = np.argsort(boxes)
        ids, found = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 4
        while at < len(order) and boxes[order[at]] <= quantile * worst + SLACK:
            now = order[at : at + step]
            some = np.concatenate([np.arange(self.starts[k], self.ends[k]) for k in now])
            off = self.p[some] - p
            some = some[(off * off).sum(1) <= quantile * worst + SLACK]
            cosine = (self.x[some] * q).sum(1) / (self.length[some] * length)
            ids, found = np.concatenate([ids, self.ids[some]]), np.concatenate([found, cosine])
            best = np.lexsort((ids, -found))[:most]
            ids, found = ids[best], found[best]
            if len(found) == most:
                worst = min(worst, max(0.0, 2 - 2 * float(found[-1])))
            at, step = at + step, 2 * step
        return ids, found


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and vec (doubles or floats) of the rows that take part, one row an id; written once."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col(vec_id).isNotNull() & v.isNotNull() & fine)
    return materialize(rows.select(F.col(vec_id).cast("long").alias("id"), v.alias("vec")).groupBy("id").agg(F.min("vec").alias("vec")), "ann-vectors")


def nearest(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, step: int = STEP, dims: int = DIMS, certain: float = CERTAIN, seed: int = SEED, cell_rows: int = CELL_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of every row whose id is divisible by ``step``."""
    spark, most = rows.sparkSession, k + 1
    base = usable(rows, vec_id, vector)
    kind = base.schema["vec"].dataType.simpleString()
    of_equal = Window.partitionBy("vec").orderBy("id")
    points = materialize(base.withColumn("nth", F.row_number().over(of_equal)).where(F.col("nth") <= most).select("id", "vec"), "ann-points")
    asked = base.where(F.col("id") % step == 0)
    queries = materialize(asked.groupBy("vec").agg(F.min("id").alias("query")), "ann-queries")
    members = asked.join(queries, "vec").select(F.col("id").alias("query_id"), "query")
    n, width = points.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    space = Projection(width, dims, seed)
    sample = points.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vec").toArrow().column("vec")
    levels = max(0, math.ceil(math.log2(max(1.0, min(n / cell_rows, SAMPLE / 8)))))
    space.cut(space(*matrix(sample, width)), levels)
    cells = 1 << levels
    blocks = max(1, math.ceil(n / (cells * cell_rows * 2)))
    groups = max(1, math.ceil(n_queries / query_rows))
    quantile = chi_square_quantile(certain, dims)
    sent = spark.sparkContext.broadcast(space)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = sent.value.cell(sent.value(*matrix(batch.column(1), width)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=["id", "vec", "cell"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells but a query's own that the test at their boxes does not rule out."""
        space = sent.value
        for batch in batches:
            p, worst, home = space(*matrix(batch.column(1), width)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for a in range(0, len(p), 256):
                hits = [np.flatnonzero((box_distance(space.low, space.high, p[j]) <= quantile * worst[j] + SLACK) & (np.arange(cells) != home[j])) for j in range(a, min(a + 256, len(p)))]
                own = pa.array(np.repeat(np.arange(a, a + len(hits)), [len(h) for h in hits]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), batch.column(2).take(own), pa.array(np.concatenate(hits), pa.int32())], names=["id", "vec", "worst", "cell"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, part, held, tree = sent.value, None, [], None
        for batch in batches:  # by part, points before queries
            parts, is_query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (parts[1:] != parts[:-1]) | (is_query[1:] != is_query[:-1]), [True]]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                some = batch.slice(a, b - a)
                if parts[a] != part:
                    part, held, tree = parts[a], [], None
                if not is_query[a]:
                    held.append(some)
                    continue
                if tree is None:
                    if not held:
                        continue
                    own = pa.Table.from_batches(held)
                    x, length = matrix(own.column("vec"), width)
                    tree, held = Block(own.column("id").to_numpy(), x, length, space(x, length)), []
                q, length = matrix(some.column(3), width)
                p, worst = space(q, length), some.column(4).to_numpy()
                found = [tree.search(q[j], length[j], p[j], worst[j], most, quantile) for j in range(len(q))]
                own = np.repeat(some.column(2).to_numpy(), [len(i) for i, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["query", "vec_id", "score"])

    parts = cells * blocks * groups
    group = lambda: F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups))
    part = lambda block, group: ((F.col("cell").cast("long") * blocks + block) * groups + group).cast("int").alias("part")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = materialize(points.mapInArrow(deal, f"id long, vec {kind}, cell int"), "ann-cells")
    placed = dealt.withColumn("g", every(groups)).select(part(F.pmod(F.xxhash64("id"), F.lit(blocks)), F.col("g")), F.lit(False).alias("is_query"), "id", "vec", F.lit(0.0).alias("worst"))

    def asks(rows: DataFrame) -> DataFrame:
        """Nearest found of queries (id, vec, worst, cell) in their cells."""
        spread = rows.withColumn("b", every(blocks)).select(part(F.col("b"), group()), F.lit(True).alias("is_query"), "id", "vec", "worst")
        both = placed.unionByName(spread).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "is_query")
        return materialize(both.mapInArrow(search, "query long, vec_id long, score double"), "ann-found")

    home = queries.select(F.col("query").alias("id"), "vec").mapInArrow(deal, f"id long, vec {kind}, cell int")
    home = materialize(home.withColumn("worst", F.lit(4.0)), "ann-home")
    near = asks(home)
    found = near
    if cells > 1:
        bound = near.groupBy(F.col("query").alias("id")).agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(most - 1)).alias("last"))
        again = home.drop("worst").join(bound, "id", "left").select("id", "vec", F.greatest(F.lit(0.0), F.least(F.lit(4.0), 2 - 2 * F.coalesce("last", F.lit(-1.0)))).alias("worst"), "cell")
        found = near.unionByName(asks(again.mapInArrow(visit, f"id long, vec {kind}, worst double, cell int")))
    of_query = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    found = materialize(found.withColumn("nth", F.row_number().over(of_query)).where(F.col("nth") <= most), "ann-best")
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near"))
    out = members.join(lists, "query").select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def nearest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth row of ``embeddings``."""
    return nearest(table(spark, sf_dir, "embeddings"))
