"""Connected components of a link table.

Every link goes from a node to a smaller one.  A node with several smaller
neighbours keeps the least and passes links from the others to it on, until
each node has one link: a forest.  A round is one shuffle by the larger end, in
which a part of the nodes passes on among its own as far as it gets; no node's
larger neighbours are ever gathered, so a hub is no burden.  After the first
round only nodes that were passed a link are looked at again: up to ``FEW`` such
links are broadcast to find them, more are joined by sort-merge.  Then the
trees are halved in height by joins of the forest with itself (which adaptive
execution splits where many nodes have one parent), again only where a node's
parent has moved, until they are stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import U, mix

MAX_ROUNDS = 200
#: Links that a part holds on the average, and links (16 bytes each) that are broadcast.
PART_LINKS, FEW = 500_000, 1 << 20


def _part(node: np.ndarray, parts: int) -> np.ndarray:
    return (mix(node.view(U)) % U(parts)).astype(np.int64)


def _passer(parts: int, whole: bool):
    """Of one part's links, those that its nodes keep and those that other parts get.

    whole: all links of the part's nodes are here; else links to pass on wait for the next round, which fetches theirs.
    """

    def run(rows: pa.Table) -> pa.Table:
        own = rows.column("part")[0].as_py()
        u, v = (rows.column(c).to_numpy().astype(np.int64) for c in ("u", "v"))
        away = []
        while True:
            order = np.lexsort((v, u))
            u, v = u[order], v[order]
            first = np.concatenate([[True], u[1:] != u[:-1]])
            least = v[first][np.cumsum(first) - 1]
            more = v != least
            if not more.any():
                break
            new = np.unique(np.stack([v[more], least[more]], 1), axis=0)
            here = (_part(np.ascontiguousarray(new[:, 0]), parts) == own) & whole
            away.append(new[~here])
            u, v = np.concatenate([u[first], new[here, 0]]), np.concatenate([v[first], new[here, 1]])
        u, v = u[first], v[first]
        gone = np.unique(np.concatenate(away), axis=0) if away else np.zeros((0, 2), np.int64)
        return pa.table({"u": pa.array(np.concatenate([u, gone[:, 0]])), "v": pa.array(np.concatenate([v, gone[:, 1]])), "away": pa.array(np.arange(len(u) + len(gone)) >= len(u))})

    return run


def _dealer(parts: int):
    def run(batches):
        for batch in batches:
            part = _part(np.ascontiguousarray(batch.column(0).to_numpy().astype(np.int64)), parts)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0), batch.column(1)], names=["part", "u", "v"])

    return run


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; component: its smallest node.

    links: two columns of longs in either order; repeats and loops do no harm.
    """
    a, b = links.columns[:2]
    new = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"), "links")
    n = new.count()
    shuffles = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = lambda df, count: F.broadcast(df) if count <= FEW else df

    kept = None
    for _ in range(MAX_ROUNDS):
        if not n:
            break
        parts = max(4 * shuffles, -(-n // PART_LINKS)) if n > 1000 else 1
        work = new
        if kept is not None:
            touched = few(new.select(F.col("u").alias("t")).distinct(), n)
            work = new.unionByName(kept.join(touched, kept["u"] == touched["t"]).groupBy("u").agg(F.min("v").alias("v")))
        passed = work.mapInArrow(_dealer(parts), "part int, u long, v long").groupBy("part").applyInArrow(_passer(parts, kept is None), "u long, v long, away boolean")
        passed = materialize(passed, "passed-links")
        mine, new = passed.where("NOT away").select("u", "v"), passed.where("away").select("u", "v")
        kept = mine if kept is None else kept.unionByName(mine)
        n = new.count()
    else:
        raise RuntimeError("components did not settle")
    if kept is None:
        return new.select(F.col("u").alias("node"), F.col("v").alias("component"))

    # a node's last link is the least it had
    at = materialize(kept.groupBy("u").agg(F.min("v").alias("v")), "forest")
    up = at.select(F.col("u").alias("w"), F.col("v").alias("x"))
    step = materialize(at.join(up, at["v"] == up["w"], "left").select("u", F.coalesce("x", "v").alias("v"), F.col("x").isNotNull().alias("moved")), "raised")
    done, moved = step.where("NOT moved").select("u", "v"), step.where("moved").select("u", "v")
    for _ in range(64):
        n = moved.count()
        if not n:
            break
        # the parents of all nodes as they are now; those of moved nodes are two steps up
        up = step.select(F.col("u").alias("w"), F.col("v").alias("x"))
        on = F.col("v") == F.col("w")
        rise = materialize(few(moved, n).join(up, on).select("u", F.col("x").alias("v")), "risen")
        still = moved.join(few(rise.select(F.col("u").alias("r")), n), F.col("u") == F.col("r"), "left_anti")
        done = materialize(done.unionByName(still), "settled")
        step = materialize(done.select("u", "v").unionByName(rise), "raised")
        moved = rise
    at = done
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
