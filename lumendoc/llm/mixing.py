"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (expected copies), the rates nearest to one copy
each, in relative entropy weighted by words, that meet the token constraints
``sum of rate * size over a source = target of the source``.  The dual of this
convex problem is ``sum of size * exp(lambda) - sum of lambda * target``; its
Newton steps are taken by Spark over the table of word counts, one
aggregation a step, until each constraint holds to ``TOLERANCE``.  A document's
rate is then ``exp(lambda)`` of its source: exponentially tilted from one copy.

Targets: sources, ordered by code point with null last, weigh 1, 2, 3,
repeating, and share all words; a target stops at ``MOST`` times its source's
words, and the excess is shared again by weight among the others until none is
above.  That fixpoint is computed in closed form: with sources ordered by
capacity over weight, those below the water level are at capacity.

Rounding into copies: documents of equal source and size form a bin, and bins
are walked from the largest size down, each getting the difference of the
rounded running sums of rates.  What then lacks (or is over) is made up from
the smallest sizes up.  A bin's copies are dealt evenly to its documents, which
are numbered by (doc_id modulo ``SALT``, doc_id), so no task holds a whole hot
source or size.  There is no chance in it, so reruns agree.

Cases: null text has size 0 and is never taken; a source of no words has target
0; no document exceeds ``MOST`` copies; repeated doc_ids are numbered in any
order, each row being a document of its own; null doc_ids count as doc_id 0 in
the numbering; an empty table gives an empty result; other columns than
doc_id, text and source are ignored by ``mix`` and kept by ``copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, keyed, materialize, n_words, table, unused

MOST = 3
SALT = 64
CYCLE = 3
TOLERANCE = 1e-12
MAX_STEPS = 50
#: Added to running sums before they are rounded, so that sums that are equal
#: but for the order of adding round alike.
NUDGE = 1e-6


def targets(sources: DataFrame) -> DataFrame:
    """Add ``target`` to a table of (source, source_size); one row a source.

    The windows have no partition, as sources are few and their table is
    narrow: 16 bytes or so a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy("level", "nth")
    up_to = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = sources.withColumn("nth", F.row_number().over(order)).withColumn("weight", (F.pmod(F.col("nth") - 1, F.lit(CYCLE)) + 1).cast("double"))
    w = w.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    w = w.withColumn("level", F.col("cap") / F.col("weight"))
    # the level if this source and all with a higher one are below their caps
    w = w.withColumn("if_first", (F.col("total") - (F.sum("cap").over(up_to) - F.col("cap"))) / F.sum("weight").over(onward))
    w = w.withColumn("water", F.max(F.when(F.col("level") >= F.col("if_first"), F.col("if_first"))).over(everything))
    return w.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight")).alias("target"))


def newton_rates(bins: DataFrame, goals: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Solve the dual; adds ``rate`` to ``goals``. Raises if the steps do not suffice.

    A step reads the bins (source, size, n), sums the gradient and the
    curvature of every source in one aggregation and moves each lambda; the
    constraints do not overlap, so the Hessian is diagonal.  Sources of no
    words or target 0 are left out and have rate 0.
    """
    solvable = (F.col("target") > 0) & (F.col("source_size") > 0)
    duals = goals.where(solvable).select("source", "target", F.lit(0.0).alias("dual"))
    for _ in range(max_steps):
        at = bins.alias("b").join(duals.alias("d"), F.col("b.source").eqNullSafe(F.col("d.source")))
        curved = at.groupBy(F.col("d.source").alias("source"), "target", "dual").agg(F.sum(F.col("size") * F.col("n") * F.exp("dual")).alias("h"))
        # where the step down would overshoot, as for the convex exponential, it is damped to one unit
        step = F.greatest(F.least((F.col("target") - F.col("h")) / F.col("h"), F.lit(1.0)), F.lit(-1.0))
        moved = materialize(curved.select("source", "target", (F.col("dual") + step).alias("dual"), (F.abs(F.col("h") - F.col("target")) / F.col("target")).alias("off")), "duals")
        off = moved.agg(F.max("off")).first()[0]
        duals = moved.select("source", "target", "dual")
        if off is None or off <= TOLERANCE:
            break
    else:
        raise ArithmeticError(f"the dual's largest miss is still {off:.3g} of a target after {max_steps} steps")
    solved = duals.select(F.col("source").alias("s"), F.exp("dual").alias("rate"))
    return goals.join(solved, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", F.least(F.coalesce("rate", F.lit(0.0)), F.lit(float(MOST))).alias("rate"))


def bin_copies(bins: DataFrame, rates: DataFrame) -> DataFrame:
    """``copies`` of every bin (source, size, n): all its documents' together."""
    b = bins.alias("b").join(rates.alias("r"), F.col("b.source").eqNullSafe(F.col("r.source"))).select("b.source", "size", "n", "source_size", "target", "rate")
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up = Window.partitionBy("source").orderBy(F.col("size").asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = F.col("rate") >= MOST - 1e-9
    b = b.withColumn("docs", F.sum("n").over(down))
    rounded = lambda docs: F.floor(docs * F.col("rate") + 0.5 + NUDGE)
    b = b.withColumn("k", F.when(full, MOST * F.col("n")).otherwise(rounded(F.col("docs")) - rounded(F.col("docs") - F.col("n"))))
    b = b.withColumn("k", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(F.col("k"), MOST * F.col("n"))).cast("long"))
    b = b.withColumn("lack", F.col("target") - F.sum(F.col("k") * F.col("size")).over(whole))
    room = F.when(F.col("lack") > 0, MOST * F.col("n") - F.col("k")).otherwise(F.col("k"))
    b = b.withColumn("room", F.when(F.col("size") == 0, F.lit(0)).otherwise(room))
    b = b.withColumn("before", F.sum(F.col("room") * F.col("size")).over(up) - F.col("room") * F.col("size"))
    left = F.greatest(F.abs("lack") - F.col("before"), F.lit(0.0))
    moved = F.least(F.col("room"), F.floor(left / F.greatest(F.col("size"), F.lit(1)) + NUDGE))
    return b.select("source", "size", "n", "source_size", "target", (F.col("k") + F.signum("lack").cast("long") * moved).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    sized = materialize(sized.withColumn("salt", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SALT))), "sizes")
    cells = materialize(sized.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n_cell")), "size-cells")
    bins = materialize(cells.groupBy("source", "size").agg(F.sum("n_cell").alias("n")), "size-bins")
    goals = materialize(targets(bins.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")
    planned = bin_copies(bins, newton_rates(bins, goals))

    # where each cell's documents start in the numbering of their bin
    within = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("n_cell").over(within), F.lit(0)))
    dealt = starts.alias("c").join(planned.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")) & (F.col("c.size") == F.col("p.size")))
    dealt = dealt.select("c.source", "c.size", "salt", "start", "n", "source_size", "target", "copies")
    ranked = sized.withColumn("nth", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("doc_id")))
    at = ranked.alias("a").join(dealt.alias("d"), F.col("a.source").eqNullSafe(F.col("d.source")) & (F.col("a.size") == F.col("d.size")) & (F.col("a.salt") == F.col("d.salt")))
    each = F.floor(F.col("copies") / F.col("n"))
    mine = (each + (F.col("start") + F.col("nth") <= F.col("copies") - each * F.col("n")).cast("long")).cast("long")
    return at.select("doc_id", "a.source", "a.size", "source_size", "target", mine.alias("copies"), (mine * F.col("a.size")).alias("taken"))


def copies(docs: DataFrame) -> DataFrame:
    """``docs`` mixed: each row as often as ``mix`` takes it.

    A row is told by its doc_id, or where that is null or repeats by a hash of
    all its columns; rows that are equal in every column are taken together as
    often as all of them are.
    """
    known, key = keyed(docs)
    own, total, rows, nth = (unused(known, x) for x in ("mix key", "mix copies", "mix rows", "nth of mix"))
    plan = mix(known.select(column(key).alias("doc_id"), "text", "source")).groupBy(F.col("doc_id").alias(own))
    plan = plan.agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows)).where(F.col(total) > 0)
    plan = materialize(plan, "mix-plan")
    once, several = plan.where(F.col(rows) == 1), plan.where(F.col(rows) > 1)
    # merged at any size, as nearly all documents have a row
    at = known.hint("merge").join(once, column(key) == F.col(own))
    if not several.isEmpty():
        at = at.unionByName(known.join(several, column(key) == F.col(own)).dropDuplicates([key]))
    out = at.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(total))))
    return out.select(*(column(c) for c in docs.columns))


def mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def mix_sql(docs: str = "documents") -> str:
    """The same in DuckDB's SQL: the dual's solution is target over size."""
    r = lambda d: f"floor({d} * rate + 0.5 + {NUDGE})"
    return rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM {docs}),
src AS (SELECT source, sum(size)::double AS source_size FROM sized GROUP BY source),
w0 AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {CYCLE} + 1 AS weight, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth,
       sum(source_size) OVER () AS total, {MOST} * source_size AS cap FROM src),
w1 AS (SELECT *, cap / weight AS level FROM w0),
w2 AS (SELECT *, (total - (sum(cap) OVER up - cap)) / sum(weight) OVER onward AS if_first FROM w1
       WINDOW up AS (ORDER BY level, nth ROWS UNBOUNDED PRECEDING), onward AS (ORDER BY level, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
w3 AS (SELECT *, max(CASE WHEN level >= if_first THEN if_first END) OVER () AS water FROM w2),
goal AS (SELECT source, source_size, least(cap, coalesce(water, 0) * weight) AS target FROM w3),
rate AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, {MOST}) ELSE 0 END AS rate FROM goal),
bins AS (SELECT source, size, count(*) AS n FROM sized GROUP BY source, size),
b0 AS (SELECT b.*, source_size, target, rate, sum(n) OVER (PARTITION BY b.source ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS docs
       FROM bins b JOIN rate ON b.source IS NOT DISTINCT FROM rate.source),
b1 AS (SELECT *, CASE WHEN size = 0 THEN 0 WHEN rate >= {MOST - 1e-9} THEN {MOST} * n ELSE least({r("docs")} - {r("(docs - n)")}, {MOST} * n) END AS k FROM b0),
b2 AS (SELECT *, target - sum(k * size) OVER (PARTITION BY source) AS lack FROM b1),
b3 AS (SELECT *, CASE WHEN size = 0 THEN 0 WHEN lack > 0 THEN {MOST} * n - k ELSE k END AS room FROM b2),
b4 AS (SELECT *, sum(room * size) OVER (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING) - room * size AS before FROM b3),
b5 AS (SELECT *, k + sign(lack) * least(room, floor(greatest(abs(lack) - before, 0) / greatest(size, 1) + {NUDGE})) AS copies FROM b4),
nth AS (SELECT *, row_number() OVER (PARTITION BY source, size ORDER BY ((coalesce(doc_id, 0) % {SALT}) + {SALT}) % {SALT}, doc_id) AS nth FROM sized),
mixed AS (SELECT doc_id, a.size, source_size, target, (floor(copies / n) + (nth <= copies - floor(copies / n) * n)::int)::bigint AS copies
          FROM nth a JOIN b5 ON a.source IS NOT DISTINCT FROM b5.source AND a.size = b5.size)
"""


MIX_SQL = mix_sql() + "SELECT doc_id, size, source_size::bigint AS source_size, round(target, 6) AS target, copies * size AS taken FROM mixed"
