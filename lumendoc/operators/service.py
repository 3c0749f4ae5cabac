"""State over time: daily quota, job table, stage plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumendoc.model import STAGES

DAILY_LIMIT = 20


def daily_quota(events: DataFrame, ts: str = "ts", tie: str = "event_id", limit: int = DAILY_LIMIT, per: tuple[str, ...] = ()) -> DataFrame:
    """Append day, allowed and count_after: the first ``limit`` calls of a day pass.

    Calls are summed to one row a (day, time, tie) and the first ``limit`` of
    those found, of which Spark keeps ``limit`` a partition before the shuffle,
    so a day of any size is not sorted in one task.  Equal calls are numbered
    among themselves (only where they repeat), and every call is one row of the
    result.  Null times have a day of their own, null.
    """
    day = events.withColumn("day", F.to_date(ts))
    keys = ["day", *per, ts, tie]
    before = Window.partitionBy("day", *per).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("day", *per).orderBy(ts, tie)
    calls = day.groupBy(*keys).agg(F.count(F.lit(1)).alias("quota n"))
    first = calls.withColumn("quota nth", F.row_number().over(order)).where(F.col("quota nth") <= limit)
    first = first.withColumn("quota before", F.coalesce(F.sum("quota n").over(before), F.lit(0))).where(F.col("quota before") < limit)
    first = first.select(*(F.col(k).alias(f"quota {k}") for k in keys), "quota n", "quota before")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"quota {k}")) for k in keys))
    at = day.join(first, same, "left")
    once = at.where(F.coalesce(F.col("quota n"), F.lit(1)) == 1).withColumn("quota own", F.lit(1))
    more = at.where(F.col("quota n") > 1).withColumn("quota own", F.row_number().over(Window.partitionBy(*(f"quota {k}" for k in keys)).orderBy(F.lit(1))))
    nth = F.col("quota before") + F.col("quota own")
    out = once.unionByName(more).withColumn("allowed", F.coalesce(nth <= limit, F.lit(False))).withColumn("count_after", F.least(F.coalesce(nth, F.lit(limit)), F.lit(limit)).cast("int"))
    return out.select(*day.columns, "allowed", "count_after")


def stage_index(stage: Column) -> Column:
    """Place of a stage, 0 for one that is none."""
    return F.greatest(F.array_position(F.array(*map(F.lit, STAGES)), stage) - 1, F.lit(0)).cast("int")


def job_status(jobs: DataFrame) -> DataFrame:
    """What a caller sees of a job: all but the page itself."""
    return jobs.withColumn("stage_index", stage_index(F.col("stage"))).withColumn("has_html", F.col("final_html").isNotNull()).drop("final_html")


def latest_jobs(updates: DataFrame) -> DataFrame:
    """The job table from its log of updates (id, seq, and fields that are null where unchanged)."""
    fields = [c for c in updates.columns if c not in ("id", "seq")]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields]
    return updates.groupBy("id").agg(*newest)


def shown_stages(max_rounds: Column) -> Column:
    """Stages of a job with so many rounds, without the upload."""
    rounds = F.array(*(F.lit(f"round{k}") for k in (1, 2, 3)))
    beyond = F.filter(rounds, lambda r: F.substring(r, 6, 1).cast("int") > max_rounds)
    return F.array_except(F.array(*map(F.lit, STAGES[1:])), beyond)


def replay(jobs: DataFrame) -> DataFrame:
    """One row a stage that a stored run steps through, in order."""
    return jobs.select("id", F.posexplode(shown_stages(F.col("max_rounds"))).alias("step", "stage"))
