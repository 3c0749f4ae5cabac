"""The content gate: four checks that a patched page keeps what the original had."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elements import heading_skips, measure

# Fixed values.
COVERAGE = 0.95
SKIP = 1
CHECK = "struct<name string, passed boolean, detail string>"


def _check(name: str, passed: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), passed.alias("passed"), detail.alias("detail"))


def text_coverage(o: Column, p: Column) -> Column:
    ratio = F.when(o["words"] == 0, F.lit(1.0)).otherwise(p["words"] / F.nullif(o["words"], F.lit(0)))
    told = F.format_string("%d -> %d words (%.1f%%); threshold 95%%", o["words"], p["words"], ratio * 100)
    return _check("text_coverage", (ratio >= COVERAGE) & ((p["words"] > 0) | (o["words"] == 0)), told)


def image_count(o: Column, p: Column) -> Column:
    return _check("image_count", p["images"] >= o["images"], F.format_string("%d -> %d images (must not decrease)", o["images"], p["images"]))


def heading_order(o: Column, p: Column) -> Column:
    skips = heading_skips(p["headings"], SKIP)
    show = lambda a: F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ", "), F.lit("]"))
    pairs = F.transform(skips, lambda s: F.concat(s["from"].cast("string"), F.lit(">"), s["to"].cast("string")))
    told = F.concat(F.lit("before "), show(o["headings"]), F.lit(" -> after "), show(p["headings"]), F.lit("; skips "), F.when(F.size(skips) == 0, "none").otherwise(show(pairs)))
    return _check("heading_order", F.size(skips) == 0, told)


def table_structure(o: Column, p: Column) -> Column:
    was, now = F.size(o["tables"]), F.size(p["tables"])
    kept = (was == 0) | (now >= was)
    return _check("table_structure", kept, F.concat(F.format_string("%d -> %d tables", was, now), F.when(kept, "").otherwise(" (TABLE LOST)")))


#: Builders of a check, in order: two measures (of the original and the patched page) to CHECK.
CHECKS: list[Callable[[Column, Column], Column]] = [text_coverage, image_count, heading_order, table_structure]


def coverage(o_words: Column, p_words: Column) -> Column:
    return F.bround(F.when(o_words == 0, F.lit(1.0)).otherwise(p_words / F.nullif(o_words, F.lit(0))), 4)


def run_gate(pairs: DataFrame, original: str = "original", patched: str = "patched", checks: Sequence[Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Append gate_coverage, gate_checks, gate_failed (names in check order) and gate_passed.

    checks: builders to use in place of ``CHECKS``.

    A row's two pages are read once each, by a fold over their tags inside the
    row, without a shuffle; a page that stayed as it was is not read again.
    """
    m = pairs.withColumn("_o", measure(F.col(original)))
    same = F.col(patched).eqNullSafe(F.col(original))
    m = m.withColumn("_p", measure(F.when(~same, F.col(patched)))).withColumn("_p", F.when(same, F.col("_o")).otherwise(F.col("_p")))
    m = m.withColumn("gate_coverage", coverage(F.col("_o.words"), F.col("_p.words")))
    m = m.withColumn("gate_checks", F.array(*(c(F.col("_o"), F.col("_p")) for c in (CHECKS if checks is None else checks)))).drop("_o", "_p")
    failed = F.transform(F.filter("gate_checks", lambda c: ~c["passed"]), lambda c: c["name"])
    return m.withColumn("gate_failed", failed).withColumn("gate_passed", F.size("gate_failed") == 0)
