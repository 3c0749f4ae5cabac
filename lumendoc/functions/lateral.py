"""SQL table functions: ``FROM docs, LATERAL blocks(docs.text)`` and ``LATERAL elements(pages.html)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _one_text(what: str, text: AnalyzeArgument) -> None:
    if text.dataType != StringType():
        raise ValueError(f"{what} takes one text, not {text.dataType.simpleString()}")


class _Blocks:
    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _one_text("blocks", text)
        return AnalyzeResult(StructType().add("pos", IntegerType()).add("kind", StringType()).add("level", IntegerType()).add("text", StringType()))

    def eval(self, text: str) -> Iterator[tuple]:
        from lumendoc.operators.segment import segment_text

        for pos, (kind, level, own) in enumerate(segment_text(text)):
            yield pos, kind, level, own


class _Elements:
    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        _one_text("elements", html)
        return AnalyzeResult(
            StructType().add("pos", IntegerType()).add("ir_id", StringType()).add("tag", StringType()).add("text", StringType()).add("alt", StringType()).add("empty", BooleanType()).add("attrs", MapType(StringType(), StringType()))
        )

    def eval(self, html: str) -> Iterator[tuple]:
        from lumendoc.functions.spans import identified

        for e in identified(html):
            yield tuple(e[k] for k in ("pos", "ir_id", "tag", "text", "alt", "empty", "attrs"))


def register(spark: SparkSession) -> None:
    """Make ``blocks`` and ``elements`` known to the session's SQL; null gives no rows."""
    spark.udtf.register("blocks", udtf(_Blocks, useArrow=False))
    spark.udtf.register("elements", udtf(_Elements, useArrow=False))
