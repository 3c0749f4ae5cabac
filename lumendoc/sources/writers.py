"""Pages and reports into files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .readers import SNAPSHOT


def spark_names(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).names


def write_html(pages: DataFrame, path: str) -> None:
    """Pages as Parquet, the page in one column."""
    pages.write.parquet(path)


def write_text(pages: DataFrame, path: str, html: str = "html") -> None:
    """Pages as text, line feeds kept by one file a task and one record a page."""
    pages.select(F.col(html).cast("string")).write.option("lineSep", "\n").text(path)


def write_json(rows: DataFrame, path: str, *partitions: str) -> None:
    """Rows as JSON lines: manifests, rejected rows, audits, logs, gate details, summaries."""
    w = rows.write
    (w.partitionBy(*partitions) if partitions else w).json(path)


def write_snapshots(snaps: DataFrame, path: str) -> None:
    """A run a line, which ``read_snapshots`` reads back with ``lines``; null fields are left out."""
    own = [c for c in spark_names(SNAPSHOT) if c in snaps.columns]
    snaps.select(F.col("doc_id").cast("string").alias("id"), *own).write.json(path)


def write_index(index: DataFrame, path: str) -> None:
    """A line a run: what a list of runs shows."""
    index.write.json(path)


def cached(spark, path: str, build, use_cache: bool = True) -> DataFrame:
    """A stage's result from ``path`` if it is there, else built and written."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    if not (use_cache and there):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
