"""Documents, images and reports from files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumendoc.functions import text as X

SNAPSHOT = (
    "id string, label string, doctype string, source string, baseline struct<score:double,violations:int,passes:int,critical_serious:int>, "
    "rounds array<struct<round:int,patches_applied:int,passes:int,score:double,violations:int,gate_passed:boolean,accepted:int,needs_human:int,hallucinations:int,seconds:double,reviewers:array<string>>>, "
    "final struct<score:double,violations:int,passes:int,critical_serious:int>, stopped_reason string, total_seconds double, "
    "enhancements array<struct<element_id:string,attribute:string,value:string>>, final_html string"
)
#: PDF rows (path, content) to rows with ``markdown``.
Ocr = Callable[[DataFrame], DataFrame]
#: Image rows in, the same rows with ``answer`` struct<alt_text, requires_long_desc, confidence, success, error> out.
AltText = Callable[[DataFrame], DataFrame]


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path, n_bytes and content of the files whose name ends in .pdf, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.endswith(F.lower("path"), F.lit(".pdf"))).select("path", F.col("length").alias("n_bytes"), "content")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path and whole text of Markdown files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("markdown"))


def ocr_result(read: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Append status and page_count to what an OCR provider gave; no text is an error."""
    return read.withColumn("status", F.when(F.col(markdown).isNull(), "error").otherwise("success")).withColumn("page_count", F.when(F.col(markdown).isNotNull(), X.page_count(F.col(markdown))))


def first_markdown(files: DataFrame, *keys: str) -> DataFrame:
    """Of a run's output files (path, depth, markdown), the first by name of the upper level, else of any."""
    return files.groupBy(*keys).agg(F.min_by("markdown", F.struct((F.col("depth") > 0).alias("nested"), "path")).alias("markdown"))


def number_images(found: DataFrame, prefix: str = "syllabus_img_") -> DataFrame:
    """found: doc_id, page, i, xref, ext, data, page_text.  The first of each xref, numbered in order."""
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "xref").orderBy("page", "i"))).where("_r = 1").drop("_r")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "i"))
    named = first.withColumn("n", n).withColumn("filename", F.concat(F.lit(prefix), F.col("n").cast("string"), F.lit("."), F.coalesce("ext", F.lit("png"))))
    return named.select("doc_id", "n", "filename", "data", "page", X.context(F.col("page_text")).alias("context"))


def describe_images(images: DataFrame, provider: AltText | None = None) -> DataFrame:
    """Append alt_text, requires_long_desc and confidence; without an answer the file's name stands in, at 0."""
    if provider is None:
        none = F.lit(None).cast("struct<alt_text:string,requires_long_desc:boolean,confidence:double,success:boolean,error:string>")
        at = images.withColumn("answer", none)
    else:
        at = provider(images)
    ok = F.coalesce(F.col("answer.success"), F.lit(False))
    return at.select(
        *images.columns, F.when(ok, F.col("answer.alt_text")).otherwise(F.col("filename")).alias("alt_text"),
        F.when(ok, F.coalesce("answer.requires_long_desc", X.needs_long_description(F.col("answer.alt_text")))).otherwise(False).alias("requires_long_desc"),
        F.when(ok, F.col("answer.confidence")).otherwise(0.0).alias("confidence"),
    )


def attach_images(docs: DataFrame, images: DataFrame) -> DataFrame:
    """Append the array ``images`` in order, for rendering."""
    per = images.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "filename", "data", "alt_text", "requires_long_desc"))).alias("_i"))
    per = per.select("doc_id", F.transform("_i", lambda m: F.struct(m["filename"].alias("filename"), m["data"].alias("data"), m["alt_text"].alias("alt_text"), m["requires_long_desc"].alias("requires_long_desc"))).alias("images"))
    return docs.join(per, "doc_id", "left")


def read_snapshots(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Stored runs, one JSON document a file, or with ``lines`` a line."""
    return spark.read.schema(SNAPSHOT).option("multiLine", str(not lines).lower()).json(path)


def read_settings(text: str, known: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=value lines; blank, # and other lines are skipped, and what is known already stays."""
    out = dict(known or {})
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#") and "=" in line:
            key, _, value = line.partition("=")
            out.setdefault(key.strip(), value.strip())
    return out
