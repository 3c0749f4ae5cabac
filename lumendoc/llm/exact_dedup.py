"""Exact deduplication against a persistent digest index.

The index is a Parquet table of one row per distinct text (SHA-256 digest, the
row that stays, copies in the batch that brought it), bucketed and sorted by
digest.  New data is reduced to one row per digest by a partial and a final
aggregation, anti-joined with the index by sort-merge (the index's side is read
bucket by bucket, without a shuffle) and what is new is appended.  Main path:
built-in functions only.

The index can be opened again from any session: its bucket count, schema and
data folder stand in a table of their own beside it, and a request that does
not agree with them is refused.  Appends leave one more sorted file a bucket;
``compact`` writes them anew as one.

Which row stays: within one batch the largest ``doc_id`` of equal texts; a text
that the index already holds keeps the row of the batch that brought it.

Hot texts: digests are counted before any row is shuffled.  A digest that holds
at least one in ``HOT_SHARE`` of the batch's rows is hot; there are at most
``HOT_SHARE`` of those, so their table is broadcast, and the rest is joined by
sort-merge, each key then being a small share of the rows.

Cases: null text counts as empty, and all empty texts are equal; a null
``doc_id`` stays only if all rows of its text have none (``keep_id`` null, all
of them kept); rows that repeat both ``doc_id`` and text count in
``group_size`` and have equal verdicts, being one document, of which
``keep_texts`` keeps one row; an empty table gives an empty result and appends
nothing; columns beside ``doc_id`` and ``text`` are never looked at.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, unused, workdir

HOT_SHARE = 1000
INDEX_DDL = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING"
META_DDL = "version BIGINT, buckets INT, ddl STRING, data STRING"
#: Rows (some 50 bytes each) that ``keep_texts`` broadcasts.
MOST_GONE = 1 << 18


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the text's SHA-256 (32 bytes)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"))


class DigestIndex:
    """The persistent index: opened by folder, created if missing.

    ``name`` is the table's name in this session's catalog; ``buckets`` (by
    default the shuffle partitions) counts when the index is made, and must
    agree, if given, when it is opened again.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str | None = None, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        meta = self._meta()
        if meta is None:
            self.version, self.buckets = 0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._point_to("data-0")
        else:
            self.version, self.buckets = meta["version"], meta["buckets"]
            if buckets not in (None, self.buckets):
                raise ValueError(f"the index at {self.folder} has {self.buckets} buckets, not {buckets}")
            if meta["ddl"] != INDEX_DDL:
                raise ValueError(f"the index at {self.folder} has other columns: {meta['ddl']}")
            self._register(meta["data"])

    def _meta(self):
        try:
            rows = self.spark.read.schema(META_DDL).json(f"{self.folder}/meta")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows.orderBy(F.col("version").desc()).first()

    def _register(self, data: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # external: the files stay
        self.spark.sql(
            f"CREATE TABLE {self.name} ({INDEX_DDL}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{data}'"
        )

    def _point_to(self, data: str) -> None:
        """From now on the index is this folder of data."""
        self._register(data)
        row = self.spark.range(1).select(F.lit(self.version).cast("long").alias("version"), F.lit(self.buckets).alias("buckets"), F.lit(INDEX_DDL).alias("ddl"), F.lit(data).alias("data"))
        row.coalesce(1).write.mode("append").json(f"{self.folder}/meta")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def compact(self) -> None:
        """One sorted file a bucket again, in a new data folder; the old one is left to readers that have it open."""
        rows, fresh = self.read(), f"{self.name}_compact"
        self.version += 1
        data = f"data-{self.version}"
        rows.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.folder}/{data}").saveAsTable(fresh)
        self.spark.sql(f"DROP TABLE {fresh}")
        self._point_to(data)

    def close(self) -> None:
        """Take the table's name out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicate ``docs`` against the index and append what is new.

        Returns one row per document: doc_id, digest, keep_id, group_size (of
        the batch and what the index held), kept.
        """
        batch = batch or uuid.uuid4().hex
        rows = digests(docs)
        groups = materialize(rows.groupBy("digest").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")), "digest-groups")
        known = self.read().select("digest", "keep_id", "group_size")
        fresh = groups.hint("merge").join(known.hint("merge"), "digest", "left_anti").select("digest", F.col("top").alias("keep_id"), F.col("n").alias("group_size"), F.lit(batch).alias("batch"))
        fresh.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

        held = self.read().select("digest", "keep_id", F.col("group_size").alias("indexed"), (F.col("batch") == batch).alias("own"))
        verdicts = groups.join(held, "digest").select("digest", "keep_id", "own", F.when(F.col("own"), F.col("n")).otherwise(F.col("n") + F.col("indexed")).alias("group_size"), "n")
        total = groups.agg(F.sum("n")).first()[0] or 0
        hot = F.col("n") * HOT_SHARE >= total
        cold = rows.join(F.broadcast(verdicts.where(hot).select("digest")), "digest", "left_anti").join(verdicts.where(~hot).hint("merge"), "digest")
        many = rows.join(F.broadcast(verdicts.where(hot)), "digest")
        return cold.select("doc_id", "digest", "keep_id", "group_size", "own").unionByName(many.select("doc_id", "digest", "keep_id", "group_size", "own")).select(
            "doc_id", "digest", "keep_id", "group_size", (F.col("own") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept")
        )


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, f"{workdir(spark)}/digest-index-{uuid.uuid4().hex}")


def keep_texts(docs: DataFrame) -> DataFrame:
    """Of equal texts in ``docs`` one row, with the largest doc_id; decided by
    (doc_id, digest), so that other texts under the same doc_id stay."""
    index = new_index(docs.sparkSession)
    found = materialize(index.add(docs).select("doc_id", "digest", "kept"), "dedup-verdicts")
    index.close()
    gone = materialize(found.where(~F.col("kept")).select(F.col("doc_id").alias("gone id"), F.col("digest").alias("gone digest")).distinct(), "gone-texts")
    again = found.where("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = materialize(again.select(F.col("doc_id").alias("again id"), F.col("digest").alias("again digest")), "repeated-rows")
    few = lambda x: F.broadcast(x) if x.count() <= MOST_GONE else x
    of = lambda x: docs["doc_id"].cast("long").eqNullSafe(x[0]) & (F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)) == x[1])
    left = docs.join(few(gone), of((gone["gone id"], gone["gone digest"])), "left_anti")
    if again.isEmpty():
        return left
    mine = of((again["again id"], again["again digest"]))
    own = unused(docs, "own text")  # null and empty texts are equal
    twice = left.join(few(again), mine, "left_semi").withColumn(own, F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", own]).drop(own)
    return left.join(few(again), mine, "left_anti").unionByName(twice)


def dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as the first batch of an empty index."""
    index = new_index(spark)
    out = index.add(table(spark, sf_dir, "documents"))
    index.close()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


DEDUP_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)
"""
