"""Stages whose results are kept by content: what has been built for a text once is not built again.

A stage is a folder of results, each with the digest of what it was built from,
and numbered lists of the parts that count.  A call builds what no part holds,
writes it as a new part, and then publishes a list with it, which is written last
and under a name that must be new.  A part that a lost driver left behind is on
no list and is never read; two drivers that publish at once can't overwrite each
other's list, and the later one tries again with the other's parts.

Cases: a null text counts as empty; equal texts are built once; an empty table
publishes nothing new; a result without rows for a digest is built again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Not hidden, as Spark reads no hidden files.
LISTS = "list-"


class Stage:
    """``build`` takes (digest, content), one row a digest, and gives rows with the digest."""

    def __init__(self, spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.build = spark, path.rstrip("/"), build
        jvm = spark._jvm
        self._hadoop = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self.fs = self._hadoop().getFileSystem(spark._jsc.hadoopConfiguration())

    def _lists(self) -> list[int]:
        if not self.fs.exists(self._hadoop()):
            return []
        names = (x.getPath().getName() for x in self.fs.listStatus(self._hadoop()))
        return sorted(int(n[len(LISTS) :]) for n in names if n.startswith(LISTS))

    def parts(self) -> list[str]:
        """Names of the parts that count."""
        at = self._lists()
        return json.loads(self.spark.read.text(f"{self.path}/{LISTS}{at[-1]}", wholetext=True).first()[0]) if at else []

    def publish(self, part: str) -> None:
        while True:
            at = self._lists()
            text = json.dumps([*self.parts(), part]).encode()
            name = self._hadoop(f"{LISTS}{at[-1] + 1 if at else 1}")
            try:
                out = self.fs.create(name, False)
            except Py4JJavaError:
                if self.fs.exists(name):  # another driver was quicker
                    continue
                raise
            out.write(text)
            out.close()
            return

    def results(self) -> DataFrame | None:
        own = self.parts()
        return self.spark.read.parquet(*(f"{self.path}/{p}" for p in own)) if own else None

    def run(self, docs: DataFrame, content: str, how: str = "inner") -> DataFrame:
        """``docs`` with their results; only what no part holds is built. ``how``: a left join keeps documents without a result."""
        digest = F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary")), 256)
        told = docs.withColumn("digest", digest)
        asked = told.select("digest", F.coalesce(content, F.lit("")).alias("content"))
        known = self.results()
        if known is not None:
            asked = asked.join(known.select("digest").distinct(), "digest", "left_anti")
        asked = asked.dropDuplicates(["digest"])
        if not asked.isEmpty():
            part = f"part-{uuid.uuid4().hex}"
            self.build(asked).withColumn("stage_part", F.lit(part)).write.parquet(f"{self.path}/{part}")
            self.publish(part)
            known = self.results()
        if known is None:  # nothing was ever built: no documents
            known = self.build(asked).withColumn("stage_part", F.lit(""))
        # where two drivers built the same, one part's rows count
        first = known.groupBy("digest").agg(F.min("stage_part").alias("stage_part"))
        return told.join(known.join(first, ["digest", "stage_part"], "left_semi").drop("stage_part"), "digest", how).drop("digest")
