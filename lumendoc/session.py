"""Session helpers: where intermediate tables live, and how lineage is cut.

Intermediate tables are written as Parquet below the folder that the session
names in ``spark.checkpoint.dir``, which driver and executors share.  Only when
the session names none and its master is local (tests) is a temporary folder
made and set; a cluster's session must name one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workdir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lumendoc-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result's lineage is the written table, so a lost executor never makes
    the work above it run again, and later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{workdir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys over all cores, for work that costs far more than its bytes tell.

    Small rows lie in few file splits, and adaptive plans join small partitions;
    a given number of partitions stays.
    """
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
