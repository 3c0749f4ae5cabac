"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from lumendoc.session import materialize, workdir  # noqa: F401

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is evaluated once.

    A column that is named inside a lambda is evaluated again for each element
    once projections are merged; a lambda's own variable is not.
    """
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: Ids (8 bytes each) that are broadcast.
MOST_IDS = 1 << 20


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` has no column of."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def column(name: str) -> Column:
    """A column by its name as it stands, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain(field: StructField) -> Column:
    """A column that can be hashed and sorted: maps, which can't, by their JSON text."""
    return F.to_json(F.struct(column(field.name))) if "map<" in field.dataType.simpleString() else column(field.name)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a long that tells its rows apart, and that column's name:
    the doc_id, and where that is null or repeats a hash of all columns (above
    2**62).  Rows that are equal in every column have the same."""
    key = unused(docs, "row key")
    ids = docs.select(F.col("doc_id").cast("long").alias("again"))
    again = materialize(ids.where("again IS NOT NULL").groupBy("again").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("again"), "repeated-ids")
    hashed = F.xxhash64(*map(plain, docs.schema.fields)).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    docs = docs.withColumn(key, hashed)
    own = [docs["`" + c.replace("`", "``") + "`"] for c in docs.columns[:-1]]
    at = docs.join(F.broadcast(again) if again.count() <= MOST_IDS else again, docs["doc_id"] == again["again"], "left")
    alone = docs["doc_id"].isNotNull() & again["again"].isNull()
    return at.select(*own, F.when(alone, docs["doc_id"].cast("long")).otherwise(docs[key]).alias(key)), key


def drop_keyed(known: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """The rows of ``keyed`` documents but those whose key is in ``dropped`` (one column), without the key.

    The keys are written first, so that their number is known: up to
    ``MOST_IDS`` are broadcast, beyond that both sides are sort-merged.
    """
    keys = materialize(dropped.toDF(key), "dropped-keys")
    few = keys.count() <= MOST_IDS
    return known.join(F.broadcast(keys) if few else keys, key, "left_anti").select(*(column(c) for c in known.columns if c != key))
