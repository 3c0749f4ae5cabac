"""Two tables of one key, kept as one sorted file a bucket on either side.

A row's bucket is ``crc32("s" + key) mod BUCKETS``.  Lines whose key is none of
the sales' take the bucket ``BUCKETS``, rows without a key ``BUCKETS + 1``.
Within a file, rows are sorted by the key descending, then by the other columns
ascending; nulls come first, strings by their UTF-8 bytes.

``rewrite`` turns tables that lie in other numbered files into this layout:

1. A Bloom filter of a fixed size is built by ``treeAggregate`` over the keys of
   sales, and sent to the workers: keys that it does not hold are orphans for
   sure, told where the lines are read.
2. The distinct keys that it holds are counted before they move, then verified
   exactly by a join of both sides' keys that are dealt out by bucket.  Orphans
   that slipped through go into a second filter of the same size; a line in both
   filters is looked up among them, any other is a sale's line for sure.  So
   lines move once, and full filters cost time, not rightness.
3. How many rows go from which starting file to which bucket is counted (at
   most ``BUCKETS`` squared cells).  A starting file that holds just a bucket's
   rows stays; the rows of the others are dealt out by bucket, sorted and
   written, one task a bucket.
4. Buckets of over ``HOT`` times the mean (and over ``HOT_ROWS`` rows) are cut by ranges of the sort order,
   sorted as runs in as many tasks, and each is then written by one task that
   streams its runs one after the other.

Only counts of files come to the driver, at most ``BUCKETS + 2`` rows a table.

Cases: sales without a key have the bucket ``BUCKETS + 1``; repeated rows and
keys stay as they are (``n_joined`` counts each pair of rows); rows that are
equal in all columns may swap places; an empty table has no files; further
columns, of whatever name, are kept in their place and sorted by, maps by their
JSON text; text of any length is only sorted and written.
"""

from __future__ import annotations

import functools
import hashlib
import math
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, materialize, plain, table, unused, workdir
from .tokens import U, mix

BUCKETS = 600
#: Bits of a filter (2 MB), whatever the input: sized for some two million keys.
FILTER_BITS = 1 << 24
#: A bucket with so many times the mean rows, and with so many rows, is sorted by several tasks, at most ``MOST_RUNS`` for all hot ones.
HOT, HOT_ROWS, MOST_RUNS = 4, 1 << 16, 256
#: Files that the driver renames or removes at a time.
THREADS = 16
#: Keys of a file that are hashed as one piece of text.
PIECE = 1024


def bucket_of(key: Column, salt: str = "s", buckets: int = BUCKETS) -> Column:
    return (F.crc32(F.concat(F.lit(salt), key.cast("string"))) % buckets).cast("int")


def sort_order(df: DataFrame, key: str) -> list[Column]:
    """The key descending, the others ascending, nulls first; maps by their JSON text."""
    own, rest = [f for f in df.schema.fields if f.name == key], [f for f in df.schema.fields if f.name != key]
    return [plain(own[0]).desc_nulls_first(), *(plain(f).asc_nulls_first() for f in rest)]


# --- Bloom filter -----------------------------------------------------------


def _places(keys: np.ndarray, bits: int, hashes: int) -> Iterator[np.ndarray]:
    h = mix(keys.view(U))
    step = mix(h + U(0x9E3779B97F4A7C15)) | U(1)
    for k in range(hashes):
        yield (h + U(k) * step) & U(bits - 1)


def _numbers(x: pa.Array) -> np.ndarray:
    """The values of a whole-number column without its nulls."""
    return x.drop_null().cast(pa.int64()).to_numpy(zero_copy_only=False)


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> tuple[bytes, int]:
    """(filter, hashes) over a DataFrame of one whole-number column.

    Every task fills a filter over its rows; ``treeAggregate`` joins them in
    pairs on the workers, so at most four reach the driver.
    """
    n = keys.count()
    hashes = max(1, min(8, round(bits / max(n, 1) * math.log(2))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits, dtype=bool)
        for batch in batches:
            for at in _places(_numbers(batch.column(0)), bits, hashes):
                marks[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(marks).tobytes()])], names=["filter"])

    def join(a: bytes, b: bytes) -> bytes:
        return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes() if a and b else a or b

    parts = keys.mapInArrow(fill, "filter binary").rdd.map(lambda r: bytes(r[0]))
    depth = max(2, math.ceil(math.log2(max(parts.getNumPartitions(), 2))))
    return parts.treeAggregate(b"", join, join, depth) or bytes(bits // 8), hashes


def held(spark: SparkSession, found: tuple[bytes, int], bits: int = FILTER_BITS):
    """A function on a key column: may the filter hold it? (null: no)"""
    sent, hashes = spark.sparkContext.broadcast(found[0]), found[1]

    def probe(keys: pa.Array) -> pa.Array:
        marks = np.frombuffer(sent.value, np.uint8)
        values = keys.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        hit = np.ones(len(values), dtype=bool)
        for at in _places(values, bits, hashes):
            hit &= (marks[at >> U(3)] >> (U(7) - (at & U(7))).astype(np.uint8)) & 1 == 1
        return pa.array(hit & ~keys.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(probe, "boolean")


# --- numbered files ---------------------------------------------------------


class Folder:
    """A folder of Spark's file system, by the driver: names only, never data."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def make(self) -> None:
        self.fs.mkdirs(self._at(""))

    def names(self, within: str = "") -> list[str]:
        at = self._at(within)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def move(self, name: str, to: str) -> None:
        if not self.fs.rename(self._at(name), self._at(to)):
            raise OSError(f"{self.path}/{name} can't be moved to {to}")

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def each(self, do, names: list) -> None:
        """``do`` for all of them, some at a time."""
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(do, names))


def _parts(folder: Folder, within: str) -> list[str]:
    return [x for x in folder.names(within) if x.startswith("part-")]


def write_numbered(rows: DataFrame, number: str, folder: Folder, prefix: str, order: list[Column], total: int, hot: float = HOT, hot_rows: int = HOT_ROWS) -> dict[int, int]:
    """Write ``rows`` sorted, one file for each value of ``number`` (0 up to ``total``), which is left out.

    Gives the rows of each number.  Files are named by ``prefix`` and number.
    A number of over ``hot`` times the mean rows, and over ``hot_rows``, is sorted in
    ranges by several tasks, and its runs are streamed into its file by one.

    Tasks move their files themselves (the committer's version 2): a task that
    is run again writes the same name and rows.
    """
    spark = rows.sparkSession
    counts = {r[0]: r[1] for r in rows.groupBy(number).count().collect()}  # total at most
    if not counts:
        return counts
    mean = sum(counts.values()) / len(counts)
    large = sorted(k for k, n in counts.items() if n > max(hot * mean, hot_rows))
    parquet = lambda df: df.write.option("maxRecordsPerFile", 0).option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    n, work = F.col(number), f"_{prefix}"
    if len(large) < len(counts):
        cold = (rows.where(~n.isin(large)) if large else rows).repartitionById(total, n).sortWithinPartitions(*order).drop(number)
        parquet(cold).parquet(f"{folder.path}/{work}")
        own = [x for x in _parts(folder, work) if int(x[5:10]) in counts and int(x[5:10]) not in large]  # else the empty first file of Spark
        folder.each(lambda x: folder.move(f"{work}/{x}", f"{prefix}-{x[5:10]}.parquet"), own)
        folder.remove(work)
    if large:
        salt = unused(rows, "salt")
        runs = min(MOST_RUNS, max(2 * len(large), math.ceil(sum(counts[k] for k in large) / mean)))
        some = rows.where(n.isin(large)).withColumn(salt, F.rand(1))  # equal rows, too, fall into several ranges
        some = some.repartitionByRange(runs, n, *order, F.col(salt)).sortWithinPartitions(n, *order).drop(salt)
        parquet(some).partitionBy(number).parquet(f"{folder.path}/{work}-runs")
        schema = T.StructType([f for f in rows.schema.fields if f.name != number])
        for k in large:
            own = f"{work}-runs/{number}={k}"
            names = _parts(folder, own)
            if len(names) > 1:
                # the partitions of a union stand in its order, and so does what coalesce reads one after the other
                each = [spark.read.schema(schema).parquet(f"{folder.path}/{own}/{x}") for x in names]
                parquet(functools.reduce(DataFrame.union, each).coalesce(1)).parquet(f"{folder.path}/{work}-one")
                folder.move(f"{work}-one/{_parts(folder, f'{work}-one')[0]}", f"{prefix}-{k:05d}.parquet")
                folder.remove(f"{work}-one")
            else:
                folder.move(f"{own}/{names[0]}", f"{prefix}-{k:05d}.parquet")
        folder.remove(f"{work}-runs")
    return counts


def key_digests(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """file, n_rows and the SHA-256 of the keys of each of a folder's files in their order, read back from the files.

    Readers make pieces of ``PIECE`` keys; one task a file hashes its pieces in order as they stream by.
    """
    place = lambda k: F.col(f"_metadata.{k}")
    only = T.StructType([f for f in schema.fields if f.name == key])
    rows = spark.read.schema(only).parquet(path).select(F.element_at(F.split(place("file_path"), "/"), -1).alias("file"), place("row_index").alias("at"), F.col(key).cast("string").alias("key"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, at = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            names, keys = file.dictionary_encode(), batch.column(2).fill_null("").to_pylist()
            which = names.indices.to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else []
            found = [(a, min(a + PIECE, end)) for start, end in zip(new, [*new[1:], len(at)]) for a in range(start, end, PIECE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names.dictionary[int(which[a])].as_py() for a, _ in found], pa.string()), pa.array([int(at[a]) for a, _ in found], pa.int64()), pa.array([b - a for a, b in found], pa.int64()), pa.array([",".join(keys[a:b]) for a, b in found], pa.string())],
                names=["file", "at", "n", "keys"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed, n, out = None, None, 0, []
        for batch in batches:
            for file, count, keys in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if file != now:
                    out.append((now, n, hashed and hashed.hexdigest()))
                    now, hashed, n = file, hashlib.sha256(), 0
                hashed.update(f"{',' * (n > 0)}{keys}".encode())
                n += count
        out.append((now, n, hashed and hashed.hexdigest()))
        cols = list(zip(*(x for x in out if x[0] is not None))) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["file", "n_rows", "ids_sha256"])

    pieces = rows.mapInArrow(cut, "file string, at long, n long, keys string")
    return pieces.repartition("file").sortWithinPartitions("file", "at").mapInArrow(digest, "file string, n_rows long, ids_sha256 string")


# --- the pair ---------------------------------------------------------------


def rewrite(
    spark: SparkSession, sales: DataFrame, lines: DataFrame, sales_start: Column, lines_start: Column, *,
    root: str, key: str = "sale_id", names: tuple[str, str] = ("sales", "sale_lines"), buckets: int = BUCKETS, bits: int = FILTER_BITS, hot: float = HOT, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Write both tables into numbered starting files below ``root``, rewrite them into buckets, tell of every final file.

    sales_start, lines_start: number (int, 0 up to buckets) of the starting file of a row.
    """
    folders = [Folder(spark, f"{root}/{name}") for name in names]
    counted, numbers, orders, started = [], [], [], []
    for df, start, folder in zip((sales, lines), (sales_start, lines_start), folders):
        folder.make()
        number = unused(df, "file_number")
        order = sort_order(df, key)
        started.append(df.withColumn(number, start))
        counted.append(write_numbered(started[-1], number, folder, "start", order, buckets + 1, hot, hot_rows))
        numbers.append(number)
        orders.append(order)
    schemas = [sales.schema, lines.schema]
    at, known = F.col(key), F.col(key).isNotNull()

    # which lines' keys are sales'
    first = key_filter(started[0].select(at.cast("long").alias("key")), bits)
    may_be_sale = held(spark, first, bits)
    ids = [df.select(at.cast("long").alias("key")).where("key IS NOT NULL") for df in started]
    by_key = [df.groupBy("key").agg(F.count(F.lit(1)).alias(n)).withColumn("bucket", bucket_of(F.col("key"), buckets=buckets)) for df, n in ((ids[0], "n_sales"), (ids[1].where(may_be_sale("key")), "n_lines"))]
    parts = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = [df.withColumn("part", F.col("bucket") % parts).repartitionById(parts, F.col("part")) for df in by_key]
    verified = materialize(dealt[1].join(dealt[0].drop("bucket"), ["part", "key"], "left"), "pair-keys")
    joined = verified.where("n_sales IS NOT NULL").groupBy("bucket").agg(F.sum(F.col("n_lines") * F.col("n_sales")).alias("n_joined"))
    slipped = verified.where("n_sales IS NULL").select(F.col("key").alias("slipped"))
    may_have_slipped = held(spark, key_filter(slipped, bits), bits)

    def placed(df: DataFrame, of_sales: bool, name: str) -> DataFrame:
        """``df`` with the bucket of each row as column ``name``."""
        own = bucket_of(at, buckets=buckets)
        if of_sales:
            return df.withColumn(name, F.when(known, own).otherwise(buckets + 1))
        doubt, out = unused(df, "doubt_"), F.when(~known, buckets + 1)
        told = df.withColumn(doubt, F.when(known, F.when(~may_be_sale(at.cast("long")), 0).when(may_have_slipped(at.cast("long")), 2).otherwise(1)).otherwise(1))
        sure = told.where(F.col(doubt) < 2).withColumn(name, out.when(F.col(doubt) == 0, buckets).otherwise(own))
        fake = slipped.withColumnRenamed("slipped", unused(told, "slipped"))
        open_ = told.where(F.col(doubt) == 2).join(fake, at.cast("long") == F.col(fake.columns[0]), "left")
        open_ = open_.withColumn(name, F.when(F.col(fake.columns[0]).isNotNull(), buckets).otherwise(own))
        columns = [*(column(c) for c in df.columns), F.col(name)]
        return sure.select(*columns).unionByName(open_.select(*columns))

    told = []
    for k, (name, folder, schema, number, order) in enumerate(zip(names, folders, schemas, numbers, orders)):
        bucket = unused(started[k], "bucket_number")
        flow = placed(started[k].select(key, number), k == 0, bucket).groupBy(F.col(number).alias("s"), F.col(bucket).alias("bucket")).count()
        flow = materialize(flow, "pair-flow")
        sizes = flow.groupBy("s").agg(F.sum("count").alias("in_start"))
        plan = flow.join(sizes, "s").groupBy("bucket").agg(
            F.sum("count").alias("n"), F.array_sort(F.collect_list(F.struct("s", "count"))).alias("from"),
            F.max(F.when(F.col("count") == F.col("in_start"), F.col("s"))).alias("whole"),
        )
        stays = F.when(F.size("from") == 1, F.col("whole"))
        plan = materialize(
            plan.select(
                F.lit(name).alias("table_name"), F.col("bucket").cast("long").alias("bucket"), stays.alias("stays"),
                F.sha2(F.array_join(F.transform("from", lambda x: F.concat(x["s"].cast("string"), F.lit(":"), x["count"].cast("string"))), ","), 256).alias("lineage_sha256"),
            ), "pair-plan",
        )
        kept = {r["bucket"]: r["stays"] for r in plan.select("bucket", "stays").collect()}  # buckets + 2 at most
        left = sorted(set(counted[k]) - set(kept.values()))
        if left:
            old = Folder(spark, f"{folder.path}/_old")
            old.make()
            folder.each(lambda x, to=folder: to.move(x, f"_old/{x}"), [f"start-{s:05d}.parquet" for s in left])
            moving = placed(spark.read.schema(schema).parquet(old.path), k == 0, bucket)
            write_numbered(moving, bucket, folder, "bucket", order, buckets + 2, hot, hot_rows)
            folder.remove("_old")
        file = F.when(F.col("stays").isNotNull(), F.format_string("start-%05d.parquet", "stays")).otherwise(F.format_string("bucket-%05d.parquet", "bucket"))
        if kept:
            digests = key_digests(spark, folder.path, schema, key)
            told.append(plan.withColumn("file", file).join(digests, "file").select(
                "table_name", F.concat(F.lit(f"{folder.path}/"), "file").alias("path"), F.lit(",".join(schema.names)).alias("columns"),
                "ids_sha256", "lineage_sha256", "bucket", "n_rows", F.col("stays").isNull().alias("rewritten"),
            ))
    if not told:
        return spark.createDataFrame([], "table_name string, path string, columns string, ids_sha256 string, lineage_sha256 string, bucket long, n_rows long, n_joined long, rewritten boolean")
    out = functools.reduce(DataFrame.unionByName, told).join(joined, "bucket", "left")
    out = out.select("table_name", "path", "columns", "ids_sha256", "lineage_sha256", "bucket", "n_rows", F.coalesce("n_joined", F.lit(0)).cast("long").alias("n_joined"), "rewritten")
    return materialize(out, "pair-files")


def pair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sales`` and ``sale_lines`` as co-bucketed tables in a new folder; a row a file."""
    own = F.coalesce(bucket_of(F.col("sale_id")), F.lit(BUCKETS + 1))
    item = F.coalesce(bucket_of(F.col("item_id"), salt=""), F.lit(0))
    root = f"{workdir(spark)}/pair-{uuid.uuid4().hex}"
    return rewrite(spark, table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"), own - (own % 4 == 1).cast("int"), item, root=root)
