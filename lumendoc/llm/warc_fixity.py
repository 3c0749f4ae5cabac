"""WARC records, and audits of replicas by Merkle trees.

A record's leaf is the SHA-256 of its bytes.  A file's bytes are cut into
ranges of ``RANGE`` bytes; a range's node hashes the (offset, length, leaf) of
the records that begin in it, in order, and each further level joins ``FANOUT``
neighbouring nodes, up to one root a file.  Two replicas agree on a file if the
roots do.  Else the audit descends level by level, and only below nodes that
differ, so what it reads of the lower levels grows with the damage, not with
the archive.  What differs at the leaves is a record that is ``corrupt``,
``missing`` (in the replica) or ``extra``.

Nodes are keyed by (file, level, place), so no task gathers a file; a node has
a bounded number of children.  Trees are written once a replica.

Cases: null payloads and addresses count as empty; a file that one replica has
not at all differs as a whole; records that repeat an offset in one replica are
hashed together, and reported if the other's differ; a null record id is
carried; empty replicas agree; other columns are ignored.  Bytes of a file that
are no record are rows with their damage (see ``parse``), so fixity covers them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

RANGE, FANOUT = 1 << 16, 16
PER_FILE = 1000
#: Files of records without an id.
NAMELESS_FILES = 1024
VERSION = "WARC/1.0"


def record_bytes(record_id: Column, uri: Column, payload: Column) -> Column:
    """A response record as it stands in a file."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def seal(records: DataFrame, *more: str) -> DataFrame:
    """record_id, length and leaf of records with their bytes; ``more`` columns are kept.  Payloads go no further than this."""
    return records.select("record_id", *more, F.octet_length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("leaf"))


def lay_out(sealed: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """Append the file (``per_file`` ids each; records without an id are dealt out to files below 0) and the offset that records have one after the other."""
    spread = -1 - F.pmod(F.xxhash64("leaf"), F.lit(NAMELESS_FILES))
    at = sealed.withColumn("file", F.coalesce(F.floor(F.col("record_id") / per_file), spread))
    before = Window.partitionBy("file").orderBy("record_id", "leaf").rowsBetween(Window.unboundedPreceding, -1)
    return at.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def leaves(records: DataFrame, ident: str = "record_id") -> DataFrame:
    """Records as read from files (record_id or warc_id, file, offset, length, bytes), with the leaf in place of the bytes."""
    return records.select(F.col(ident).alias("record_id"), "file", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"), F.sha2("bytes", 256).alias("leaf"))


#: Compressed bytes that are fed to the decompressor at once.
PIECE = 1 << 16
_GZIP = b"\x1f\x8b\x08"


def _member(data: memoryview, at: int) -> tuple[int, bytes, str | None]:
    """(bytes used, content, damage) of the gzip member that begins here; what could be read of a damaged one."""
    unpack, raw, end = zlib.decompressobj(31), [], at
    try:
        while end < len(data) and not unpack.eof:
            raw.append(unpack.decompress(data[end : end + PIECE]))
            end = min(end + PIECE, len(data))
    except zlib.error:
        return 0, b"".join(raw), "bad gzip"
    return end - at - len(unpack.unused_data), b"".join(raw), None if unpack.eof else "cut"


def _record(data: bytes, at: int) -> tuple[int, str | None]:
    """(bytes used, damage) of the plain record that begins here; 0 bytes if none can be told."""
    if data[at : at + 5] != b"WARC/":
        return 0, "no header"
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return len(data) - at, "cut"
    lines = data[at:head].decode("utf-8", "replace").split("\r\n")
    sizes = [x.split(":", 1)[1].strip() for x in lines if x.lower().startswith("content-length:")]
    if len(sizes) != 1 or not (sizes[0].isascii() and sizes[0].isdigit()):
        return 0, "bad length"
    used = head + 4 + int(sizes[0]) + 4 - at
    return (used, None) if used <= len(data) - at else (len(data) - at, "cut")


def parse(data: bytes) -> Iterator[tuple[int, int, bytes, str | None]]:
    """(offset, length, bytes, damage) of the records of a file, in order and without gaps.

    Compressed records are a member each; offsets and lengths are the file's.
    Where no record can be read, the stretch up to the next place that may begin
    one is a row of its own, with what is wrong there: ``no header``, ``bad
    length`` (missing, repeated or no number), ``bad gzip``, or ``cut`` (the file
    ends first; such a row has what there is).
    """
    view, at = memoryview(data), 0
    while at < len(data):
        packed = data[at : at + 2] == _GZIP[:2]
        if packed:
            used, raw, damage = _member(view, at)
        else:
            used, damage = _record(data, at)
            raw = None
        if not used:
            found = [x for x in (data.find(b"WARC/", at + 1), data.find(_GZIP, at + 1)) if x >= 0]
            used = (min(found) if found else len(data)) - at
            raw = None
        yield at, used, data[at : at + used] if raw is None else raw, damage
        at += used


def warc_id(raw: bytes) -> str | None:
    """The record's id as it stands between < and >."""
    head = raw.split(b"\r\n\r\n", 1)[0].decode("utf-8", "replace")
    return next((x.split(":", 1)[1].strip().strip("<>") for x in head.split("\r\n") if x.lower().startswith("warc-record-id:")), None)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """record_id (of ids that end in a number), warc_id (any), file (its name), offset, length, bytes and damage of the WARC files below a path; a task reads a file whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    columns = ["record_id", "warc_id", "file", "offset", "length", "bytes", "damage"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                rows = []
                for offset, length, raw, damage in parse(bytes(data)):
                    ident = warc_id(raw) if damage in (None, "cut") else None
                    last = (ident or "").rsplit(":", 1)[-1]
                    number = int(last) if last.isascii() and last.isdigit() and len(last) < 19 else None
                    rows.append((number, ident, name.rsplit("/", 1)[1], offset, length, raw, damage))
                yield pd.DataFrame(rows, columns=columns).astype({"record_id": "Int64"})

    return files.select("path", "content").mapInPandas(run, "record_id long, warc_id string, file string, offset long, length long, bytes binary, damage string")


def levels_of(last: int | None) -> int:
    """Levels above the leaves so that one node covers offset ``last``."""
    return 1 + max(0, math.ceil(math.log((last or 0) // RANGE + 1, FANOUT) - 1e-9))


def build(found: DataFrame, n_levels: int) -> list[DataFrame]:
    """The levels of the trees, lowest first: file, node, hash; the last holds the roots (node 0)."""
    text = F.concat_ws(":", "offset", "length", "leaf")
    at = found.select("file", F.floor(F.col("offset") / RANGE).alias("node"), F.struct("offset", text.alias("h")).alias("c"))
    out = []
    for level in range(n_levels):
        if level:
            at = out[-1].select("file", F.floor(F.col("node") / FANOUT).alias("node"), F.struct(F.col("node").alias("offset"), F.concat_ws(":", "node", "hash").alias("h")).alias("c"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["h"]), "|")
        out.append(materialize(at.groupBy("file", "node").agg(F.sha2(joined, 256).alias("hash")), "merkle-level"))
    return out


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, node) on which two levels differ."""
    at = a.withColumnRenamed("hash", "x").join(b.withColumnRenamed("hash", "y"), ["file", "node"], "full")
    return at.where(~F.col("x").eqNullSafe(F.col("y"))).select("file", "node")


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ: record_id, file, offset, length (the original's where it has the record), status."""
    one, two = (materialize(x.select("record_id", "file", "offset", "length", "leaf"), "leaves") for x in (original, replica))
    last = max((x.agg(F.max("offset")).first()[0] or 0) for x in (one, two))
    n = levels_of(last)
    trees = build(one, n), build(two, n)
    bad = materialize(_differ(trees[0][-1], trees[1][-1]), "bad-nodes")
    for level in range(n - 2, -1, -1):
        above = bad.select("file", F.col("node").alias("up"))
        below = [t[level].withColumn("up", F.floor(F.col("node") / FANOUT)).join(above, ["file", "up"], "left_semi").drop("up") for t in trees]
        bad = materialize(_differ(*below), "bad-nodes")
    rows = []
    for x, mark in ((one, "a"), (two, "b")):
        near = x.withColumn("node", F.floor(F.col("offset") / RANGE)).join(bad, ["file", "node"], "left_semi")
        each = F.array_sort(F.collect_list(F.struct("length", "leaf", "record_id")))
        rows.append(near.groupBy("file", "offset").agg(F.transform(each, lambda r: F.concat_ws(":", r["length"], r["leaf"])).alias(f"{mark}_leaf"), F.max("length").alias(f"{mark}_length"), F.min("record_id").alias(f"{mark}_id")))
    at = rows[0].join(rows[1], ["file", "offset"], "full").where(~F.col("a_leaf").eqNullSafe(F.col("b_leaf")))
    status = F.when(F.col("b_leaf").isNull(), "missing").when(F.col("a_leaf").isNull(), "extra").otherwise("corrupt")
    return at.select(F.coalesce("a_id", "b_id").alias("record_id"), "file", "offset", F.coalesce("a_length", "b_length").alias("length"), status.alias("status"))


def rotten(data: Column) -> Column:
    """The bytes with the fifth from the end changed."""
    n = F.octet_length(data)
    return F.concat(F.substring(data, F.lit(1), n - 5), F.lit("?").cast("binary"), F.substring(data, n - 3, F.lit(4)))


def damaged(laid: DataFrame) -> DataFrame:
    """A replica with known damage: bytes changed in every 97th record, every 89th gone, a copy of every 83rd at an offset of its own."""
    k = F.col("record_id")
    there = laid.where(k % 89 != 7).withColumn("leaf", F.when(k % 97 == 5, F.col("rotten_leaf")).otherwise(F.col("leaf")))
    copies = laid.where(k % 83 == 9).withColumn("offset", F.col("offset") + 1).withColumn("record_id", -k)
    return there.unionByName(copies)


def fixity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` as records of files, audited against a replica with damage by rule."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("record_id"), record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("bytes"))
    laid = materialize(lay_out(seal(pages.withColumn("rotten_leaf", F.sha2(rotten(F.col("bytes")), 256)), "rotten_leaf")), "warc-layout")
    return audit(laid, damaged(laid))


FIXITY_SQL = rf"""
WITH r AS (SELECT page_id AS k, page_id // {PER_FILE} AS file, strlen('{VERSION}' || 'WARC-Type: response' || 'WARC-Record-ID: <urn:record:' || page_id || '>' || 'WARC-Target-URI: ' || coalesce(url, '') || 'Content-Length: ' || strlen(coalesce(html, '')))
                  + 2 * 6 + strlen(coalesce(html, '')) + 4 AS length FROM pages),
o AS (SELECT *, (sum(length) OVER (PARTITION BY file ORDER BY k) - length)::bigint AS "offset" FROM r)
SELECT k AS record_id, file, "offset", length, CASE WHEN k % 89 = 7 THEN 'missing' ELSE 'corrupt' END AS status FROM o WHERE k % 97 = 5 OR k % 89 = 7
UNION ALL SELECT -k, file, "offset" + 1, length, 'extra' FROM o WHERE k % 83 = 9
"""
