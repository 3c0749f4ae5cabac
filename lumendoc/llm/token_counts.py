"""Tokens of a document counted by section, from one encoding of the whole text.

A document is encoded once with a byte-level BPE, whose tokens' byte lengths
give each token's span; running sums of both make the spans of tokens and of
sections sorted lists, and they are interval-joined by binary search.  A token
that crosses a boundary goes to one section by an explicit rule: ``first`` (the
section of its first byte), ``last`` (of its last byte) or ``most`` (the one
that holds most of its bytes, the earlier of equals).  Bytes in no section
belong to section -1.

Sections are given as an array of (start, end) in characters, sorted and not
overlapping, or are the lines of the text, each with the line feed that ends
it.

Cases: null text counts as empty; an empty text has one empty section (as a
split by lines does) and no tokens; null sections are none, so all tokens are
of section -1; texts of any length are encoded whole; repeated rows give
repeated results; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULES = ("first", "last", "most")
OUT = "doc_id long, n_tokens long, section array<int>, start array<long>, end array<long>, tokens array<long>, crossing array<long>"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(2)
def _encoding(ranks: bytes, pattern: str):
    """(tokenizer, byte length of every id); kept by a worker."""
    import tiktoken

    got = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    lens = np.zeros(max(got.values()) + 1, np.int64)
    for piece, k in got.items():
        lens[k] = len(piece)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=got, special_tokens={}), lens


def line_bounds(data: np.ndarray) -> np.ndarray:
    """Byte bounds of the lines of a text."""
    return np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data)]])


def assign(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of every token, whether it crosses a bound); ends: tokens' ends
    in bytes, the first starting at 0; starts, stops: sections' spans."""
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    at = lambda byte: np.searchsorted(starts, byte, "right") - 1
    inside = lambda k, byte: np.where((k >= 0) & (byte < stops[np.maximum(k, 0)]), k, -1) if len(stops) else np.full(len(byte), -1)
    lead, tail = at(begins), at(ends - 1)
    first, last = inside(lead, begins), inside(tail, ends - 1)
    crossing = (first != last) | (lead != tail)
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    out = first.copy()
    for t in np.flatnonzero(crossing):  # few: only tokens over a bound
        spans = [(k, min(ends[t], stops[k]) - max(begins[t], starts[k])) for k in range(max(lead[t], 0), tail[t] + 1)]
        best = max((n for _, n in spans), default=0)
        free = ends[t] - begins[t] - sum(max(n, 0) for _, n in spans)
        out[t] = -1 if free > best or best <= 0 else next(k for k, n in spans if n == best)
    return out, crossing


def attribute(docs: DataFrame, ranks_file: str | None = None, pattern: str | None = None, *, sections: str | None = None, rule: str = "first") -> DataFrame:
    """doc_id, n_tokens and arrays of section, start, end (characters), tokens and crossing tokens."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(ranks_file or default_ranks(), "rb") as f:
        ranks = f.read()
    pattern = pattern or default_pattern()

    def one(encoding, lens, text: str, given) -> tuple:
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        places = np.flatnonzero((data & 0xC0) != 0x80)  # byte of every character
        to_byte = np.append(places, len(data))
        if given is None:
            bounds = line_bounds(data)
            starts, stops = bounds[:-1], bounds[1:]
            chars = np.searchsorted(to_byte, bounds)
            char_starts, char_stops = chars[:-1], chars[1:]
        else:
            char_starts = np.array([g["start"] for g in given], np.int64)
            char_stops = np.array([g["end"] for g in given], np.int64)
            starts, stops = (to_byte[np.clip(x, 0, len(places))] for x in (char_starts, char_stops))
        ids = encoding.encode_to_numpy(text, disallowed_special=())
        ends = np.cumsum(lens[ids])
        k, crossing = assign(ends, starts, stops, rule)
        n = len(starts)
        counts = np.bincount(k + 1, minlength=n + 1)
        over = np.bincount(k[crossing] + 1, minlength=n + 1)
        skip = int(counts[0] == 0)  # section -1 only if it has tokens
        return (
            len(ids), np.arange(-1, n)[skip:], np.concatenate([[0], char_starts])[skip:], np.concatenate([[len(places)], char_stops])[skip:], counts[skip:], over[skip:],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lens = _encoding(ranks, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            given = batch.column(2).to_pylist() if sections else [None] * len(texts)
            for a in range(0, len(texts), 500):
                got = [one(encoding, lens, t or "", (g or []) if sections else None) for t, g in zip(texts[a : a + 500], given[a : a + 500])]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x[1]) for x in got])]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in got]), pa.int32() if k == 1 else pa.int64())) for k in range(1, 6)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 500), pa.array([x[0] for x in got], pa.int64()), *lists], names=["doc_id", "n_tokens", "section", "start", "end", "tokens", "crossing"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([sections] if sections else []))
    return rows.mapInArrow(run, OUT)


def by_section(counted: DataFrame) -> DataFrame:
    """One row a document and section."""
    rows = counted.select("doc_id", "n_tokens", F.explode(F.arrays_zip("section", "start", "end", "tokens", "crossing")).alias("s"))
    return rows.select("doc_id", F.col("n_tokens").alias("doc_tokens"), "s.section", "s.start", "s.end", F.col("s.tokens").alias("n_tokens"), F.col("s.crossing").alias("n_crossing"))


def counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return by_section(attribute(table(spark, sf_dir, "documents")))
