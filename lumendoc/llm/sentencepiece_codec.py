"""SentencePiece encoding and decoding through a distinct-chunk table.

Where no piece of the model goes on past a white-space marker (U+2581 after
another character) and normalisation changes nothing, the segmentation of a
text is the concatenation of the segmentations of its *marked words*: a run of
markers with the characters up to the next marker.  A marked word is also cut
at line feeds when no piece holds one.  So a table of distinct marked words is
kept per task: each word is segmented by the library when it is first met, and
every text is encoded by joining the table's ids back by position, with array
arithmetic.  The table is bounded (``table_entries``); it is emptied when full,
which costs time and never changes a result.  Models for which the condition
does not hold are encoded a whole text at a time by the library.

Cases: a null text counts as empty; an empty text has no ids but the end id;
texts of any length are encoded whole, in groups of about ``GROUP_BYTES``;
columns of the input other than the text are kept as they are; an empty table
gives an empty result.  Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import row_groups

MARK = "▁"
#: Texts are worked on in groups of about this many bytes.
GROUP_BYTES = 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Encodes texts by a table of distinct marked words (see the module)."""

    def __init__(self, model: bytes, table_entries: int = 300_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        normal = [p.piece for p in proto.pieces if p.type in (1, 4, 5)]
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.eos = self.whole.eos_id()
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.splits = (
            not norm.precompiled_charsmap
            and not norm.remove_extra_whitespaces
            and norm.escape_whitespaces
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and proto.trainer_spec.byte_fallback
            and not any(MARK in p.lstrip(MARK) for p in normal)
        )
        line = "" if any("\n" in p for p in normal) else "\n"
        self.pattern = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+" + ("|\n+" if line else ""))
        norm.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.table_entries = table_entries
        self.clear()

    def clear(self) -> None:
        """Code 0 of the table is the end id."""
        self.codes: dict[str, int] = {}
        self.ids = np.array([self.eos], dtype=np.int32)
        self.starts, self.lens = np.zeros(1, np.int64), np.ones(1, np.int64)

    def _segment(self, words: list[str]) -> None:
        """Add new distinct words to the table."""
        found = self.plain.encode(words, num_threads=1)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int32, int(lens.sum()))
        starts = len(self.ids) + np.cumsum(lens) - lens
        base = len(self.starts)
        self.codes.update((w, base + k) for k, w in enumerate(words))
        self.ids = np.concatenate([self.ids, flat])
        self.starts, self.lens = np.concatenate([self.starts, starts]), np.concatenate([self.lens, lens])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of the texts), each text closed by the end id."""
        if not self.splits:
            found = self.whole.encode(texts, num_threads=1, add_eos=True)
            lens = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for x in found for i in x), np.int32, int(lens.sum())), np.concatenate([[0], np.cumsum(lens)])
        find, prefix = self.pattern.findall, self.prefix
        chunks, counts = [], []
        for text in texts:
            words = find(prefix + text.replace(" ", MARK)) if text else []
            chunks.append(words)
            counts.append(len(words) + 1)
        distinct = set().union(*chunks)
        fresh = [w for w in distinct if w not in self.codes]
        if len(self.codes) + len(fresh) > self.table_entries and self.codes:
            self.clear()
            fresh = list(distinct)
        if fresh:
            self._segment(fresh)
        get = self.codes.__getitem__
        codes = np.zeros(sum(counts), np.int64)
        at = 0
        for words, n in zip(chunks, counts):
            codes[at : at + n - 1] = np.fromiter(map(get, words), np.int64, n - 1)
            at += n
        lens = self.lens[codes]
        ends = np.cumsum(lens)
        flat = self.ids[np.repeat(self.starts[codes] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]
        last = np.cumsum(counts) - 1
        return flat, np.concatenate([[0], ends[last]]) if len(counts) else np.zeros(1, np.int64)


def encode(docs: DataFrame, model_file: str | None = None, *, text: str = "text", ids: str = "ids", decoded: str | None = None, same: str | None = None, keep: list[str] | None = None, table_entries: int = 300_000) -> DataFrame:
    """Append ``ids`` (array of int, closed by the end id), and where ``decoded``
    names a column, the text that the library's ``decode(ids)`` gives; where
    ``same`` does, whether that is the text.

    The model's bytes travel with the function, so executors need no file.
    A column of the input that bears a new column's name is replaced; ``keep``
    names the columns to carry on (all, if None).
    """
    with open(model_file or default_model(), "rb") as f:
        model = f.read()
    kept = [c for c in docs.columns if c not in (ids, decoded, same) and (keep is None or c in keep)]
    fields = [docs.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    fields += [T.StructField(decoded, T.StringType(), False)] if decoded else []
    fields += [T.StructField(same, T.BooleanType(), False)] if same else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model, table_entries)
        for part in (group for batch in batches for group in row_groups(batch, text, GROUP_BYTES)):
            column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
            texts = [x or "" for x in column(text).to_pylist()]
            flat, offsets = table.encode(texts)
            out = [*map(column, kept), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]
            if decoded or same:
                back = table.whole.decode([flat[i:j].tolist() for i, j in zip(offsets[:-1], offsets[1:])], num_threads=1)
                out += [pa.array(back, pa.string())] if decoded else []
                out += [pa.array([x == y for x, y in zip(back, texts)], pa.bool_())] if same else []
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return docs.select(*kept, *([] if text in kept else [text])).mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, model_file: str | None = None, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Append the text of an id column; a null array gives a null text."""
    with open(model_file or default_model(), "rb") as f:
        model = f.read()
    kept = [c for c in encoded.columns if c != decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            each = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = iter(sp.decode([x for x in each if x is not None], num_threads=1))
            out = [batch.column(k) for k in range(batch.num_columns)]
            out.append(pa.array([None if x is None else next(texts) for x in each], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[*kept, decoded])

    return encoded.select(*kept).mapInArrow(run, T.StructType([*(encoded.schema[c] for c in kept), T.StructField(decoded, T.StringType())]))


def encode_query(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded, as digests."""
    from .common import table

    out = encode(table(spark, sf_dir, "documents"), decoded="decoded", keep=["doc_id"])
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
