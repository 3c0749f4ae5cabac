"""Words of whole texts as 64-bit hashes, by array arithmetic on UTF-8 bytes.

A-Z are lower-cased and words are runs of bytes other than ASCII white space,
so bytes are enough.  A word's hash is a polynomial of its bytes modulo 2**64,
mixed with its length: the sum over the word of ``(byte + 1) * BASE**place``
comes from one running sum over a stretch of text.  Long words can be made so
that such sums are equal, so words of over ``LONG`` bytes have a digest instead.
A hash depends on the word alone, not on the process or the machine.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once.
STRETCH = 1 << 20
#: Bytes of a word, or words of a run, from which on sums are not trusted.
LONG = 255
U = np.uint64

_lower = np.arange(256, dtype=np.uint64)
_lower[65:91] += U(32)
_VALUE = _lower + U(1)
_LOWER = _lower.astype(np.uint8)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def digest(x: np.ndarray) -> int:
    """64 bits of a cryptographic digest."""
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little")


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * U(0x9FB21C651E98DF25) + mix(b + U(0x2545F4914F6CDD1D)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        n = max(n, STRETCH)
        for k, base in enumerate((BASE, _INVERSE)):
            run = np.full(n, base, dtype=U)
            run[0] = 1
            _tables[k] = np.cumprod(run, dtype=U)
    return _tables[0], _tables[1]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(texts: pa.Array, places: bool = False) -> tuple[np.ndarray, ...]:
    """(hashes of all words in order, offsets of the texts' words); with ``places``, also at which byte of all texts each begins."""
    raw, rows = _bytes_of(texts)
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[rows[:-1]] = True
    hashes, found_at = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    start = 0
    while start < len(raw):
        end = min(start + STRETCH, len(raw))
        if end < len(raw):  # a stretch ends where no word goes on
            open_ = ~_SPACE[raw[start:end]] & ~begins[start + 1 : end + 1] & ~_SPACE[raw[start + 1 : end + 1]]
            shut = np.flatnonzero(~open_)
            if len(shut):
                end = start + int(shut[-1]) + 1
            else:
                while end < len(raw) and not (begins[end] or _SPACE[raw[end]]):
                    end += 1
        part = raw[start:end]
        word = ~_SPACE[part]
        before = np.empty(len(part), dtype=bool)
        before[0] = False
        before[1:] = word[:-1]
        first = np.flatnonzero(word & (~before | begins[start:end]))
        if len(first):
            after = np.empty(len(part), dtype=bool)
            after[-1] = False
            after[:-1] = word[1:] & ~begins[start + 1 : end]
            last = np.flatnonzero(word & ~after)
            power, inverse = _powers(len(part))
            sums = np.cumsum(_VALUE[part] * power[: len(part)], dtype=U)
            low = np.where(first > 0, sums[np.maximum(first, 1) - 1], U(0))
            found = (sums[last] - low) * inverse[first]
            found = mix(found ^ ((last - first + 1).astype(U) * U(0xD6E8FEB86659FD93)))
            for k in np.flatnonzero(last - first >= LONG):
                found[k] = digest(_LOWER[part[first[k] : last[k] + 1]])
            hashes.append(found)
            found_at.append(first + start)
        start = end
    h, p = np.concatenate(hashes), np.concatenate(found_at)
    return (h, np.searchsorted(p, rows), p) if places else (h, np.searchsorted(p, rows))


def shingles(words: np.ndarray, size: int = 3) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted; with fewer words the whole sequence is one."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        h = mix(words[:1] + U(n))
        for k in range(1, n):
            h = join2(h, words[k : k + 1])
        return h
    h = words[: n - size + 1]
    for k in range(1, size):
        h = join2(h, words[k : n - size + 1 + k])
    return np.unique(h)


def row_groups(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """``batch`` in slices of about ``most`` bytes of a string column, and one row at least."""
    _, at = _bytes_of(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
