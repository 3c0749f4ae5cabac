"""Where equal keys meet: links between the holders of a key, without ever gathering a group.

A holder (a document, a paragraph) has some 64-bit keys.  Holders with an equal
key are linked, each to the least of them.  Keys meet first within a stretch of
a task's rows and then, one row a stretch and key, within the key's part; a
part is an equal range of the keys' upper half, so a key that a third of all
holders have is one entry a stretch.

What travels: for every (stretch, part) one packed row with the keys' lower 48
bits (the part stands for upper ones; a chance collision only makes a link that
is verified later) and the holders, each once with the keys in its order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .tokens import U

#: Keys that a part gathers on the average, keys that a task holds before it ships them, and most parts.
PART_KEYS, HELD_KEYS = 500_000, 1_500_000
MOST_PARTS = 1 << 20
KEY_BYTES = 6


def parts_for(n_keys: float, shuffle_partitions: int) -> int:
    """Parts grow with the keys; there are several for each shuffle partition, so that tasks are dealt even shares."""
    return int(max(1, min(MOST_PARTS, max(4 * shuffle_partitions, -(-n_keys // PART_KEYS)))))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def runs(keys: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys once each with their least holder, and links of the others to it."""
    order = np.lexsort((holders, keys))
    keys, holders = keys[order], holders[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    least = holders[first][np.cumsum(first) - 1] if len(keys) else holders
    off = ~first & (holders != least)
    links = np.unique(np.stack([holders[off], least[off]], 1), axis=0) if off.any() else np.zeros((0, 2), np.int64)
    return keys[first], holders[first], links


def pack(keys: np.ndarray, holders: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(part, keys, marks of where a new holder begins, holders) of sorted distinct keys."""
    part = part_of(keys, parts)
    order = np.lexsort((holders, part))
    keys, holders, part = keys[order], holders[order], part[order]
    low = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    new = np.concatenate([[True], (holders[1:] != holders[:-1]) | (part[1:] != part[:-1])]) if len(keys) else np.zeros(0, bool)
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(part[a]), low[a:b].tobytes(), np.packbits(new[a:b]).tobytes(), holders[a:b][new[a:b]].tobytes()


def unpack(rows: Iterator[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (their lower bytes) and holders of one part's rows."""
    keys, holders = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for low, marks, own in rows:
        n = len(low) // KEY_BYTES
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :KEY_BYTES] = np.frombuffer(low, np.uint8).reshape(n, KEY_BYTES)
        keys.append(wide.reshape(-1).view(U))
        new = np.unpackbits(np.frombuffer(marks, np.uint8), count=n)
        holders.append(np.frombuffer(own, np.int64)[np.cumsum(new, dtype=np.int64) - 1])
    return np.concatenate(keys), np.concatenate(holders)
