"""Vectorised splitting and hashing of words over whole Arrow string columns.

A batch of texts is one byte buffer plus offsets, so words are found with a
byte-class table and hashed eight bytes at a time for all words at once. Nothing
here depends on the length of one text; callers bound the bytes of a chunk.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one chunk holds at most (a longer text is a chunk alone).
CHUNK_BYTES = 4 << 20

_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xBF58476D1CE4E5B9)
_K3 = np.uint64(0x94D049BB133111EB)

#: True for bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(left * _K1 + (right ^ (right >> np.uint64(32))) + _K3)


def trim() -> None:
    """Gives memory that this worker has freed back to the system, as workers outlive
    their tasks. Does nothing where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


class Chunk:
    """Texts of one chunk and their words.

    ``start``/``end`` are byte positions in ``bytes``; ``doc`` is the row of each
    word, ``first`` the index of each row's first word (one more entry than rows).
    A null text has no words.
    """

    def __init__(self, texts: pa.Array, word_bytes: np.ndarray = NOT_SPACE, lower: bool = False):
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        self.rows = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + self.rows + 1] if self.rows else np.zeros(1, dtype=np.int64)
        data = texts.buffers()[2]
        low, high = int(offsets[0]), int(offsets[-1])
        raw = np.zeros(high - low + 8, dtype=np.uint8)
        if high > low:
            raw[: high - low] = np.frombuffer(data, dtype=np.uint8)[low:high]
        self.offsets = offsets - low
        self.size = high - low
        self.bytes = raw
        inside = word_bytes[raw[: self.size]]
        before = np.zeros(self.size, dtype=bool)
        after = np.zeros(self.size, dtype=bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        edges = self.offsets[:-1]
        before[edges[edges < self.size]] = False
        edges = self.offsets[1:]
        after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.rows + 1))
        self.lower = lower

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        data = LOWER[self.bytes] if self.lower else self.bytes
        lanes = np.ndarray(shape=(self.size + 1,), dtype="<u8", buffer=data, strides=(1,))
        at, left = self.start, self.end - self.start
        out = mix(left.astype(np.uint64) * _K1 + _K2)
        rows = None
        while len(at):
            lane = lanes[at] & _MASKS[np.minimum(left, 8)]
            if rows is None:
                out = mix((out ^ lane) * _K1 + _K3)
            else:
                out[rows] = mix((out[rows] ^ lane) * _K1 + _K3)
            more = np.flatnonzero(left > 8)
            rows = more if rows is None else rows[more]
            at, left = at[more] + 8, left[more] - 8
        return out

    def word(self, k: int) -> bytes:
        return self.bytes[self.start[k] : self.end[k]].tobytes()


def chunks(batch: pa.RecordBatch | pa.Table, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """Row ranges of a batch with at most ``limit`` bytes of text, and their texts."""
    column = batch.column(text)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high, column.slice(low, high - low)
        low = high


def windows(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``length`` words that stay in one row, and their rows."""
    count = np.maximum(np.diff(first) - length + 1, 0)
    rows = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][rows] + within, rows


def gram_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words that start at each word (short at the end)."""
    if len(words) < length:
        return np.zeros(0, dtype=np.uint64)
    n = len(words) - length + 1
    out = mix(words[:n] + np.uint64(length))
    for k in range(1, length):
        out = combine(out, words[k : k + n])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start+1, ... of each range, one range after the other."""
    total = np.cumsum(lengths)
    out = np.arange(int(total[-1]) if len(total) else 0, dtype=np.int64)
    return out + np.repeat(starts - (total - lengths), lengths)
