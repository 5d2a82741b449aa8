"""Encoding whole columns of texts with the public byte-level BPE.

Pre-tokens of that encoding never cross the border between a run of non-space
bytes (with the one blank before it) and what stands around it. So a chunk's
texts are cut into such units, each distinct unit is encoded once, and the ids are
gathered back. A text with white space outside ASCII is encoded as a whole.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import words as W

_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bytes of text that are encoded at once (a longer text alone).
CHUNK_BYTES = 2 << 20
#: Id that ends every document.
END_ID = 0


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _encoder(path: str):
    """The encoding of a tokenizers file; the same vocabulary as ranks beside it is
    used where there is one, as that is faster and gives the same ids."""
    import os

    ranks = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(table.values()) + 1, dtype=np.int64)
        for token, i in table.items():
            sizes[i] = len(token)
        encoding = tiktoken.Encoding("documents", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        return encoding.encode_ordinary, sizes
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(path)
    one.encode_special_tokens = True
    return lambda text: one.encode(text, add_special_tokens=False).ids, None


class _Known:
    """Ids of the units that this worker has met, by hash; bounded."""

    def __init__(self, most: int = 250_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted keys stand, and whether they are known."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        return at, known

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        begin = len(self.flat) + np.cumsum(sizes) - sizes
        self.keys = np.concatenate([self.keys, keys])[order]
        self.begin = np.concatenate([self.begin, begin])[order]
        self.size = np.concatenate([self.size, sizes])[order]
        self.flat = np.concatenate([self.flat, ids])


@functools.cache
def _known(path: str) -> _Known:
    return _Known()


def _encode_units(data: bytes, start: np.ndarray, end: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and id counts of units. Units with a blank before a word are encoded as one
    text, and cut by the bytes of their ids; the others one by one."""
    encode, token_bytes = _encoder(path)
    pieces = [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    sizes = np.zeros(len(pieces), dtype=np.int64)
    joint = np.array([token_bytes is not None and len(p) > 1 and p[0] == 32 and p[1] not in b" \t\n\r\x0b\x0c" for p in pieces], dtype=bool)
    parts: dict[int, list[int]] = {}
    flat = np.zeros(0, dtype=np.uint32)
    if joint.any():
        flat = np.array(encode(b"".join([p for p, j in zip(pieces, joint, strict=True) if j]).decode()), dtype=np.uint32)
        ends = np.cumsum(token_bytes[flat])
        borders = np.searchsorted(ends, np.cumsum((end - start)[joint]), side="left") + 1
        sizes[joint] = np.diff(borders, prepend=0)
    for k in np.flatnonzero(~joint).tolist():
        parts[k] = encode(pieces[k].decode())
        sizes[k] = len(parts[k])
    if parts:
        out = np.zeros(int(sizes.sum()), dtype=np.uint32)
        begin = np.cumsum(sizes) - sizes
        out[W.ranges(begin[joint], sizes[joint])] = flat
        for k, ids in parts.items():
            out[begin[k] : begin[k] + len(ids)] = ids
        flat = out
    return flat, sizes


def _units(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each unit: words with the blank before them, and what
    is left of white space (all of a run but its last byte; that byte alone unless
    it is a blank before a word)."""
    n = len(chunk)
    row_start, row_end = chunk.offsets[:-1], chunk.offsets[1:]
    # the white space before each word, and after each row's last word
    first = np.ones(n, dtype=bool)
    first[1:] = chunk.doc[1:] != chunk.doc[:-1]
    gap_low = np.where(first, row_start[chunk.doc], np.concatenate([[0], chunk.end[:-1]])[:n])
    gap_high = chunk.start
    blank = (gap_high > gap_low) & (chunk.bytes[np.maximum(gap_high - 1, 0)] == 0x20)
    start = chunk.start - blank
    parts = [(start, chunk.end, chunk.doc)]
    # before a word: the run without its last byte, then that byte unless it went to the word
    most = gap_high - 1 > gap_low
    parts.append((gap_low[most], gap_high[most] - 1, chunk.doc[most]))
    alone = (gap_high > gap_low) & ~blank
    parts.append((gap_high[alone] - 1, gap_high[alone], chunk.doc[alone]))
    # at the end of a row a run is one unit
    last = np.array(row_start, copy=True)
    count = np.diff(chunk.first)
    full = count > 0
    last[full] = chunk.end[chunk.first[1:][full] - 1]
    tail = last < row_end
    parts.append((last[tail], row_end[tail], np.flatnonzero(tail)))
    start, end, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(start, kind="stable")
    return start[order], end[order], row[order]


def encode_chunk(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a chunk, one after the other without ends, and the
    number of ids of each text. A null text has none."""
    encode, _ = _encoder(path)
    strings = texts.to_pylist()
    wide = np.array([bool(s) and not s.isascii() and _WIDE_SPACE.search(s) is not None for s in strings], dtype=bool)
    if wide.any():
        texts = pa.array([None if w else s for s, w in zip(strings, wide, strict=True)], pa.large_string())
    chunk = W.Chunk(texts)
    start, end, row = _units(chunk)
    # distinct units by the hash of their bytes
    whole = object.__new__(W.Chunk)
    whole.bytes, whole.size, whole.start, whole.end, whole.lower = chunk.bytes, chunk.size, start, end, False
    keys, at, inverse = np.unique(whole.hashes(), return_index=True, return_inverse=True)
    known = _known(path)
    if len(known.keys) + len(keys) > known.most:
        known.clear()
    _, have = known.find(keys)
    new = ~have
    if new.any():
        ids, sizes = _encode_units(chunk.bytes.tobytes(), start[at][new], end[at][new], path)
        known.add(keys[new], sizes, ids)
    place, _ = known.find(keys)
    per_unit = known.size[place][inverse]
    lengths = np.bincount(row, weights=per_unit, minlength=len(strings)).astype(np.int64)
    ids = known.flat[W.ranges(known.begin[place][inverse], per_unit)]
    if wide.any():
        own = {k: np.array(encode(strings[k]), dtype=np.uint32) for k in np.flatnonzero(wide)}
        cuts = np.cumsum(lengths) - lengths
        ids = np.concatenate([own.get(k, ids[cuts[k] : cuts[k] + lengths[k]]) for k in range(len(strings))])
        for k, x in own.items():
            lengths[k] = len(x)
    return ids, lengths


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For each chunk of (doc_id, text) batches: its rows, all ids, ids per row."""
    for batch in batches:
        for low, high, texts in W.chunks(batch, limit=CHUNK_BYTES):
            yield batch.slice(low, high - low), *encode_chunk(texts, path)
    W.trim()
