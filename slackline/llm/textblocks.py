"""Whole texts of Arrow batches as flat byte blocks, with vectorised word spans and hashes.

A block holds whole documents only: text is never cut. A null text is an empty one.
Every document is followed by one separator byte, so spans never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Spans longer than this are hashed by blake2b, one by one.
LONG_SPAN = 512
#: Keeps the first 0..8 bytes of a little-endian word.
HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class Block:
    """rows: the batch's rows of this block. starts/ends: byte spans of the documents in data."""

    rows: pa.RecordBatch
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def long_ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """The ids as int64; a null counts as the smallest long, which no table uses as an id."""
    return column(batch, name).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


NULL_ID = -(2**63)


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES, separator: int = 10) -> Iterator[Block]:
    """Blocks of about limit bytes, or of one document when that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = column(batch, text).cast(pa.large_binary())
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        raw = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        lengths = np.diff(offsets)
        if col.null_count:
            lengths = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, lengths)
        at = 0
        while at < len(lengths):
            take = max(1, int(np.searchsorted(np.cumsum(lengths[at : at + 100_000]), limit, side="right")))
            n = lengths[at : at + take]
            ends = np.cumsum(n + 1) - 1
            starts = ends - n
            data = np.full(int(ends[-1]) + 1, separator, np.uint8)
            for s, e, o in zip(starts.tolist(), ends.tolist(), offsets[at : at + take].tolist(), strict=True):
                data[s:e] = raw[o : o + e - s]
            yield Block(batch.slice(at, take), data, starts, ends)
            at += take


def merged_batches(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Joins small batches of a partition until they hold about limit bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_at(data: np.ndarray) -> np.ndarray:
    """A view whose element i is the little-endian number of bytes i..i+7; bytes beyond the end are 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes, equal hash, wherever they stand.

    A chain of mixing steps over 8-byte words, no polynomial: texts built to collide modulo 2**64 do not."""
    size = ends - starts
    out = mix((size.astype(np.uint64) + np.uint64(1)) * BASE)
    word = words_at(data)
    active = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at = 0
    while len(active):
        left = size[active] - at
        piece = word[starts[active] + at] & HEAD[np.minimum(left, 8)]
        out[active] = mix((out[active] ^ piece) * BASE + np.uint64(at + 1))
        at += 8
        active = active[left > 8]
    for k in np.flatnonzero(size > LONG_SPAN).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after another."""
    return data[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def equal_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Group numbers 0, 1, ... of spans: equal for equal bytes only. Hashes propose, bytes decide."""
    if not len(starts):
        return np.zeros(0, np.int64)
    hashes = span_hash(data, starts, starts + sizes)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    first = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    same = sizes[order] == sizes[first]
    if same.all():
        rest = np.flatnonzero(~fresh)
        same = (gather(data, starts[order[rest]], sizes[order[rest]]) == gather(data, starts[first[rest]], sizes[order[rest]])).all()
    else:
        same = False
    out = np.empty(len(order), np.int64)
    if same:
        out[order] = np.cumsum(fresh) - 1
    else:  # hashes collide: by the bytes themselves
        known: dict[bytes, int] = {}
        for k, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            out[k] = known.setdefault(data[s : s + n].tobytes(), len(known))
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def merge_spans(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans of each key; touching spans join. Sorted by key, then start."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    rank = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
    width = int(end.max()) + 2
    reach = np.maximum.accumulate(end + rank * width)
    first = np.concatenate([[True], (start + rank * width)[1:] > reach[:-1]])
    at = np.flatnonzero(first)
    return key[at], start[at], np.maximum.reduceat(end, at)
