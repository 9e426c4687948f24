"""Repeated byte strings across documents, by two-stage suffix sorting of bounded text shards.

Texts that are equal as a whole collapse first: the smallest doc_id's row stands for all of them, and any other
loses all its bytes. What is left is written once, in packs of about PACK_BYTES (or one longer document).

Every 50-byte string is dealt by its minimiser (the smallest hash of its 16-byte substrings), so equal strings meet wherever
they stand. Runs of strings with one minimiser travel as one segment of text.

1. Packs tell their distinct minimisers; parts of the hash space answer which of them occur in several documents, and which
   are hot: whose segments add up to more than HOT_BYTES. A hot minimiser is split into its single strings, which are asked
   for again by their own hashes, so that only those that repeat go on.
2. Only segments of shared minimisers go on. Equal segments of a pack collapse to the smallest doc_id that holds them;
   in other documents all their strings are repeats.
3. Segments are sorted by minimiser; a task takes whole minimisers until they hold about SHARD_BYTES. The distinct segments
   of such a shard become one text, whose suffixes are sorted in two stages: those smaller than their successors directly,
   all others by induction over buckets of first bytes. Adjacent suffixes with a common prefix of 50 bytes are equal
   strings, and the smallest doc_id among their owners keeps them.
4. The spans of all repeated strings are merged for each document and cut out.

Hashes only deal work out; equality is decided by bytes, or by SHA-256 for whole texts.

Edge cases: null is empty text; a text of fewer than 50 bytes loses nothing; a row with null
doc_id neither loses bytes nor makes others lose any; rows with equal doc_id do not remove
each other's strings; very long and very repetitive texts are handled whole, in slices; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks as tb
from .tables import Scratch, by_part, rows_of, table

LENGTH = 50
GRAM = 16
PACK_BYTES = 1_000_000
SLICE = 1_000_000
#: Text for each part of the hash space: some half a million minimisers.
PART_BYTES = 8_000_000
SHARD_BYTES = 1_500_000
#: Segment bytes of one minimiser from which its strings are dealt one by one.
HOT_BYTES = 2_000_000
#: Strings of a segment at most; longer runs of one minimiser (as in "aaaa...") are cut into several.
PIECE = 4096
#: Not a byte of UTF-8 text.
SEPARATOR = 255


# --- two-stage suffix sorting -------------------------------------------------------------


def small_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one is not."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    grows = np.concatenate([text[change] < text[change + 1], [False]])
    run = np.diff(np.concatenate([[0], change + 1, [n]]))
    return np.repeat(grows, run)


def big_endian_words(text: np.ndarray) -> np.ndarray:
    """A view whose element i is the number of bytes i..i+7, ordered as those bytes are; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(LENGTH + 16, np.uint8)])
    return np.ndarray((len(padded) - 7,), ">u8", buffer=padded, strides=(1,))


def sorted_directly(words: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Suffixes in order of their first 56 bytes: sorted by 8 bytes, then again within ties by the next 8."""
    key = words[suffixes].astype(np.uint64)
    order = np.argsort(key)
    suffixes, key = suffixes[order], key[order]
    tied = np.concatenate([[False], key[1:] == key[:-1]])  # equal to the one before it so far
    for depth in range(8, 56, 8):
        inside = tied.copy()
        inside[:-1] |= tied[1:]
        at = np.flatnonzero(inside)
        if not len(at):
            break
        group = np.cumsum(~tied[at])
        key = words[suffixes[at] + depth].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(group[order], kind="stable")]
        suffixes[at], key = suffixes[at[order]], key[order]
        tied[at[1:]] = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
    return suffixes


def two_stage_suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes ordered by at least their first 56 bytes (ties in any order)."""
    n = len(text)
    small = small_types(text)
    # stage one: only the suffixes smaller than their successors
    direct = sorted_directly(big_endian_words(text), np.flatnonzero(small))
    # stage two: buckets by first byte; in each, induced suffixes stand before the direct ones
    direct_at = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(suffixes: np.ndarray, c: int) -> np.ndarray:
        """Hands the larger-typed predecessors of suffixes to their buckets; returns those of bucket c itself."""
        before = suffixes[suffixes > 0] - 1
        before = before[~small[before]]
        byte = text[before]
        same = before[byte == c]
        other, byte = before[byte != c], byte[byte != c]
        order = np.argsort(byte, kind="stable")
        other, byte = other[order], byte[order]
        edge = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]])) if len(byte) else np.zeros(0, np.int64)
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(byte)], strict=False):
            induced[int(byte[a])].append(other[a:b])
        return same

    last = np.array([n - 1])  # its successor is the empty suffix, the smallest of all
    induced[int(text[-1])].append(last)
    for c in range(256):
        if direct_at[c] == direct_at[c + 1] and not induced[c]:
            continue
        part = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(part):
            out.append(part)
            part = induce(part, c)
        part = direct[direct_at[c] : direct_at[c + 1]]
        if len(part):
            out.append(part)
            induce(part, c)
        induced[c] = []
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order, up to LENGTH; 0 for the first."""
    words = big_endian_words(text)
    out = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    for depth in range(0, LENGTH, 8):
        differ = words[order[at] + depth].astype(np.uint64) ^ words[order[at - 1] + depth].astype(np.uint64)
        equal = differ == 0
        lead = sum(differ[~equal] < np.uint64(1 << 64 - 8 * k) for k in range(1, 8))  # whole leading bytes that agree
        out[at[~equal]] = depth + lead
        out[at[equal]] = depth + 8
        at = at[equal]
    return np.minimum(out, LENGTH)


# --- packs, minimisers and segments -------------------------------------------------------

PACKS = "pack long, bytes long, ids binary, sizes binary, shas binary, data binary"
PACK_SCHEMA = pa.schema([("pack", pa.int64()), ("bytes", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("shas", pa.binary()), ("data", pa.binary())])


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sha, doc_id, text) -> packs of whole documents; numbers are those of the attempt whose output is kept."""
    number = TaskContext.get().partitionId() << 32
    for block in tb.blocks(tb.merged_batches(batches, PACK_BYTES), limit=PACK_BYTES):
        ids = tb.column(block.rows, "doc_id").to_numpy().astype(np.int64)
        shas = b"".join(tb.column(block.rows, "sha").to_pylist())
        row = [number, len(block.data), ids.tobytes(), (block.ends - block.starts).tobytes(), shas, pa.compress(block.data, "zstd", asbytes=True)]
        number += 1
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, PACK_SCHEMA, strict=True)], schema=PACK_SCHEMA)


class Pack:
    def __init__(self, row: dict) -> None:
        self.number = row["pack"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.shas = row["shas"]
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.data = np.frombuffer(pa.decompress(row["data"], row["bytes"], "zstd"), np.uint8)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def runs(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of LENGTH-byte strings with one minimiser: (its key, document, first start, last start + 1)."""
        found = [self.runs_of_slice(a) for a in range(0, max(1, len(self.data) - LENGTH), SLICE)]
        least, docs, first, end = (np.concatenate([f[k] for f in found]) for k in range(4))
        return part_keys(least, parts), docs, first, end

    def runs_of_slice(self, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Those of the strings that start from begin on, up to SLICE of them."""
        data = self.data[begin : begin + SLICE + LENGTH - 1]
        least = gram_minima(data)
        low, high = np.maximum(self.starts, begin), np.minimum(self.ends - LENGTH + 1, begin + SLICE)
        sizes = np.maximum(high - low, 0)  # strings that lie in one document
        docs = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(docs)) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        least = least[at - begin]
        fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (docs[1:] != docs[:-1])]) if len(at) else np.zeros(0, bool)
        edge = np.flatnonzero(fresh)
        if len(edge) and len(at) > PIECE:
            place = np.arange(len(at)) - np.repeat(edge, np.diff(np.concatenate([edge, [len(at)]])))
            edge = np.flatnonzero(place % PIECE == 0)
        end = np.concatenate([edge[1:], [len(at)]]).astype(np.int64) if len(edge) else edge
        return least[edge], docs[edge], at[edge], at[end - 1] + 1


def gram_minima(data: np.ndarray) -> np.ndarray:
    """For each LENGTH-byte string of data, the smallest hash of its GRAM-byte substrings."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64)
    word = data.astype(np.uint64)
    for half in (1, 2, 4):
        word = (word[: len(word) - half] << np.uint64(8 * half)) | word[half:]
    least = tb.mix(word[: n - GRAM + 1] * tb.BASE)
    for k in range(8, GRAM, 8):
        least = tb.mix((least ^ word[k : k + n - GRAM + 1]) * tb.BASE)
    width, span = LENGTH - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return least


def part_keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """What stands for a hash: its part, and 32 of its bits. Two hashes with one key only share work."""
    return ((hashes >> np.uint64(32)) % np.uint64(parts) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def edges(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


ASKED = "part long, pack long, level int, keys binary, weights binary"
ASKED_SCHEMA = pa.schema([("part", pa.int64()), ("pack", pa.int64()), ("level", pa.int32()), ("keys", pa.binary()), ("weights", pa.binary())])
SEVERAL = 128


def asked(pack: int, level: int, keys: np.ndarray, owners: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """A pack's distinct keys, by part: 32 bits and a weight for each (log2 of its bytes; SEVERAL if several doc_ids hold it)."""
    order = np.argsort(keys, kind="stable")
    keys, owners, sizes = keys[order], owners[order], sizes[order]
    start = edges(keys)
    weight = np.zeros(0, np.uint8)
    if len(start):
        weight = np.ceil(np.log2(np.add.reduceat(sizes, start))).astype(np.uint8)
        weight |= np.where(np.minimum.reduceat(owners, start) != np.maximum.reduceat(owners, start), SEVERAL, 0).astype(np.uint8)
    keys = keys[start]
    part, low = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    cut = edges(part)
    ends = np.concatenate([cut[1:], [len(part)]]).astype(np.int64)
    binary = lambda x: pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer((np.concatenate([[0], ends]) * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
    return pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(np.full(len(cut), pack)), pa.array(np.full(len(cut), level, np.int32)), binary(low), binary(weight)], schema=ASKED_SCHEMA)


def ask(parts: int):
    """Packs -> their minimisers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pack = Pack(row)
                keys, docs, first, end = pack.runs(parts)
                yield asked(pack.number, 1, keys, pack.ids[docs], end - first + LENGTH - 1)

    return run


TOLD = "pack long, part long, level int, codes binary"
ALONE, SHARED, HOT = 0, 1, 2


def tell(hot_bytes: int):
    """Asked keys, sorted by part -> a code for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_part(batches, "part"):
            own = [np.frombuffer(x.as_buffer(), np.uint32) for c in rows["keys"].chunks for x in c]
            size = np.array([len(x) for x in own])
            keys = np.concatenate(own)
            weights = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for c in rows["weights"].chunks for x in c])
            order = np.argsort(keys, kind="stable")
            start = edges(keys[order])
            times = np.diff(np.concatenate([start, [len(order)]]))
            weights = weights[order]
            several = (np.bitwise_or.reduceat(weights, start) >= SEVERAL) | (times > 1)
            total = np.add.reduceat(np.exp2((weights & np.uint8(SEVERAL - 1)).astype(float)), start)
            level = rows["level"].to_numpy()
            code = np.where(several, np.where((total > hot_bytes) & (level[0] == 1), HOT, SHARED), ALONE).astype(np.uint8)
            codes = np.empty(len(order), np.uint8)
            codes[order] = np.repeat(code, times)
            at = np.cumsum(size) - size
            some = np.add.reduceat(codes, at, dtype=np.int64) > 0 if len(at) else np.zeros(0, bool)
            pieces = [codes[a : a + n].tobytes() for a, n in zip(at[some].tolist(), size[some].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows["pack"].to_numpy()[some]), pa.array(np.full(len(pieces), part)), pa.array(level[some]), pa.array(pieces, pa.binary())], ["pack", "part", "level", "codes"])

    return run


def codes_of(keys: np.ndarray, told: pa.Table) -> np.ndarray:
    """The code of each key of a pack from the parts' answers; keys of parts that did not answer occur nowhere else."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    code = np.zeros(len(distinct), np.uint8)
    for part, codes in zip(told["part"].to_pylist(), told["codes"].to_pylist(), strict=True):
        at = int(np.searchsorted(distinct, np.uint64(part << 32)))
        code[at : at + len(codes)] = np.frombuffer(codes, np.uint8)
    return code[inverse]


SEGMENTS = "kind int, key long, pack long, owner long, doc int, start int, body binary"
SEGMENT_SCHEMA = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("pack", pa.int64()), ("owner", pa.int64()), ("doc", pa.int32()), ("start", pa.int32()), ("body", pa.binary())])
#: What a row of SEGMENTS holds: a segment of text; spans already known to repeat; the hot segments of a pack; a question about their strings.
SEGMENT, KNOWN, HOT_TEXT, QUESTION = 0, 1, 2, 3


def single(kind: int, pack: int, body: bytes, key: int = 0) -> pa.Table:
    row = [kind, key, pack, None, None, None, body]
    return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, SEGMENT_SCHEMA, strict=True)], schema=SEGMENT_SCHEMA)


def span_bytes(*arrays: np.ndarray) -> bytes:
    return b"".join(a.astype(np.int32).tobytes() for a in arrays)


def segment_rows(pack: int, data: np.ndarray, keys: np.ndarray, owner: np.ndarray, doc: np.ndarray, where: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[pa.Table]:
    """Rows of segments (bytes first to first + size of data, at where of a document). Of equal ones the smallest doc_id's go on, in all others they are repeats."""
    if not len(keys):
        return []
    group = tb.equal_spans(data, first, size)
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, owner)
    keep = owner == least[group]
    out = []
    if not keep.all():
        known = ~keep
        out.append(single(KNOWN, pack, span_bytes(*tb.merge_spans(doc[known], where[known], where[known] + size[known]))))
    at = np.flatnonzero(keep)
    body = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size[at])]).astype(np.int32)), pa.py_buffer(tb.gather(data, first[at], size[at]))])
    columns = [pa.array(np.full(len(at), SEGMENT, np.int32)), pa.array(keys[at].view(np.int64)), pa.array(np.full(len(at), pack)), pa.array(owner[at]), pa.array(doc[at].astype(np.int32)), pa.array(where[at].astype(np.int32)), body]
    return [*out, pa.Table.from_arrays(columns, schema=SEGMENT_SCHEMA)]


def segments(parts: int):
    """Cogrouped pack and answers -> its segments of shared minimisers; those of hot ones aside, with questions about their strings."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return SEGMENT_SCHEMA.empty_table()
        pack = Pack(left.to_pylist()[0])
        keys, docs, first, end = pack.runs(parts)
        code = codes_of(keys, right)
        owner, where, size = pack.ids[docs], first - pack.starts[docs], end - first + LENGTH - 1
        rows = (keys, owner, docs, where, first, size)
        out = segment_rows(pack.number, pack.data, *(x[code == SHARED] for x in rows))
        if (code == HOT).any():
            _, owner, docs, where, first, size = (x[code == HOT] for x in rows)
            hot = HotText(owner, docs, where, size, tb.gather(pack.data, first, size))
            out.append(single(HOT_TEXT, pack.number, hot.packed()))
            keys, owner, _, _, _, size = hot.strings(parts)
            question = asked(pack.number, 2, keys, owner, size).to_pydict()
            out += [single(QUESTION, pack.number, k + w, part) for part, k, w in zip(question["part"], question["keys"], question["weights"], strict=True)]
        return pa.concat_tables(out) if out else SEGMENT_SCHEMA.empty_table()

    return run


class HotText:
    """The segments of a pack's hot minimisers: owner, document and place of each, and their texts one after another."""

    def __init__(self, owner: np.ndarray, doc: np.ndarray, where: np.ndarray, size: np.ndarray, data: np.ndarray) -> None:
        self.owner, self.doc, self.where, self.size, self.data = owner, doc, where, size, data

    def packed(self) -> bytes:
        whole = b"".join([np.int64(len(self.owner)).tobytes(), *(x.astype(np.int64).tobytes() for x in (self.owner, self.doc, self.where, self.size)), self.data.tobytes()])
        return np.int64(len(whole)).tobytes() + pa.compress(whole, "zstd", asbytes=True)

    @classmethod
    def unpacked(cls, body: bytes) -> HotText:
        whole = pa.decompress(body[8:], int(np.frombuffer(body, np.int64, 1)[0]), "zstd", asbytes=True)
        n = int(np.frombuffer(whole, np.int64, 1)[0])
        return cls(*np.frombuffer(whole, np.int64, 4 * n, 8).reshape(4, n), np.frombuffer(whole, np.uint8, offset=8 + 32 * n))

    def strings(self, parts: int) -> tuple[np.ndarray, ...]:
        """(key, owner, document, place, first byte, size) of the single strings; equal ones that follow each other stay together."""
        times = self.size - LENGTH + 1
        run = np.repeat(np.arange(len(times)), times)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(np.cumsum(self.size) - self.size, times) + inside
        keys = part_keys(tb.span_hash(self.data, at, at + LENGTH), parts)
        edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (run[1:] != run[:-1])])) if len(at) else at
        size = np.diff(np.concatenate([edge, [len(at)]])) + LENGTH - 1
        return keys[edge], self.owner[run[edge]], self.doc[run[edge]], (self.where[run] + inside)[edge], at[edge], size


def string_segments(parts: int):
    """Cogrouped hot text of a pack and answers about its strings -> a segment for each string that others hold."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return SEGMENT_SCHEMA.empty_table()
        hot = HotText.unpacked(left["body"][0].as_py())
        rows = hot.strings(parts)
        shared = codes_of(rows[0], right) > ALONE
        out = segment_rows(left["pack"][0].as_py(), hot.data, *(x[shared] for x in rows))
        return pa.concat_tables(out) if out else SEGMENT_SCHEMA.empty_table()

    return run


SPANS = "pack long, body binary"


def repeats_of_shard(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans (pack, document, start, end) of a shard's strings that a smaller doc_id holds too."""
    pack, owner, doc, begin = (rows[c].to_numpy().astype(np.int64) for c in ("pack", "owner", "doc", "start"))
    bodies = rows["body"].combine_chunks()
    offsets = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
    data = np.frombuffer(bodies.buffers()[2], np.uint8)
    size = np.diff(offsets)
    group = tb.equal_spans(data, offsets[:-1], size)
    n = int(group.max()) + 1
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, group, owner)
    known = owner > least[group]
    spans = [(pack[known], doc[known], begin[known], begin[known] + size[known])]
    # one text of the distinct segments
    only = np.zeros(n, np.int64)
    only[group] = np.arange(len(group))
    width = size[only]
    text = np.full(int(width.sum()) + n, SEPARATOR, np.uint8)
    place = np.cumsum(width + 1) - width - 1
    text[np.repeat(place - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))] = tb.gather(data, offsets[only], width)
    suffixes = two_stage_suffix_array(text)
    strings = width - LENGTH + 1
    segment = np.full(len(text), -1, np.int32)  # of the strings that lie in one segment
    segment[np.repeat(place - (np.cumsum(strings) - strings), strings) + np.arange(int(strings.sum()))] = np.repeat(np.arange(n), strings)
    suffixes = suffixes[segment[suffixes] >= 0]
    first = common_prefixes(text, suffixes) < LENGTH
    holder = least[segment[suffixes]]
    repeat = suffixes[holder > np.minimum.reduceat(holder, np.flatnonzero(first))[np.cumsum(first) - 1]]
    if len(repeat):
        # back to every place of that segment in its smallest document
        seg, a, b = tb.merge_spans(segment[repeat].astype(np.int64), repeat - place[segment[repeat]], repeat - place[segment[repeat]] + LENGTH)
        holders = np.flatnonzero(~known)
        holders = holders[np.argsort(group[holders], kind="stable")]
        low, high = np.searchsorted(group[holders], seg), np.searchsorted(group[holders], seg, side="right")
        times = high - low
        who = holders[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
        spans.append((pack[who], doc[who], begin[who] + np.repeat(a, times), begin[who] + np.repeat(b, times)))
    return tuple(np.concatenate([s[k] for s in spans]) for k in range(4))


def span_rows(pack: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(pack, kind="stable")
    pack, doc, start, end = pack[order], doc[order], start[order], end[order]
    cut = edges(pack)
    bodies = [span_bytes(*tb.merge_spans(doc[a:b], start[a:b], end[a:b])) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(pack)], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(pack[cut]), pa.array(bodies, pa.binary())], ["pack", "body"])


def shard_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by key -> repeated spans. Shards end between keys, and each holds whole keys."""
    found, pending = [], 0
    for shard in shards(batches):
        spans = repeats_of_shard(shard)
        found.append(spans)
        pending += len(spans[0])
        if pending > 200_000:
            yield span_rows(*(np.concatenate([f[k] for f in found]) for k in range(4)))
            found, pending = [], 0
    if found:
        yield span_rows(*(np.concatenate([f[k] for f in found]) for k in range(4)))


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        key = tb.column(batch, "key").to_numpy()
        if not len(key):
            continue
        reach = np.concatenate([[0], np.cumsum(pc.binary_length(tb.column(batch, "body")).to_numpy(), dtype=np.int64)])
        if size >= SHARD_BYTES and key[0] != tb.column(held[-1], "key")[-1].as_py():
            yield pa.Table.from_batches(held)
            held, size = [], 0
        begin = 0
        while begin < len(key):
            # from the row that fills the shard on to the next change of key
            full = max(begin + 1, int(np.searchsorted(reach, reach[begin] + SHARD_BYTES - size)))
            change = np.flatnonzero(key[full:] != key[full - 1 : -1])
            end = full + int(change[0]) if len(change) else len(key)
            held.append(batch.slice(begin, end - begin))
            size += int(reach[end] - reach[begin])
            if len(change):
                yield pa.Table.from_batches(held)
                held, size = [], 0
            begin = end
    if held:
        yield pa.Table.from_batches(held)


CUT = "sha binary, starts array<long>, ends array<long>, kept_sha256 string"
CUT_SCHEMA = pa.schema([("sha", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept_sha256", pa.string())])


def cut(left: pa.Table, right: pa.Table) -> pa.Table:
    """Cogrouped pack and spans -> what stays of each document that loses something."""
    if not left.num_rows or not right.num_rows:
        return CUT_SCHEMA.empty_table()
    pack = Pack(left.to_pylist()[0])
    spans = [np.frombuffer(p, np.int32).reshape(3, -1) for p in right["body"].to_pylist()]
    key, start, end = tb.merge_spans(*np.concatenate(spans, 1).astype(np.int64))
    first = edges(key)
    digests = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
        k = key[a]
        digest, at = hashlib.sha256(), pack.starts[k]
        for s, e in zip((pack.starts[k] + start[a:b]).tolist(), (pack.starts[k] + end[a:b]).tolist(), strict=True):
            digest.update(pack.data[at:s])
            at = e
        digest.update(pack.data[at : pack.ends[k]])
        digests.append(digest.hexdigest())
    offsets = np.concatenate([first, [len(key)]]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (start, end)]
    return pa.Table.from_arrays([pa.array([pack.shas[32 * k : 32 * k + 32] for k in key[first].tolist()], pa.binary()), *lists, pa.array(digests, pa.string())], schema=CUT_SCHEMA)


def repeated_bytes(docs: DataFrame, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows_of(docs).select(F.col("doc_id").cast("long"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"))

    # one row for each distinct text, the one with the smallest doc_id; a partial minimum comes before the shuffle
    usable = rows.filter(f"doc_id is not null and n_bytes >= {LENGTH}")
    least = usable.groupBy("sha").agg(F.min(F.struct("doc_id", "text")).alias("least")).select("sha", "least.doc_id", "least.text")
    packs = scratch.save(least.mapInArrow(packed_texts, PACKS), "packs")
    del least, usable
    scratch.drop()
    total = packs.agg(F.sum("bytes")).first()[0] or 0
    parts = max(tasks, total // PART_BYTES + 1)

    def answers(keys: DataFrame, name: str) -> DataFrame:
        dealt = keys.repartition(max(tasks, parts // 4), "part").sortWithinPartitions("part")
        told = scratch.save(dealt.mapInArrow(tell(hot_bytes), TOLD), name)
        del dealt, keys
        scratch.drop()
        return told

    known = answers(packs.mapInArrow(ask(parts), ASKED), "told")
    found = scratch.save(packs.groupBy("pack").cogroup(known.groupBy("pack")).applyInArrow(segments(parts), SEGMENTS), "segments")
    scratch.drop("told")
    everything = found
    hot = found.filter(f"kind = {HOT_TEXT}").select("pack", "body")
    if not hot.isEmpty():
        n = "length(body) div 5"
        questions = found.filter(f"kind = {QUESTION}").select(F.col("key").alias("part"), "pack", F.lit(2).alias("level"), F.expr(f"substring(body, 1, cast(4 * ({n}) as int))").alias("keys"), F.expr(f"substring(body, cast(4 * ({n}) + 1 as int))").alias("weights"))
        again = answers(questions, "told-again")
        strings = scratch.save(hot.groupBy("pack").cogroup(again.groupBy("pack")).applyInArrow(string_segments(parts), SEGMENTS), "strings")
        scratch.drop("told-again")
        everything = found.unionByName(strings)
    dealt = everything.filter(f"kind = {SEGMENT}").select("key", "pack", "owner", "doc", "start", "body").repartition(tasks, "key").sortWithinPartitions("key")
    spans = scratch.save(dealt.mapInArrow(shard_repeats, SPANS).unionByName(everything.filter(f"kind = {KNOWN}").select("pack", "body")), "spans")
    del dealt, everything, found, hot
    scratch.drop("segments", "strings")
    kept = scratch.save(packs.groupBy("pack").cogroup(spans.groupBy("pack")).applyInArrow(cut, CUT), "cut")
    scratch.drop("packs", "spans")

    # back to all rows: a copy of a smaller doc_id's text loses all its bytes
    first = scratch.save(rows.filter(f"doc_id is not null and n_bytes >= {LENGTH}").groupBy("sha").agg(F.min("doc_id").alias("first")), "first")
    whole = F.col("doc_id") > F.col("first")
    own = F.col("doc_id") == F.col("first")
    joined = rows.select("doc_id", "n_bytes", "sha").join(first, "sha", "left").join(kept, "sha", "left")
    nothing = F.array().cast("array<long>")
    starts = F.when(whole, F.array(F.lit(0).cast("long"))).when(own, F.coalesce("starts", nothing)).otherwise(nothing)
    ends = F.when(whole, F.array("n_bytes")).when(own, F.coalesce("ends", nothing)).otherwise(nothing)
    sha = F.when(whole, F.sha2(F.lit(""), 256)).when(own & F.col("kept_sha256").isNotNull(), F.col("kept_sha256")).otherwise(F.lower(F.hex("sha")))
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    out = joined.select("doc_id", "n_bytes", sha.alias("kept_sha256"), starts.alias("starts"), ends.alias("ends"))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256", "starts", "ends")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
