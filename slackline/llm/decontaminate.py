"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded run of documents of one partition. Its words become symbols of the
benchmark's vocabulary; any other word is the separator, which no phrase holds, and runs
too short for the shortest phrase are left out. Over what remains an FM-index is built
(suffix array by prefix doubling, wavelet matrix of the BWT, sampled suffix positions).
Phrases are searched backward through wavelet ranks, all at once; their occurrences are
located by LF steps to the next sampled position and merged to removal spans of words.

Words are looked up by hash and compared byte by byte. The benchmark comes in blocks of about ``block_bytes`` of text, each
broadcast as arrays of some 20 times that size at most; documents are read once for each block. With several
blocks their rows are numbered and written first, so that a row's results meet by its number.

Edge cases: null or empty text has no words; an item without words has no phrases; an
item shorter than a phrase is one phrase; an item with null item_id is left out; repeated items and repeated documents (null
ids too) each keep their own result; an empty benchmark contaminates nothing; an empty table gives no rows; very long texts are
a shard of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks as tb
from .tables import Scratch, rows_of, table, texts_of

WINDOW = 10
SHARD_SYMBOLS = 4_000_000
SHARD_DOCS = 100_000
SHARD_BYTES = 64_000_000
BLOCK_BYTES = 8_000_000
SAMPLE = 16

#: Word bytes after lower-casing A-Z: digits, a-z and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True

SPANS = "row_id long, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


class WaveletMatrix:
    """Ranks over a symbol sequence: one bit vector a level, with prefix counts."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.bits: list[np.ndarray] = []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.bits.append(bit)
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[~bit], now[bit]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self.ones[k][at]
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each place, and where descending from that place ends."""
        symbol = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit, ones = self.bits[k][at], self.ones[k][at]
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return symbol, at


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling; a shorter suffix sorts before its extensions."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        got = key[order]
        fresh = np.concatenate([[0], np.cumsum(got[1:] != got[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= n:
            return order


class FMIndex:
    """symbols: 0 is the separator; a unique end symbol is added inside."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = SAMPLE) -> None:
        text = np.concatenate([symbols.astype(np.int64) + 1, [0]])
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n = len(text)
        self.wavelet = WaveletMatrix(bwt, sigma + 2)
        every = np.arange(sigma + 2)
        self.base = self.wavelet.descend(every, np.zeros(len(every), np.int64))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 2))])[:-1]
        self.sampled = order % sample == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.sample_at = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges of phrases of one length (rows); empty where lo >= hi."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, k] + 1
            lo = self.first[symbol] + self.wavelet.descend(symbol, lo) - self.base[symbol]
            hi = self.first[symbol] + self.wavelet.descend(symbol, hi) - self.base[symbol]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out = np.zeros(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.sampled[at]
            out[left[done]] = self.sample_at[self.sample_rank[at[done]]] + steps
            left, at = left[~done], at[~done]
            symbol, place = self.wavelet.access(at)
            at = self.first[symbol] + place - self.base[symbol]
            steps += 1
        return out


@dataclass
class Phrases:
    """A benchmark block: its words in order of their hashes, distinct phrases by length, and the items of each phrase."""

    hashes: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    by_length: dict[int, np.ndarray]
    #: For each length, where a phrase's items begin, and those items (places in names).
    items: dict[int, tuple[np.ndarray, np.ndarray]]
    names: list[str]
    shortest: int

    def symbols(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Symbols (1, 2, ...) of words of lower-case data that are in the vocabulary, 0 for others."""
        out = np.zeros(len(hashes), np.int64)
        left = np.arange(len(hashes))
        place = np.searchsorted(self.hashes, hashes)
        while len(left):  # once, unless words share a hash
            ok = (place < len(self.hashes)) & (self.hashes[np.minimum(place, len(self.hashes) - 1)] == hashes[left])
            left, place = left[ok], place[ok]
            size = self.sizes[place]
            same = size == (ends - starts)[left]
            size = np.where(same, size, 0)
            differ = tb.gather(self.words, self.starts[place], size) != tb.gather(data, starts[left], size)
            wrong = np.bincount(np.repeat(np.arange(len(left)), size), differ, len(left)) > 0
            same &= ~wrong
            out[left[same]] = place[same] + 1
            left, place = left[~same], place[~same] + 1
        return out


def compile_phrases(items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    """items: (item_id, text) rows, in blocks whose size the caller bounds."""
    known = [(str(i), t) for i, t in items if i is not None and t]
    names, item_of = np.unique(np.array([i for i, _ in known], object), return_inverse=True) if known else ([], np.zeros(0, np.int64))
    block = next(tb.blocks([pa.RecordBatch.from_arrays([pa.array([t for _, t in known], pa.string())], ["text"])], limit=2**62), None)
    data = tb.LOWER[block.data] if block else np.zeros(0, np.uint8)
    starts, ends = tb.runs(WORD_BYTE[data])
    owner = block.doc_of(starts) if block else starts
    group = tb.equal_spans(data, starts, ends - starts)
    one = np.zeros(int(group.max(initial=-1)) + 1, np.int64)
    one[group] = np.arange(len(group))
    hashes = tb.span_hash(data, starts[one], ends[one])
    order = np.argsort(hashes, kind="stable")
    symbol_of = np.empty(len(order), np.int64)
    symbol_of[order] = np.arange(1, len(order) + 1)
    symbol = symbol_of[group]
    one = one[order]
    sizes = (ends - starts)[one]
    counts = np.bincount(owner, minlength=len(known)).astype(np.int64)
    first = np.cumsum(counts) - counts
    width = np.minimum(window, counts)
    by_length, members = {}, {}
    for length in np.unique(width[counts > 0]).tolist():
        own = np.flatnonzero(width == length)
        times = counts[own] - length + 1
        at = np.repeat(first[own] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        phrases, which = np.unique(symbol[at[:, None] + np.arange(length)], axis=0, return_inverse=True)
        pair = np.unique(which.reshape(-1) * max(1, len(names)) + np.repeat(item_of[own], times))
        by_length[length] = phrases
        members[length] = (np.searchsorted(pair // len(names), np.arange(len(phrases) + 1)), pair % len(names))
    return Phrases(hashes[order], tb.gather(data, starts[one], sizes), np.cumsum(sizes) - sizes, sizes, by_length, members, list(names), min(by_length, default=0))


class Shard:
    """Collects the phrases' words of documents; search() gives their merged spans and items."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases = phrases
        small = (phrases.hashes & np.uint64(0xFFFF)).astype(np.int64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[small] = True
        self.clear()

    def clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.row_ids: list[np.ndarray] = []
        self.n_words: list[np.ndarray] = []
        self.runs: list[np.ndarray] = []  # rows: document in the shard, first word in it, symbols
        self.symbols: list[np.ndarray] = []
        self.docs = self.size = 0

    def add(self, block: tb.Block, ids: np.ndarray, row_ids: np.ndarray | None = None) -> None:
        data = tb.LOWER[block.data]
        starts, ends = tb.runs(WORD_BYTE[data])
        hashes = tb.span_hash(data, starts, ends)
        owner = block.doc_of(starts)
        n_words = np.bincount(owner, minlength=len(ids))
        first = np.cumsum(n_words) - n_words
        self.ids.append(ids)
        self.row_ids.append(np.zeros(len(ids), np.int64) if row_ids is None else row_ids)
        self.n_words.append(n_words)
        if len(self.phrases.hashes) and len(hashes):
            cand = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            symbol = self.phrases.symbols(data, starts[cand], ends[cand], hashes[cand])
            word, symbol = cand[symbol > 0], symbol[symbol > 0]
            fresh = np.concatenate([[True], (word[1:] != word[:-1] + 1) | (owner[word[1:]] != owner[word[:-1]])]) if len(word) else np.zeros(0, bool)
            run = np.flatnonzero(fresh)
            length = np.diff(np.concatenate([run, [len(word)]]))
            keep = length >= self.phrases.shortest
            if keep.any():
                inside = np.repeat(keep, length)
                run, length = run[keep], length[keep]
                at = word[run]
                self.runs.append(np.stack([owner[at] + self.docs, at - first[owner[at]], length], 1))
                self.symbols.append(np.insert(symbol[inside], np.cumsum(length), 0))
                self.size += int(length.sum()) + len(length)
        self.docs += len(ids)

    def search(self) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], dict[int, set[str]]]:
        """Merged word spans (document, start, end) and the items of each document."""
        items: dict[int, set[str]] = {}
        if not self.symbols:
            none = np.zeros(0, np.int64)
            return (none, none, none), items
        index = FMIndex(np.concatenate(self.symbols), len(self.phrases.hashes) + 1)
        table = np.concatenate(self.runs)
        run_at = np.cumsum(table[:, 2] + 1) - table[:, 2] - 1
        docs, starts, ends = [], [], []
        for length, phrases in self.phrases.by_length.items():
            lo, hi = index.search(phrases)
            hits = np.maximum(hi - lo, 0)
            which = np.repeat(np.arange(len(phrases)), hits)
            rows = np.repeat(lo, hits) + np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits)
            at = index.locate(rows)
            run = np.searchsorted(run_at, at, side="right") - 1
            doc = table[run, 0]
            docs.append(doc)
            starts.append(table[run, 1] + at - run_at[run])
            ends.append(starts[-1] + length)
            begin, members = self.phrases.items[length]
            for pair in np.unique(doc * len(phrases) + which).tolist():
                k = pair % len(phrases)
                items.setdefault(pair // len(phrases), set()).update(self.phrases.names[i] for i in members[begin[k] : begin[k + 1]])
        return tb.merge_spans(np.concatenate(docs), np.concatenate(starts), np.concatenate(ends)), items

    def rows(self) -> pa.RecordBatch:
        (doc, start, end), items = self.search()
        ids, n_words = np.concatenate(self.ids), np.concatenate(self.n_words)
        offsets = np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32)
        names = [sorted(items.get(k, ())) for k in range(len(ids))] if items else [[]] * len(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(self.row_ids)),
                pa.array(ids, mask=ids == tb.NULL_ID),
                pa.array(n_words.astype(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(start.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(end.astype(np.int32))),
                pa.array(names, pa.list_(pa.string())),
            ],
            ["row_id", "doc_id", "n_words", "starts", "ends", "items"],
        )


def scan(phrases):
    """A mapInArrow function from documents (row_id, doc_id, text) to their removal spans; phrases are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(phrases.value)
        for block in tb.blocks(batches):
            shard.add(block, tb.long_ids(block.rows), tb.column(block.rows, "row_id").to_numpy())
            if shard.size >= SHARD_SYMBOLS or shard.docs >= SHARD_DOCS:
                yield shard.rows()
                shard.clear()
        if shard.docs:
            yield shard.rows()

    return run


def clean(phrases):
    """A mapInArrow function from documents to those without a phrase, in shards of at most SHARD_BYTES of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = Shard(phrases.value), []

        def kept() -> Iterator[pa.RecordBatch]:
            (bad, _, _), _ = shard.search()
            stays = np.ones(shard.docs, bool)
            stays[bad] = False
            at = 0
            for rows in held:
                yield rows.filter(pa.array(stays[at : at + rows.num_rows]))
                at += rows.num_rows
            shard.clear()
            held.clear()

        size = 0
        for block in tb.blocks(batches):
            shard.add(block, tb.long_ids(block.rows))
            held.append(block.rows)
            size += len(block.data)
            if shard.size >= SHARD_SYMBOLS or shard.docs >= SHARD_DOCS or size >= SHARD_BYTES:
                yield from kept()
                size = 0
        if held:
            yield from kept()

    return run


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """Benchmark rows in blocks of bounded size; the driver never holds more than one."""
    block: list[tuple[object, str | None]] = []
    size = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def removal_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, merged word spans to remove (starts, ends), items."""
    spark = docs.sparkSession
    blocks = item_blocks(benchmark, block_bytes)
    first, second = next(blocks, []), next(blocks, None)

    def scanned(rows: DataFrame, block: list) -> DataFrame:
        return rows.mapInArrow(scan(spark.sparkContext.broadcast(compile_phrases(block, window))), SPANS)

    docs = texts_of(docs)
    if second is None:
        return scanned(docs.withColumn("row_id", F.lit(0).cast("long")), first).drop("row_id")
    numbered = Scratch(spark, "decontaminate").save(docs.withColumn("row_id", F.monotonically_increasing_id()), "numbered")
    union = scanned(numbered, first).unionByName(scanned(numbered, second))
    for block in blocks:
        union = union.unionByName(scanned(numbered, block))
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    merged = union.groupBy("row_id", "doc_id", "n_words").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    united = F.expr(
        "aggregate(spans, cast(array() as array<struct<starts:int,ends:int>>), (a, s) -> case when size(a) > 0 and a[size(a) - 1].ends >= s.starts"
        " then concat(slice(a, 1, size(a) - 1), array(named_struct('starts', a[size(a) - 1].starts, 'ends', greatest(a[size(a) - 1].ends, s.ends)))) else concat(a, array(s)) end)"
    )
    return merged.withColumn("spans", united).select("doc_id", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items")


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns of removal_spans()."""
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return spans.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows in whose own text no phrase of the benchmark occurs, with their columns; null and repeated ids too."""
    schema, scratch, last = docs.schema, Scratch(docs.sparkSession, "decontaminate"), None
    for k, block in enumerate(item_blocks(benchmark, block_bytes)):
        if k:  # one pass at a time
            docs = scratch.save(docs, f"pass{k}")
            if last:
                scratch.drop(last)
            last = f"pass{k}"
        docs = rows_of(docs).mapInArrow(clean(scratch.spark.sparkContext.broadcast(compile_phrases(block))), schema)
    return docs


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
