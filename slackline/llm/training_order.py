"""Training-order materialisation: token sequences at keyed random slots of fixed-stride shards.

1. Texts become token ids, each document closed by an end token. Documents are dealt to ranges
   of a hash of id and text, so many that a range holds about RANGE_BYTES of text; a range's tokens, in hash order, are cut
   into sequences of one length (its last one padded) as they stream by. Sequences are numbered 0, 1, ... along the ranges.
2. A keyed Feistel permutation of the smallest even number of bits that covers all numbers,
   walked along its cycle until it lands below their count, gives each number its slot: a
   bijection without any global sort or state.
3. Rows are range-partitioned by slot; each range is one shard file, written in slot order.
   Slot s stands in shard s // shard_rows at byte (s % shard_rows) * stride, so a reader can
   start, stop and resume anywhere. Files get their name only when they are whole, and a
   repeated task writes the same bytes. They are written once, when materialise() is called; its rows are read from the index
   table beside them. manifest.json, written last, tells readers key, count, length and shard rows.

Edge cases: null is empty text, whose document is an end token alone; a null doc_id is
listed as null; repeated rows each keep their tokens (next to each other, unless ``spread``); texts longer than a sequence go on in the
next; an empty table gives no rows and no shard; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import textblocks as tb
from .tables import Scratch, by_part, table, texts_of

SEQUENCE = 2048
END, PAD = 50256, 65535
KEY = 20240607
ROUNDS = 6
RANGE_BYTES = 4_000_000
LEAST_RANGES = 512
#: Text for each shuffle partition, where spark.sql.shuffle.partitions has fewer.
TASK_BYTES = 64_000_000
HASH_BITS = 28
SHARD_ROWS = (64, 16384)
SHARDS = 256


@lru_cache(2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def round_keys(key: int) -> np.ndarray:
    return tb.mix(np.uint64(key % 2**64) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * tb.BASE)


def half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def feistel(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    """A permutation of 2 * half bits."""
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> bits, x & mask
    for k in keys:
        left, right = right, left ^ (tb.mix(right + k) & mask)
    return (left << bits) | right


def unfeistel(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> bits, x & mask
    for k in keys[::-1]:
        left, right = right ^ (tb.mix(left + k) & mask), left
    return (left << bits) | right


def walked(x: np.ndarray, n: int, key: int, step) -> np.ndarray:
    """step again and again until every value is below n."""
    keys, half = round_keys(key), half_bits(n)
    out = step(np.asarray(x, np.uint64), half, keys)
    while (far := np.flatnonzero(out >= np.uint64(n))).size:
        out[far] = step(out[far], half, keys)
    return out.astype(np.int64)


def slots(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of sequence numbers below n."""
    return walked(index, n, key, feistel)


def numbers(slot: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The sequence numbers that stand at slots."""
    return walked(slot, n, key, unfeistel)


def tokenise(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern).encode_ordinary
        for batch in batches:
            texts = tb.column(batch, "text").to_pylist()
            tokens = [np.array([*encode(t or ""), END], np.uint16).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([tb.column(batch, "doc_id"), tb.column(batch, "h"), pa.array(tokens, pa.binary())], ["doc_id", "h", "tokens"])

    return run


SEQUENCES = ("range", "place", "tokens", "n_tokens", "doc_ids")


def pack(length: int):
    """Sorted rows (range, doc_id, tokens) -> sequences (range, place, tokens, n_tokens, doc_ids). Holds one batch, and the open sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, ids, now, done = np.zeros(0, np.uint16), [], None, 0

        def sequences(tokens: np.ndarray, ends: np.ndarray, owners: list, n: int) -> pa.RecordBatch:
            """The first n sequences of tokens, whose documents end at ends; padded at the end."""
            flat = np.full(n * length, PAD, np.uint16)
            flat[: len(tokens)] = tokens[: n * length]
            begin = np.arange(n) * length
            first = np.searchsorted(ends, begin, side="right")
            last = np.searchsorted(ends, np.minimum(begin + length, len(tokens)), side="left")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, now)),
                    pa.array(np.arange(done, done + n)),
                    pa.array([flat[k * length : (k + 1) * length].tobytes() for k in range(n)], pa.binary()),
                    pa.array(np.minimum(length, len(tokens) - begin)),
                    pa.array([owners[first[k] : last[k] + 1] for k in range(n)], pa.list_(pa.int64())),
                ],
                SEQUENCES,
            )

        for part, rows in runs_of_ranges(batches):
            if part != now:
                if len(rest):
                    yield sequences(rest, np.array([*(e for _, e in ids)]), [i for i, _ in ids], 1)
                rest, ids, now, done = np.zeros(0, np.uint16), [], part, 0
            pieces = [rest, *(np.frombuffer(t.as_buffer(), np.uint16) for t in tb.column(rows, "tokens"))]
            tokens = np.concatenate(pieces)
            ends = np.concatenate([[e for _, e in ids], len(rest) + np.cumsum([len(p) for p in pieces[1:]])]).astype(np.int64)
            owners = [i for i, _ in ids] + tb.column(rows, "doc_id").to_pylist()
            whole = len(tokens) // length
            for a in range(0, whole, 1024):
                n = min(1024, whole - a)
                cut = slice(a * length, (a + n) * length)
                # documents that reach into these sequences
                low, high = np.searchsorted(ends, a * length, side="right"), np.searchsorted(ends, (a + n) * length, side="left")
                yield sequences(tokens[cut], ends[low : high + 1] - a * length, owners[low : high + 1], n)
                done += n
            low = np.searchsorted(ends, whole * length, side="right")
            rest, ids = tokens[whole * length :], list(zip(owners[low:], (ends[low:] - whole * length).tolist(), strict=True))
        if len(rest):
            yield sequences(rest, np.array([e for _, e in ids]), [i for i, _ in ids], 1)

    return run


def runs_of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of sorted batches that lie in one range each."""
    for batch in batches:
        if batch.num_rows:
            key = tb.column(batch, "range").to_numpy()
            edge = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                yield int(key[a]), batch.slice(a, b - a)


def place(n: int, shard_rows: int, key: int):
    """Numbered sequences -> their slots and shards; tokens are compressed for the shuffle, while the table before it packs many together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            slot = slots(tb.column(batch, "number").to_numpy(), n, key)
            tokens = pa.array([codec.compress(t, asbytes=True) for t in tb.column(batch, "tokens").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(slot // shard_rows), pa.array(slot), tokens, tb.column(batch, "n_tokens"), tb.column(batch, "doc_ids")], ["shard", "slot", "tokens", "n_tokens", "doc_ids"])

    return run


def shard_name(shard: int) -> str:
    return f"shard-{shard:09d}.u16"


def write(folder: str, shard_rows: int, length: int):
    """Rows sorted by slot -> shard files in folder, and a row for each sequence written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        for shard, rows in by_part(batches, "shard"):
            slot = rows["slot"].to_numpy()
            if not np.array_equal(slot, np.arange(shard * shard_rows, shard * shard_rows + len(slot))):
                raise ValueError(f"shard {shard} has gaps")
            sums = []
            unfinished = f"{root}/_{shard_name(shard)}.{attempt}"
            with store.open_output_stream(unfinished) as out:
                for packed in rows["tokens"].to_pylist():
                    t = pa.decompress(packed, length * 2, "zstd", asbytes=True)
                    out.write(t)
                    sums.append(zlib.crc32(t))
            finished = f"{root}/{shard_name(shard)}"
            if store.get_file_info(finished).type == pa.fs.FileType.File:
                store.delete_file(unfinished)  # an earlier attempt wrote the same bytes
            else:
                store.move(unfinished, finished)
            rows = rows.select(["slot", "n_tokens", "doc_ids"]).combine_chunks()
            yield from (
                rows.append_column("shard", pa.array(np.full(len(slot), shard)))
                .append_column("byte_offset", pa.array((slot - shard * shard_rows) * length * 2))
                .append_column("crc32", pa.array(sums, pa.int64()))
                .select(["slot", "shard", "byte_offset", "n_tokens", "crc32", "doc_ids"])
                .to_batches()
            )

    return run


def offsets_of(counts: DataFrame, group: int = 4096) -> DataFrame:
    """(range, size) -> with the sum of all smaller ranges' sizes: sums within groups of ranges, then of groups."""
    grouped = counts.withColumn("group", F.floor(F.col("range") / group))
    inner = grouped.withColumn("inner", F.sum("size").over(W.partitionBy("group").orderBy("range")) - F.col("size"))
    sums = grouped.groupBy("group").agg(F.sum("size").alias("total"))
    outer = sums.select("group", (F.sum("total").over(W.orderBy("group")) - F.col("total")).alias("outer"))
    return inner.join(outer, "group").select("range", "size", (F.col("inner") + F.col("outer")).alias("before"))


def materialise(docs: DataFrame, folder: str, vocabulary: str, pattern: str, length: int = SEQUENCE, key: int = KEY, shard_rows: int | None = None, spread: bool = False) -> DataFrame:
    """Writes the shards to folder (new or empty); slot, shard, byte_offset, n_tokens, crc32 and doc_ids of every sequence.

    spread: repeated rows are placed apart, by their place in the input; the order then depends on how that is stored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "order")
    size = texts_of(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES + 1)
    ranges = max(LEAST_RANGES, size // RANGE_BYTES)
    hashed = texts_of(docs).withColumn("h", F.xxhash64("doc_id", "text", *([F.monotonically_increasing_id()] if spread else [])))
    rows = hashed.mapInArrow(tokenise(vocabulary, pattern), "doc_id long, h long, tokens binary")
    rows = rows.withColumn("range", F.floor(F.shiftrightunsigned("h", 64 - HASH_BITS) * ranges / (1 << HASH_BITS)).cast("long"))
    ordered = rows.repartition(tasks, "range").sortWithinPartitions("range", F.shiftrightunsigned("h", 64 - HASH_BITS), "h", "doc_id")
    made = scratch.save(ordered.select("range", "doc_id", "tokens").mapInArrow(pack(length), "range long, place long, tokens binary, n_tokens long, doc_ids array<long>"), "sequences")
    del ordered, rows
    scratch.drop()
    counts = made.groupBy("range").agg(F.count("*").alias("size"))
    offsets = scratch.save(offsets_of(counts), "offsets")
    n = offsets.agg(F.sum("size")).first()[0] or 0
    shard_rows = shard_rows or min(max(SHARD_ROWS[0], n // SHARDS), SHARD_ROWS[1])
    store, root = pa.fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    numbered = made.join(offsets.select("range", "before"), "range").select((F.col("before") + F.col("place")).alias("number"), "tokens", "n_tokens", "doc_ids")
    placed = numbered.mapInArrow(place(max(n, 1), shard_rows, key), "shard long, slot long, tokens binary, n_tokens long, doc_ids array<long>")
    dealt = placed.repartition(tasks, "shard").sortWithinPartitions("slot")
    index = scratch.save(dealt.mapInArrow(write(folder, shard_rows, length), "slot long, shard long, byte_offset long, n_tokens long, crc32 long, doc_ids array<long>"), "index")
    del dealt, placed, numbered
    scratch.drop("sequences", "offsets")
    for left in store.get_file_info(pa.fs.FileSelector(root)):
        if left.base_name.startswith("_shard-"):  # of attempts that were lost
            store.delete_file(left.path)
    with store.open_output_stream(f"{root}/{MANIFEST}") as out:
        out.write(json.dumps({"sequences": n, "length": length, "shard_rows": shard_rows, "stride_bytes": 2 * length, "key": key, "rounds": ROUNDS, "end": END, "pad": PAD}).encode())
    return index


MANIFEST = "manifest.json"


def manifest(folder: str) -> dict:
    store, root = pa.fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_slots(folder: str, first: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, tokens without padding) from a slot on, shard after shard, to the end that the manifest names."""
    about = manifest(folder)
    store, root = pa.fs.FileSystem.from_uri(folder)
    slot, stride = first, about["stride_bytes"]
    while slot < about["sequences"]:
        with store.open_input_file(f"{root}/{shard_name(slot // about['shard_rows'])}") as f:
            f.seek(slot % about["shard_rows"] * stride)
            while record := f.read(stride):
                tokens = np.frombuffer(record, np.uint16)
                yield slot, tokens[tokens != about["pad"]]
                slot += 1


def training_shards(docs: DataFrame, spread: bool = False) -> DataFrame:
    """materialise() with the byte-level vocabulary of the public tokenisers, into the shared folder."""
    import public_tokenizers

    scratch = Scratch(docs.sparkSession, "token-shards")
    return materialise(docs, scratch.path("shards"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, spread=spread)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_shards(table(spark, sf_dir, "documents"))
