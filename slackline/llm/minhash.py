"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its
maximum, so 48 evaluations make 96 values; both agree between two sets with probability
equal to their Jaccard similarity. Bands of three values (each of another permutation)
propose candidates: a pair of similarity 0.75 shares none of the 32 bands with
probability (1 - 0.75**3)**32 < 3e-8. Candidates are confirmed on full shingle sets.

Equal sets collapse to one representative before banding. A bucket then proposes only
links to its smallest member, so its cost is linear; members that are still in different
components after those links were confirmed are compared with each other in blocks of
bounded size, so every pair of a bucket is connected or compared. Buckets are never gathered
in one task: their smallest member comes from a partial aggregation, and the joins back can
be split.

Edge cases: null or empty text and text of white space only have no shingles and link
with nothing; one to four words are one shingle; rows with equal doc_id are one node;
a null doc_id links with nothing and is kept; very long texts are a block of their own, with their whole sets; an empty
table gives no rows; other columns are ignored. Shingles are compared by 64-bit hashes of their words' bytes.

A bucket of M documents that are not similar to each other (one frequent passage in otherwise different texts) still costs
M * strays comparisons, in blocks that can be spread over all tasks; no pair is dropped to avoid them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import textblocks as tb
from .components import components
from .tables import Scratch, table, texts_of

WORDS = 5
PERMUTATIONS = 48
ROWS = 3
BANDS = 2 * PERMUTATIONS // ROWS
SIMILAR = (75, 100)
#: Rows of a block of members or strays, see residual_blocks().
BLOCK = 512

_RNG = np.random.Generator(np.random.PCG64(75))
SCALE = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
PLACE = _RNG.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

WORD_BYTE = np.ones(256, bool)
WORD_BYTE[9:14] = WORD_BYTE[32] = False


def shingle_sets(block: tb.Block) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a block."""
    data = tb.LOWER[block.data]
    starts, ends = tb.runs(WORD_BYTE[data])
    words = tb.span_hash(data, starts, ends)
    edges = np.searchsorted(starts, np.concatenate([block.starts, [len(data)]]))
    value = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        value += words[k : k + len(value)] * PLACE[k]
    value = tb.mix(value)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= WORDS:
            part = np.sort(value[a : b - WORDS + 1])
            out.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
        elif b > a:
            out.append(tb.mix((words[a:b] * PLACE[: b - a]).sum(keepdims=True) + PLACE[WORDS + 1] * np.array([b - a], np.uint64)))
        else:
            out.append(value[:0])
    return out


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima of all permutations, then maxima, of each of the adjoining non-empty sets."""
    out = np.empty((len(starts), 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS):
        permuted = values * SCALE[k] + SHIFT[k]
        permuted ^= permuted >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(permuted, starts)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(permuted, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * PLACE[7], parts.shape[:2])
    for k in range(ROWS):
        key = tb.mix(key + parts[:, :, k] * PLACE[k])
    return key


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, set_key (a digest of the whole set) and bands of each document."""
    for block in tb.blocks(batches):
        sets = shingle_sets(block)
        sizes = np.array([len(x) for x in sets], np.int64)
        full = np.flatnonzero(sizes)
        bands = np.zeros((0, BANDS), np.uint64)
        if len(full):
            bands = band_keys(signatures(np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]))
        ids = tb.long_ids(block.rows)
        keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
        offsets = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=ids == tb.NULL_ID), pa.array(sizes), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1).view(np.int64)))],
            ["doc_id", "n_shingles", "set_key", "bands"],
        )


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in tb.blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(tb.long_ids(block.rows)), pa.array([x.tobytes() for x in shingle_sets(block)], pa.binary())], ["doc_id", "shingles"])


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, set_a, set_b) the links whose sets are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(tb.column(batch, "set_a"), tb.column(batch, "set_b"), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([a, b]))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(SIMILAR[1] * common >= SIMILAR[0] * (len(both) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def links_across(key: np.ndarray, node: np.ndarray, label: np.ndarray, stray: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between strays and members of other labels in one block of a bucket; one for each pair of labels suffices."""
    size = np.array([len(x) for x in sets])
    member = np.flatnonzero(~stray)
    member = member[np.argsort(size[member], kind="stable")]
    if not len(member) or not stray.any():
        return []
    flat = np.concatenate([sets[k] for k in member])
    start = np.concatenate([[0], np.cumsum(size[member])])
    names, dense = np.unique(flat, return_inverse=True)
    marked = np.zeros(len(names) + 1, bool)
    out, joined = [], set()
    for k in np.flatnonzero(stray).tolist():
        n = int(size[k])
        low = int(np.searchsorted(size[member], -(-SIMILAR[0] * n // SIMILAR[1])))
        high = int(np.searchsorted(size[member], SIMILAR[1] * n // SIMILAR[0], side="right"))
        others = np.flatnonzero(label[member[low:high]] != label[k]) + low
        if not len(others):
            continue
        at = np.minimum(np.searchsorted(names, sets[k]), len(names) - 1)
        own = at[names[at] == sets[k]]
        marked[own] = True
        common = np.add.reduceat(marked[dense[start[low] : start[high]]], start[low:high] - start[low], dtype=np.int64)[others - low]
        marked[own] = False
        good = others[SIMILAR[1] * common >= SIMILAR[0] * (size[member[others]] + n - common)]
        for m in member[good].tolist():
            pair = (int(min(label[k], label[m])), int(max(label[k], label[m])))
            if pair not in joined:
                joined.add(pair)
                out.append((int(node[k]), int(node[m])))
    return out


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, i, j, node, label, stray, shingles), sorted by the first three -> links."""

    def handle(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        band, i, j, node, label = (rows[c].to_numpy() for c in ("band", "i", "j", "node", "label"))
        stray = rows["stray"].to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"].combine_chunks()]
        edge = np.flatnonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        found = []
        for x, y in zip([0, *edge.tolist()], [*edge.tolist(), len(band)], strict=True):
            found += links_across(band[x:y], node[x:y], label[x:y], stray[x:y], sets[x:y])
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(k).to_numpy() for k in range(3)]
        last = int(np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], 0)]))[-1])
        fresh = held and any(held[-1].column(k)[-1].as_py() != key[k][0] for k in range(3))
        if held and (last or fresh):
            # all groups before the batch's last one are whole now
            yield handle(pa.Table.from_batches(held + ([batch.slice(0, last)] if last else [])))
            held = [batch.slice(last)]
        elif last:
            yield handle(pa.Table.from_batches([batch.slice(0, last)]))
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield handle(pa.Table.from_batches(held))


def residual_blocks(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (band, node, label) of buckets with several labels, dealt to blocks (band, i, j).

    Strays are the members outside a bucket's commonest label. Every pair of members with
    different labels has a stray, so blocks of strays j meet blocks of members i; a block
    holds about BLOCK rows of each, whatever the size of the bucket.
    """
    by_label = placed.groupBy("band", "label").agg(F.count("*").alias("n"))
    mixed = by_label.groupBy("band").agg(F.sum("n").alias("members"), F.max(F.struct("n", "label")).alias("top")).filter("top.n < members")
    blocks = mixed.select(
        "band",
        F.col("top.label").alias("main"),
        F.ceil(F.col("members") / BLOCK).cast("int").alias("member_blocks"),
        F.ceil((F.col("members") - F.col("top.n")) / BLOCK).cast("int").alias("stray_blocks"),
    )
    rows = placed.join(scratch.save(blocks, "mixed"), "band").withColumn("h", F.xxhash64("node"))
    every = rows.select("band", F.expr("cast(pmod(h, member_blocks) as int)").alias("i"), F.explode(F.expr("sequence(0, stray_blocks - 1)")).alias("j"), "node", "label", F.lit(False).alias("stray"))
    strays = rows.filter("label <> main").select("band", F.explode(F.expr("sequence(0, member_blocks - 1)")).alias("i"), F.expr("cast(pmod(h, stray_blocks) as int)").alias("j"), "node", "label", F.lit(True).alias("stray"))
    return every.unionByName(strays)


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    The result reads tables of ``scratch``: sketches, classes and labels."""
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    texts = texts_of(docs)
    sketches = scratch.save(texts.mapInArrow(sketch, "doc_id long, n_shingles long, set_key binary, bands array<long>"), "sketches")
    known = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = scratch.save(known.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("n"), F.count("*").alias("members")), "classes")
    banded = classes.select("node", "n", F.explode("bands").alias("band"))
    buckets = scratch.save(banded.groupBy("band").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("members")).filter("members > 1").select("band", F.col("least.node").alias("pivot"), F.col("least.n").alias("pivot_n")), "buckets")
    members = scratch.save(banded.join(buckets, "band"), "members")
    ids = members.select(F.col("node").alias("doc_id")).distinct()
    sets = scratch.save(texts.join(ids, "doc_id", "left_semi").mapInArrow(full_sets, "doc_id long, shingles binary"), "sets")

    # 1. every member against the smallest member of its buckets
    similar_size = f"{SIMILAR[1]} * least(n, pivot_n) >= {SIMILAR[0]} * greatest(n, pivot_n)"
    stars = members.filter(f"node <> pivot and {similar_size}").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    first = stars.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = first.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    links = scratch.save(both.mapInArrow(confirm, "a long, b long"), "links0")
    labels = components(links, scratch, "labels0")

    # 2. within a bucket, across the components of step 1
    placed = scratch.save(members.select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label")), "placed")
    blocks = residual_blocks(placed, scratch).join(sets.withColumnRenamed("doc_id", "node"), "node")
    dealt = blocks.select("band", "i", "j", "node", "label", "stray", "shingles").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    more = scratch.save(dealt.mapInArrow(across, "a long, b long"), "links1")
    if not more.isEmpty():
        labels = components(links.unionByName(more), scratch, "labels1")
    del banded, buckets, members, sets, stars, first, both, links, placed, blocks, dealt, more
    scratch.drop("buckets", "members", "sets", "links0", "links1", "placed", "mixed")

    of_class = classes.filter("members > 1").select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("of_class"))
    own = labels.select(F.col("node").alias("doc_id"), F.col("label").alias("own"))
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.least(F.coalesce("of_class", "doc_id"), F.coalesce("own", "doc_id"))).otherwise(F.col("doc_id"))
    return (
        sketches.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
        .join(of_class, "set_key", "left")
        .join(own, "doc_id", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay: one of each component, the one with the smallest doc_id, with their columns.

    Each row is decided by its own text: rows without an id, and the further texts of a repeated id, go under a key made
    from id and text that sorts after ids below 2**62."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text"))
    several = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("hash").alias("first"), F.max("hash").alias("last")).filter("first <> last").select("doc_id", "first")
    rows = rows.join(scratch.save(several, "several"), "doc_id", "left")
    made = f"(hash & {2**61 - 1}L) | {2**62}L"
    rows = rows.withColumn("key", F.expr(f"case when doc_id is null or hash <> first then {made} else doc_id end"))
    drop = scratch.save(near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"), scratch).filter("not kept").select(F.col("doc_id").alias("key")).distinct(), "dropped")
    scratch.drop("sketches", "classes")
    left = rows.join(drop, "key", "left_anti")
    # rows of one key are equal in id and text: one of them stays, unless there is nothing in them to compare
    twice = scratch.save(rows.filter("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").groupBy("key").count().filter("count > 1").select("key", F.lit(True).alias("twice")), "twice")
    left = left.join(twice, "key", "left")
    once = left.filter("twice").withColumn("n", F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("row")))).filter("n = 1")
    return left.filter("twice is null").select("row.*").unionByName(once.select("row.*"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
