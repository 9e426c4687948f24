"""Near-duplicate embeddings by collision counts over sorted one-dimensional projections.

Unit vectors whose cosine is at least 0.95 are at most sqrt(0.1) apart, so their projections on
a Gaussian direction differ by a normal variable of at most that deviation. A pair collides on
a projection when one's place in its sorted order lies in the window of half-width 1.9 deviations around the other's value.
Of 16 projections such a pair collides on at least ``COUNT`` (calibrated for a miss below
1e-4); pairs that reach the count are verified by cosine in double precision.

A window holds a fixed share of all vectors, so counting over one sorted order of everything would take quadratic work.
Vectors are therefore dealt to groups first: a group is one cell of a grid over a few further projections, and there are
several such tables, each with directions and offsets of its own. The numbers of directions and tables follow from the number
of vectors: groups stay near GROUP vectors, and a pair at the limit meets in no table with a probability below 1e-4. A pair is
counted in the first table in which it meets. Copies of a vector grow with the number of tables, some n ** 0.19.

Equal vectors collapse to one. Groups of more than BLOCK vectors (dense regions) are dealt on to pairs of blocks, without loss;
a block pair adds up links by vector and joins its links to trees, so tasks return rows in
proportion to their vectors, whatever the number of links.

Edge cases: null vectors, and those with null, NaN or infinite components, of norm zero or without
components, link with nothing; vectors of other lengths do not link; a null vec_id
links with nothing and is kept; rows with equal vec_id are one node; an empty table gives no rows; labels and other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks as tb
from .components import components
from .tables import Scratch, by_part, table

COSINE = 0.95
PROJECTIONS = 16
MISS = 1e-4
DEVIATION = math.sqrt(2 - 2 * COSINE)
WINDOW = 1.9 * DEVIATION
#: Side of a grid cell; projections of unit vectors on Gaussian directions have deviation 1 where they are spread evenly.
CELL = 2.5
GROUP = 1024
BLOCK = 4096
QUERIES = 64


def calibrated_count(trials: int = PROJECTIONS, miss: float = MISS) -> int:
    """The largest count that a pair at COSINE misses with a probability below ``miss``."""
    p = math.erf(1.9 / math.sqrt(2))
    below = 0.0
    for k in range(trials + 1):
        below += math.comb(trials, k) * p**k * (1 - p) ** (trials - k)
        if below >= miss:
            return k
    return trials


COUNT = calibrated_count()


def same_cell(deviation: float, side: float = CELL) -> float:
    """Probability that two values, apart by a normal variable, share a cell of a grid with a random offset."""
    r = side / deviation
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def grid(n: int, group: int = GROUP, miss: float = MISS) -> tuple[int, int]:
    """Directions of a table and number of tables for n vectors."""
    far, near = same_cell(math.sqrt(2)), same_cell(DEVIATION)
    width = max(0, math.ceil(math.log(max(n, 1) / group) / -math.log(far)))
    return width, 1 if not width else math.ceil(math.log(miss) / math.log(1 - near**width))


@lru_cache(8)
def directions(length: int) -> np.ndarray:
    """The PROJECTIONS directions whose windows are counted, the same in every task."""
    return np.random.Generator(np.random.PCG64(length)).standard_normal((length, PROJECTIONS))


@lru_cache(8)
def grid_of(length: int, width: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([length, width, tables]))
    return rng.standard_normal((length, width * tables)), rng.uniform(0, CELL, width * tables)


def unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, length and the unit vector's bytes (null for vectors that link with nothing)."""
    for batch in batches:
        vectors = tb.column(batch, "embedding")
        out = []
        for v in vectors:
            x = None
            if v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy().astype(float)
                scale = np.abs(x).max()
                x = x / scale if np.isfinite(x).all() and scale > 0 else None
            out.append(None if x is None else (x / np.sqrt(x @ x)))
        size = [0 if x is None else len(x) for x in out]
        yield pa.RecordBatch.from_arrays([tb.column(batch, "vec_id"), pa.array(size, pa.int32()), pa.array([None if x is None else x.tobytes() for x in out], pa.binary())], ["vec_id", "length", "unit"])


def cells(width: int, tables: int):
    """Distinct vectors -> their cell in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = tb.column(batch, "length").to_numpy()
            units = tb.column(batch, "unit").to_pylist()
            out = np.zeros((len(units), tables), np.uint64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                x = np.frombuffer(b"".join(units[k] for k in at.tolist()), float).reshape(-1, size)
                d, offset = grid_of(size, width, tables)
                place = np.floor((x @ d + offset) / CELL).astype(np.int64).view(np.uint64).reshape(len(at), tables, width)
                key = np.full((len(at), tables), size, np.uint64)
                for k in range(width):
                    key = tb.mix((key ^ place[:, :, k]) * tb.BASE + np.uint64(k + 1))
                out[at] = key
            offsets = np.arange(len(units) + 1, dtype=np.int32) * tables
            lists = pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(tb.column(batch, c) for c in ("node", "n", "length", "unit")), lists], ["node", "n", "length", "unit", "cells"])

    return run


def collisions(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of left, row of right) that collide on COUNT projections at least, for blocks of queries.

    Every projection of right is sorted; a query's window is the range of places between two binary searches in that
    order, and a row of right collides when its place is in the range."""
    low, wide, rank = [], [], []
    for a, b in zip(left.T, right.T, strict=True):
        order = np.argsort(b, kind="stable")
        place = np.empty(len(b), np.uint16)
        place[order] = np.arange(len(b), dtype=np.uint16)
        begin = np.searchsorted(b[order], a - WINDOW)
        rank.append(place)
        low.append(begin.astype(np.uint16))
        wide.append((np.searchsorted(b[order], a + WINDOW, side="right") - begin).astype(np.uint16))
    for s in range(0, len(left), QUERIES):
        counts = np.zeros((min(QUERIES, len(left) - s), len(right)), np.uint8)
        for place, begin, size in zip(rank, low, wide, strict=True):
            counts += ((place - begin[s : s + QUERIES, None]) < size[s : s + QUERIES, None]).view(np.uint8)
        q, r = np.nonzero(counts >= COUNT)
        yield q + s, r


def links_of(node_a: np.ndarray, n_a: np.ndarray, x: np.ndarray, cells_a: np.ndarray, node_b: np.ndarray, n_b: np.ndarray, y: np.ndarray, cells_b: np.ndarray, turn: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, label) for the vectors of a group (or a pair of its blocks) that link and meet in no table before this one."""
    d = directions(x.shape[1])
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q, r in collisions(x @ d, y @ d):
        if same:
            q, r = q[q < r], r[q < r]
        for s in range(0, len(q), 100_000):
            i, j = q[s : s + 100_000], r[s : s + 100_000]
            good = np.einsum("ij,ij->i", x[i], y[j]) >= COSINE
            i, j = i[good], j[good]
            fresh = ~(cells_a[i, :turn] == cells_b[j, :turn]).any(1)
            found_i.append(i[fresh])
            found_j.append(j[fresh])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    nodes, at = np.unique(np.concatenate([node_a[i], node_b[j]]), return_inverse=True)
    u, v = at[: len(i)], at[len(i) :]
    links = np.bincount(u, n_b[j], len(nodes)) + np.bincount(v, n_a[i], len(nodes))
    label = np.arange(len(nodes))
    while True:  # smallest place reachable within this group
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        low = low[low]
        if np.array_equal(low, label):
            return nodes, links.astype(np.int64), nodes[label]
        label = low


def count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (turn, cell, length, i, j, side, node, n, unit, cells), sorted by the first five -> partial links and labels."""
    for (turn, _, length, i, j), rows in by_part(batches, "turn", "cell", "length", "i", "j"):
        node, n, side = (rows[c].to_numpy() for c in ("node", "n", "side"))
        a = side == 0
        b = a if i == j else ~a
        if not a.any() or not b.any() or len(node) < 2:
            continue
        x = np.frombuffer(b"".join(rows["unit"].to_pylist()), float).reshape(-1, length)
        own = rows["cells"].combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        nodes, links, label = links_of(node[a], n[a], x[a], own[a], node[b], n[b], x[b], own[b], turn, i == j)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(label)], ["node", "links", "label"])


def dealt_to_groups(known: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """A row for each vector and table, and for each block pair of a group with more than block vectors."""
    group = ["turn", "cell", "length"]
    members = known.select("length", F.posexplode("cells").alias("turn", "cell"), "node", "n", "unit", "cells")
    large = scratch.save(members.groupBy(*group).count().filter(F.col("count") > block).select(*group, F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large")
    placed = members.join(large, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    spread = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return spread.select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "n", "unit", "cells")


def near_duplicates(vectors: DataFrame, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable) and kept, a row a vector."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "projections")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    units = scratch.save(rows.mapInArrow(unit_vectors, "vec_id long, length int, unit binary"), "units")
    usable = units.filter("unit is not null and vec_id is not null")
    classes = scratch.save(usable.groupBy("unit", "length").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "classes")
    width, tables = grid(classes.count(), group)
    # written, not computed again: a vector's cells must be the same wherever they are compared
    known = scratch.save(classes.mapInArrow(cells(width, tables), "node long, n long, length int, unit binary, cells array<long>"), "cells")
    by_group = ("turn", "cell", "length", "i", "j")
    dealt = dealt_to_groups(known, scratch, block).repartition(tasks, *by_group).sortWithinPartitions(*by_group)
    found = scratch.save(dealt.mapInArrow(count_links, "node long, links long, label long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")), scratch, "labels")
    whole = classes.select("unit", F.col("node").alias("rep"), "n").join(links, F.col("rep") == links["node"], "left").drop("node").join(labels, F.col("rep") == labels["node"], "left").drop("node")
    joined = units.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("unit")).alias("unit")).join(whole, "unit", "left")
    return joined.select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("label", "rep", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
