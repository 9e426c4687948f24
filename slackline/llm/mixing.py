"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations (beside a heap for more than PERIOD sources).

Target weights are whole parts of PERIOD, which grows where there are more sources. A source with p parts releases its k-th block
(k = 0, 1, ...) at slot floor(k * PERIOD / p), due before slot ceil((k + 1) * PERIOD / p); the
block that is due earliest among the released ones takes the next slot (ties: fewer
parts, then source name). With parts that add up to PERIOD every window is met, so after any number of
slots each source is less than one block away from its share. The schedule repeats after
PERIOD slots; it is worked out once by a fold over the slots of one period, and every row
finds its slot by (source, place in the period).

A source's rows are numbered along the hash of doc_id by ranges of that hash, so a source of any size is
ranked in many tasks. The mix is as long as needed for every row to stand in it: sources
below their weight repeat in further epochs, none is cut.

Edge cases: a null source is a source of its own; rows with equal doc_id (or null) are ordered by the
hash of all columns; columns of any name pass through; an empty table gives no rows; a single source keeps its rows once;
sources without a stated weight are left out only when the caller's weights name them 0.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import Scratch, table

PERIOD = 1000
BLOCK_ROWS = 1
#: Default targets are in proportion to rows ** POWER.
POWER = 0.7
ROWS_A_RANGE = 4096
RANGES_A_SOURCE = 256
HASH_DIGITS = 7


def hash_of_id() -> F.Column:
    """28 bits of the md5 of doc_id; null counts as the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")


def period_of(sources: F.Column) -> F.Column:
    """PERIOD, or twice as many slots as sources in whole PERIODs where there are more than PERIOD."""
    return F.when(sources <= PERIOD, F.lit(PERIOD).cast("long")).otherwise(2 * PERIOD * F.ceil(sources / PERIOD))


def smoothed_weights(sizes: DataFrame, power: float = POWER) -> DataFrame:
    """(source, n) -> (source, n, parts): rows ** power in whole parts of PERIOD, by largest remainders; each source has one at least.

    PERIOD grows in whole steps where there are more sources. There are as many rows as sources."""
    every = W.partitionBy()
    share = F.pow(F.col("n").cast("double"), F.lit(power))
    rows = sizes.withColumn("share", F.round(share, 6)).withColumn("room", period_of(F.count("*").over(every)) - F.count("*").over(every))
    rows = rows.withColumn("exact", F.round(F.col("share") / F.sum("share").over(every) * F.col("room"), 6)).withColumn("whole", F.floor("exact"))
    rank = F.row_number().over(every.orderBy(F.desc(F.round(F.col("exact") - F.col("whole"), 6)), F.col("source").asc_nulls_first()))
    left = F.col("room") - F.sum("whole").over(every)
    return rows.withColumn("rank", rank).withColumn("left", left).select("source", "n", (F.lit(1) + F.col("whole") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("int").alias("parts"))


def long_schedule(period: int):
    """An Arrow function from (parts, source), in order of ties, to (slot, source): earliest deadline first by a heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, names = [], []
        for batch in batches:
            parts += batch.column(0).to_pylist()
            names += batch.column(1).to_pylist()
        if not parts:
            return
        released, due, taken = [(0, i) for i in range(len(parts))], [], [0] * len(parts)
        slots, sources = [], []
        for slot in range(period):
            while released and released[0][0] <= slot:
                i = heapq.heappop(released)[1]
                heapq.heappush(due, (-(-(taken[i] + 1) * period // parts[i]), i))
            if not due:
                continue
            i = heapq.heappop(due)[1]
            taken[i] += 1
            if taken[i] < parts[i]:
                heapq.heappush(released, (taken[i] * period // parts[i], i))
            slots.append(slot)
            sources.append(names[i])
            if len(slots) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(sources, pa.string())], ["slot", "source"])
                slots, sources = [], []
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(sources, pa.string())], ["slot", "source"])

    return run


def schedule(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, parts) with parts adding up to period -> (slot, source, k): the k-th block of source stands at slot."""
    if period > PERIOD:
        ordered = weights.filter("parts > 0").select("parts", "source").coalesce(1).sortWithinPartitions("parts", F.col("source").isNotNull(), "source")
        slots = ordered.mapInArrow(long_schedule(period), "slot int, source string")
        return slots.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("slot")) - 1)
    sources = weights.filter("parts > 0").agg(F.array_sort(F.collect_list(F.struct("parts", F.col("source").isNotNull().alias("known"), "source"))).alias("s")).filter(F.size("s") > 0)
    # state: next block of each source, the picks so far; earliest deadline first among released blocks
    folded = sources.selectExpr(
        "s",
        f"""aggregate(sequence(0, {PERIOD - 1}),
            named_struct('k', transform(s, x -> 0), 'picks', cast(array() as array<int>)),
            (state, slot) -> transform(array(array_min(filter(transform(s, (x, i) ->
                if(state.k[i] < x.parts and state.k[i] * {PERIOD} < (slot + 1) * x.parts,
                   named_struct('due', cast(ceil((state.k[i] + 1) * {PERIOD} / x.parts) as int), 'i', i), null)), y -> y is not null)).i),
                pick -> named_struct('k', transform(state.k, (v, i) -> if(i = pick, v + 1, v)), 'picks', concat(state.picks, array(pick))))[0],
            state -> state.picks) as picks""",
    )
    slots = folded.select("s", F.posexplode("picks").alias("slot", "pick")).select("slot", F.expr("s[pick].source").alias("source"))
    return slots.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("slot")) - 1)


def ranked(docs: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with n (rows of the source) and rank (0, 1, ... along the hash of doc_id in the source)."""
    ranges = F.greatest(F.lit(RANGES_A_SOURCE), F.ceil(F.col("n") / ROWS_A_RANGE))
    placed = (
        docs.withColumn("hash", hash_of_id())
        .join(sizes, docs["source"].eqNullSafe(sizes["source"])).drop(sizes["source"])
        .withColumn("range", F.floor(F.col("hash") * ranges / F.lit(16**HASH_DIGITS)).cast("long"))
    )
    counts = placed.groupBy("source", "range").agg(F.count("*").alias("size"))
    before = counts.select("source", "range", (F.sum("size").over(W.partitionBy("source").orderBy("range")) - F.col("size")).alias("before"))
    before = scratch.save(before, "ranges").withColumnsRenamed({"source": "of", "range": "at"})
    by_id = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    inside = F.row_number().over(W.partitionBy("source", "range").orderBy("hash", by_id, F.xxhash64("row"))) - 1
    numbered = placed.withColumn("inside", inside)
    return numbered.join(before, numbered["source"].eqNullSafe(before["of"]) & (F.col("range") == F.col("at"))).withColumn("rank", F.col("inside") + F.col("before")).drop("hash", "range", "inside", "of", "at", "before")


def mix(docs: DataFrame, weights: DataFrame | None = None, power: float = POWER, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with position (place in the mix), block, epoch and parts, which replace columns of docs with these names.

    weights: (source, parts) with parts adding up to PERIOD; by default smoothed row counts. Rows are
    repeated until every row of every source with parts stands in the mix."""
    scratch = Scratch(docs.sparkSession, "mixing")
    own = ("position", "block", "epoch", "parts")
    columns = [c for c in docs.columns if c not in own]
    docs = docs.select("doc_id", "source", F.struct(*columns).alias("row"))
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        sizes = smoothed_weights(counts, power)
    else:
        w = weights.select(F.col("source").alias("of"), F.col("parts").cast("int").alias("parts"))
        sizes = counts.join(w, counts["source"].eqNullSafe(w["of"])).filter("parts > 0").drop("of")
    sizes = scratch.save(sizes, "sizes")
    period = max(PERIOD, int(sizes.agg(F.sum("parts").alias("parts")).first().parts or 0))
    plan = scratch.save(schedule(sizes.select("source", "parts"), period), "schedule")
    blocks = F.ceil(F.col("n") / block_rows)
    # whole periods in which each source goes through its blocks once at least
    periods = sizes.agg(F.max(F.ceil(blocks / F.col("parts"))).alias("periods"))
    # the mix ends after the slot that takes the last first-time block of any source
    last = plan.alias("p").join(sizes.alias("z"), F.expr("p.source <=> z.source and p.k = pmod(ceil(z.n / {0}) - 1, z.parts)".format(block_rows)))
    length = last.agg(F.max(F.expr(f"floor((ceil(z.n / {block_rows}) - 1) / z.parts) * {period} + p.slot") + 1).alias("length"))
    total, periods = length.first().length, periods.first().periods
    if total is None:
        return docs.select("row.*", *(F.lit(None).cast("int" if c == "parts" else "long").alias(c) for c in own)).limit(0)
    total, periods = int(total), int(periods)
    rows = ranked(docs, sizes, scratch).withColumn("own", (F.floor(F.col("rank") / block_rows)).cast("long")).withColumn("blocks", blocks.cast("long"))
    # occurrences of the block within the periods, then those before the end of the mix
    uses = rows.withColumn("epoch", F.explode(F.expr(f"sequence(0L, cast(floor(({periods}L * parts - 1 - own) / blocks) as long))")))
    uses = uses.withColumn("block", F.col("own") + F.col("epoch") * F.col("blocks"))
    uses = uses.withColumn("k", (F.col("block") % F.col("parts")).cast("int")).withColumn("period", F.floor(F.col("block") / F.col("parts")))
    slots = plan.select(F.col("source").alias("of"), F.col("k").alias("at"), "slot")
    placed = uses.join(slots, uses["source"].eqNullSafe(slots["of"]) & (F.col("k") == F.col("at"))).drop("of", "at")
    placed = placed.withColumn("position", (F.col("period") * period + F.col("slot")).cast("long")).filter(F.col("position") < total)
    return placed.select("row.*", *own)


def remixed(docs: DataFrame) -> DataFrame:
    """The documents at their target weights, repeated where the mix repeats them, with their columns."""
    inner = docs.select("doc_id", "source", F.struct(*docs.columns).alias("whole"))
    return mix(inner).select("whole.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source")).select("position", "doc_id", "source", "block", "epoch", "parts")
