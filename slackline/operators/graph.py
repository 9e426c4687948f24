"""Graph algebra over many networks: tables keyed by network_id, vertices (activity_id, seq), edges (source, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.operators.schedule import FOLD_LIMIT, by_size, gathered, let, loop_schedule
from slackline.plans.iterate import cut

KEY = ["network_id", "activity_id"]


def _ids(activities: DataFrame, name: str) -> DataFrame:
    return activities.select("network_id", F.col("activity_id").alias(name)).distinct()


def known_edges(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Edges whose two ends are activities."""
    return dependencies.join(_ids(activities, "source"), ["network_id", "source"], "left_semi").join(_ids(activities, "target"), ["network_id", "target"], "left_semi").select("network_id", "source", "target")


def dangling_edges(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Edges with an end that is no activity."""
    marked = dependencies.join(_ids(activities, "source").withColumn("has_s", F.lit(True)), ["network_id", "source"], "left").join(_ids(activities, "target").withColumn("has_t", F.lit(True)), ["network_id", "target"], "left")
    return marked.filter("has_s is null or has_t is null").select("network_id", "source", "target")


def adjacency(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Sorted predecessors and successors of every activity."""
    after = dependencies.groupBy("network_id", F.col("source").alias("activity_id")).agg(F.array_sort(F.collect_set("target")).alias("successors"))
    before = dependencies.groupBy("network_id", F.col("target").alias("activity_id")).agg(F.array_sort(F.collect_set("source")).alias("predecessors"))
    none = F.array().cast("array<string>")
    joined = activities.join(before, KEY, "left").join(after, KEY, "left")
    return joined.withColumn("predecessors", F.coalesce("predecessors", none)).withColumn("successors", F.coalesce("successors", none))


def degrees(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    outs = dependencies.groupBy("network_id", F.col("source").alias("activity_id")).agg(F.count("*").alias("out_degree"))
    ins = dependencies.groupBy("network_id", F.col("target").alias("activity_id")).agg(F.count("*").alias("in_degree"))
    return activities.select(*KEY).join(ins, KEY, "left").join(outs, KEY, "left").select(*KEY, F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def ends(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    d = degrees(activities, dependencies)
    return d.select(*KEY, (F.col("in_degree") == 0).alias("is_source"), (F.col("out_degree") == 0).alias("is_sink"))


def counts(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    a = activities.groupBy("network_id").agg(F.count("*").alias("activity_count"), F.expr("array_sort(collect_list(struct(seq, activity_id))).activity_id").alias("activity_ids"))
    d = dependencies.groupBy("network_id").agg(F.count("*").alias("dependency_count"))
    return a.join(d, "network_id", "left").withColumn("dependency_count", F.coalesce("dependency_count", F.lit(0))).select("network_id", "activity_count", "dependency_count", "activity_ids")


def levels(activities: DataFrame, dependencies: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """network_id, activity_id, seq, level: edges of the longest chain from a source; cyclic networks are left out."""
    return by_size(activities, dependencies, fold_levels, loop_levels, fold_limit)


def loop_levels(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """With durations of 1, the early start of an activity is its level."""
    steps = loop_schedule(activities.select("network_id", "activity_id", "seq", F.lit(1.0).alias("duration")), dependencies)
    return steps.select("network_id", "activity_id", "seq", F.col("early_start").cast("int").alias("level"))


def fold_levels(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    rows = gathered(activities, dependencies).filter("acyclic")
    level = "aggregate(sequence(1, size(a)), cast(array() as array<int>), (lv, i) -> array_append(lv, coalesce(array_max(transform(filter(e, x -> x.t = i), x -> lv[x.s - 1])) + 1, 0)))"
    flat = rows.withColumn("lv", F.expr(let(level, "a", "e"))).select("network_id", F.explode(F.arrays_zip("a", "lv")).alias("z"))
    return flat.select("network_id", F.col("z.a.activity_id"), F.col("z.a.seq"), F.col("z.lv").alias("level"))


def layout(leveled: DataFrame, width: int = 132, height: int = 68, gap_x: int = 72, gap_y: int = 28, margin: int = 40) -> DataFrame:
    """Layered coordinates: columns by level, rows by id within a level."""
    row = F.row_number().over(W.partitionBy("network_id", "level").orderBy("activity_id")) - 1
    return leveled.select(*KEY, "level", row.alias("row_index")).select(
        *KEY, "level", "row_index", (margin + F.col("level") * (width + gap_x)).cast("double").alias("x"), (margin + F.col("row_index") * (height + gap_y)).cast("double").alias("y")
    )


def edge_points(placed: DataFrame, dependencies: DataFrame, width: int = 132, height: int = 68) -> DataFrame:
    """From the middle of the source's right side to the middle of the target's left side."""
    s = placed.select("network_id", F.col("activity_id").alias("source"), (F.col("x") + width).alias("x1"), (F.col("y") + height / 2).alias("y1"))
    t = placed.select("network_id", F.col("activity_id").alias("target"), F.col("x").alias("x2"), (F.col("y") + height / 2).alias("y2"))
    return dependencies.join(s, ["network_id", "source"]).join(t, ["network_id", "target"]).select("network_id", "source", "target", "x1", "y1", "x2", "y2")


def acyclic(activities: DataFrame, dependencies: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """network_id, is_dag. Edges with an unknown end are ignored."""

    def fold(a: DataFrame, d: DataFrame) -> DataFrame:
        return gathered(a, d).select("network_id", F.col("acyclic").alias("is_dag"))

    def loop(a: DataFrame, d: DataFrame) -> DataFrame:
        sorted_out = loop_levels(a, d).select("network_id").distinct().withColumn("is_dag", F.lit(True))
        return a.select("network_id").distinct().join(sorted_out, "network_id", "left").select("network_id", F.coalesce("is_dag", F.lit(False)).alias("is_dag"))

    return by_size(activities.withColumn("duration", F.lit(1.0)), dependencies, fold, loop, fold_limit)


def example_cycles(activities: DataFrame, dependencies: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """network_id, cycle (ids, the first not repeated) of every cyclic network: through the smallest id that lies on a
    cycle, of the cycles through it a shortest one, then the first by ids.

    Only cyclic networks take part; rounds extend the best chain from each id to each id by an edge."""
    cyclic = acyclic(activities, dependencies, fold_limit).filter("not is_dag").select("network_id")
    edges = cut(known_edges(activities, dependencies).distinct().join(cut(cyclic), "network_id", "left_semi"))
    step = edges.select("network_id", F.col("source").alias("at"), F.col("target").alias("next"))
    chains = cut(edges.select("network_id", F.col("source").alias("start"), F.col("target").alias("at"), F.array("source").alias("path")))
    seen = chains.select("network_id", "start", "at")
    closed = chains.filter("start = at").select("network_id", "start", "path")
    while True:
        longer = chains.filter("start <> at").join(step, ["network_id", "at"]).select("network_id", "start", F.col("next").alias("at"), F.array_append("path", F.col("at")).alias("path"))
        best = longer.groupBy("network_id", "start", "at").agg(F.min("path").alias("path"))
        chains = cut(best.join(seen, ["network_id", "start", "at"], "left_anti"))
        if chains.isEmpty():
            break
        seen = cut(seen.unionByName(chains.select("network_id", "start", "at")))
        closed = closed.unionByName(chains.filter("start = at").select("network_id", "start", "path"))
    return closed.groupBy("network_id").agg(F.min(F.struct("start", "path")).alias("m")).select("network_id", F.col("m.path").alias("cycle"))


def consecutive_pairs(paths: DataFrame) -> DataFrame:
    """Distinct edges along paths."""
    steps = F.expr("transform(sequence(1, size(path) - 1), i -> named_struct('source', path[i - 1], 'target', path[i]))")
    flat = paths.filter("size(path) > 1").select("network_id", F.explode(steps).alias("p"))
    return flat.select("network_id", "p.source", "p.target").distinct()


def simple_paths(activities: DataFrame, dependencies: DataFrame, ends: DataFrame, max_steps: int = 10_000) -> DataFrame:
    """All simple paths between ends (network_id, source, target), by rounds that extend every open path with each edge."""
    edges = cut(known_edges(activities, dependencies).distinct())
    open_paths = ends.select("network_id", "target", F.col("source").alias("at"), F.array("source").alias("path"))
    found: DataFrame | None = None
    for _ in range(max_steps):
        open_paths = cut(open_paths)
        done = open_paths.filter("at = target").select("network_id", "path")
        found = done if found is None else found.unionByName(done)
        step = edges.select("network_id", F.col("source").alias("at"), F.col("target").alias("next"))
        longer = open_paths.filter("at <> target").join(step, ["network_id", "at"]).filter(~F.array_contains("path", F.col("next")))
        open_paths = longer.select("network_id", "target", F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path"))
        if open_paths.isEmpty():
            return found
    raise ValueError("paths longer than max_steps")


def components(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """network_id, activity_id, component: the smallest activity_id reachable along edges of either direction.

    Smallest labels spread along edges and jump to their own label's label; ends when none changes."""
    edges = known_edges(activities, dependencies)
    both = cut(edges.union(edges.select("network_id", "target", "source")).distinct().toDF("network_id", "activity_id", "other"))
    state = cut(activities.select(*KEY).distinct().withColumn("component", F.col("activity_id")))
    while True:
        near = both.join(state.select("network_id", F.col("activity_id").alias("other"), F.col("component").alias("c")), ["network_id", "other"]).groupBy(*KEY).agg(F.min("c").alias("c"))
        lower = state.join(near, KEY, "left").select(*KEY, F.col("component").alias("old"), F.least("component", F.coalesce("c", "component")).alias("component"))
        up = state.select("network_id", F.col("activity_id").alias("component"), F.col("component").alias("up"))
        state = cut(lower.join(up, ["network_id", "component"], "left").select(*KEY, "old", F.least("component", F.coalesce("up", "component")).alias("component")))
        if state.filter("old <> component").isEmpty():
            return state.drop("old")
        state = state.drop("old")


def remove_activities(activities: DataFrame, dependencies: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the vertices in gone (network_id, activity_id) and their edges."""
    left = activities.join(gone, KEY, "left_anti")
    edges = dependencies.join(gone.withColumnRenamed("activity_id", "source"), ["network_id", "source"], "left_anti").join(gone.withColumnRenamed("activity_id", "target"), ["network_id", "target"], "left_anti")
    return left, edges
