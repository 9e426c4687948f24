"""Critical-path and three-point schedules of many networks at once.

Two strategies give the same numbers. The fold collects a small network into one row and runs both
passes as array folds: one shuffle a table, no Python, no loop over jobs. The loop advances all
networks together by topological rounds of joins with checkpointed state; it takes networks of any
size, so one huge network never lands in one row. ``by_size`` sends each network to the one that fits.

Inputs: activities (network_id, activity_id, seq, duration, ...) and dependencies (network_id,
source, target). Repeated edges count once; edges with an unknown end are ignored (validation
reports them); networks with a cycle get no schedule.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.operators import batches
from slackline.plans.iterate import Store, cut

#: Walks above which critical paths of a network are built by rounds of joins.
FOLD_WALKS = 10_000
#: Vertices above which a network goes to the loop.
FOLD_LIMIT = 256
#: Activities of a slice of the loop, whose tables and shuffles are on disk together.
SLICE_ROWS = 8_000_000
TOLERANCE = 1e-9

def let(expression: str, *names: str) -> str:
    """The expression with columns bound once; the optimiser would else copy their definitions into its inner loops."""
    for n in names:
        expression = f"transform(array({n}), {n} -> {expression})[0]"
    return expression


_ORDER = """aggregate(sequence(1, size(a)), array_repeat(0, size(a)),
    (lv, r) -> transform(lv, (v, i) -> greatest(v, coalesce(array_max(transform(filter(e, x -> x.t = i + 1), x -> lv[x.s - 1] + 1)), 0))))"""
_EDGES = """filter(transform(d, x -> named_struct('s', cast(array_position(ids, x.source) as int), 't', cast(array_position(ids, x.target) as int))), x -> x.s > 0 and x.t > 0)"""


def gathered(activities: DataFrame, dependencies: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row a network: a (activities in topological order), e (edges by place from 1), acyclic."""
    acts = activities.groupBy("network_id").agg(F.array_sort(F.collect_list(F.struct("seq", "activity_id", "duration", *carry))).alias("a"))
    deps = dependencies.groupBy("network_id").agg(F.collect_set(F.struct("source", "target")).alias("d"))
    empty = F.expr("cast(array() as array<struct<source:string,target:string>>)")
    return placed(acts.join(deps, "network_id", "left").withColumn("d", F.coalesce("d", empty)), carry)


def placed(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a network's activities a and distinct edges d (source, target) -> those of gathered(), other columns kept."""
    others = [c for c in rows.columns if c not in ("a", "d")]
    rows = rows.withColumn("ids", F.expr("a.activity_id")).withColumn("e", F.expr(let(_EDGES, "ids", "d")))
    # places already rise along every edge in most networks; else sort by level, and a level of n means a cycle
    rows = rows.withColumn("level", F.when(F.expr("forall(e, x -> x.s < x.t)"), F.lit(None)).otherwise(F.expr(let(_ORDER, "a", "e"))))
    rows = rows.withColumn("acyclic", F.expr("level is null or array_max(level) < size(a)"))
    fields = ", ".join(f"'{c}', x.v.{c}" for c in ("seq", "activity_id", "duration", *carry))
    sorted_a = F.expr(f"transform(array_sort(transform(a, (v, i) -> named_struct('level', level[i], 'i', i, 'v', v))), x -> named_struct({fields}))")
    rows = rows.withColumn("a", F.when(F.col("level").isNull(), F.col("a")).otherwise(sorted_a)).withColumn("ids", F.expr("a.activity_id"))
    return rows.withColumn("e", F.when(F.col("level").isNull(), F.col("e")).otherwise(F.expr(let(_EDGES, "ids", "d")))).select(*others, "a", "e", "acyclic")


FORWARD = """aggregate(sequence(1, size(a)), cast(array() as array<double>),
    (ef, i) -> array_append(ef, a[i - 1].duration + coalesce(array_max(transform(filter(e, x -> x.t = i), x -> ef[x.s - 1])), 0D)))"""
BACKWARD = """aggregate(sequence(size(a), 1, -1), cast(array() as array<double>),
    (ls, i) -> array_prepend(ls, coalesce(array_min(transform(filter(e, x -> x.s = i), x -> ls[x.t - i - 1])), project_duration) - a[i - 1].duration))"""


def fold_arrays(rows: DataFrame) -> DataFrame:
    """gathered() rows with ef, project_duration and ls arrays; cyclic networks are left out."""
    rows = rows.filter("acyclic").withColumn("ef", F.expr(let(FORWARD, "a", "e")))
    return rows.withColumn("project_duration", F.coalesce(F.array_max("ef"), F.lit(0.0))).withColumn("ls", F.expr(let(BACKWARD, "a", "e", "project_duration")))


SCHEDULE = ("network_id", "activity_id", "seq", "duration", "early_start", "early_finish", "late_start", "late_finish", "total_float", "free_float", "is_critical", "project_duration")


def fold_schedule(activities: DataFrame, dependencies: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    # a start is the largest finish of its predecessors, not finish minus duration, which may round
    return finished(batches.schedules(activities, dependencies), tolerance)


def finished(rows: DataFrame, tolerance: float) -> DataFrame:
    """Floats and criticality of rows with starts, finishes and next_start (null for a terminal)."""
    total = F.col("late_start") - F.col("early_start")
    rows = rows.withColumn("total_float", total).withColumn("free_float", F.coalesce(F.col("next_start") - F.col("early_finish"), F.lit(0.0)))
    return rows.withColumn("is_critical", F.abs("total_float") < tolerance).select(*SCHEDULE)


KEY = ["network_id", "activity_id"]


def _rounds(store: Store, name: str, state: DataFrame, offers: list, pick: dict, finish) -> tuple[DataFrame, DataFrame]:
    """Rounds of relaxation: a vertex is ready once all that it waits for (open) were, makes its finish and offers to the vertices of its list.

    A round keeps only the vertices that are not ready yet. pick: how each accumulated column takes an offer; null before the first.
    Returns all ready vertices, and those that never are."""
    ready = []
    while True:
        state = store.save(state, f"{name}{len(ready)}")
        now, rest = finish(state.filter("open = 0")), state.filter("open > 0")
        ready.append(now)
        fresh, left = state.agg(F.count_if(F.col("open") == 0), F.count_if(F.col("open") > 0)).first()
        if not fresh or not left:
            break
        to = now.select("network_id", F.explode("to").alias("activity_id"), *offers)
        best = {c: (F.max if f is F.greatest else F.min) for c, f in pick.items()}
        to = to.groupBy(*KEY).agg(*[f(f"offer_{c}").alias(f"offer_{c}") for c, f in best.items()], F.count("*").alias("seen"))
        joined = rest.join(to, KEY, "left").withColumn("open", F.col("open") - F.coalesce("seen", F.lit(0)))
        state = joined.select(*[f(F.col(c), F.col(f"offer_{c}")).alias(c) if (f := pick.get(c)) else c for c in state.columns])
    return reduce(DataFrame.unionByName, ready), rest


def _loop(store: Store, acts: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One slice: vertices carry the lists of their neighbours, so that a round joins vertices and offers only."""
    gather = lambda edges, end, other: edges.groupBy("network_id", F.col(end).alias("activity_id")).agg(F.collect_set(other).alias(f"{other}s"))
    none = F.array().cast(f"array<{acts.schema['activity_id'].dataType.simpleString()}>")
    # sources may hold unknown ids, which take no offer; targets are known, both ends
    acts = acts.join(gather(dependencies, "target", "source"), KEY, "left")
    acts = store.save(acts.withColumn("sources", F.coalesce("sources", none)), "sources")
    targets = gather(acts.select("network_id", F.col("activity_id").alias("target"), F.explode("sources").alias("source")), "source", "target")
    acts = store.save(acts.join(targets, KEY, "left").withColumn("targets", F.coalesce("targets", none)), "vertices")
    waits = acts.select("network_id", F.explode("targets").alias("activity_id")).groupBy(*KEY).agg(F.count("*").alias("open"))
    nothing = F.lit(None).cast("double")
    first = acts.join(waits, KEY, "left").select("network_id", "activity_id", "duration", F.col("targets").alias("to"), nothing.alias("start"), F.coalesce("open", F.lit(0)).alias("open"))
    early = lambda rows: rows.withColumn("early_start", F.coalesce("start", F.lit(0.0))).withColumn("early_finish", F.col("early_start") + F.col("duration"))
    forward, cyclic = _rounds(store, "forward", first, [F.col("early_finish").alias("offer_start")], {"start": F.greatest}, early)
    whole = forward.groupBy("network_id").agg(F.coalesce(F.max("early_finish"), F.lit(0.0)).alias("project_duration")).join(cyclic.select("network_id").distinct(), "network_id", "left_anti")
    late = acts.join(forward.select(*KEY, "early_start", "early_finish"), KEY).join(whole, "network_id")
    late = late.select(*KEY, "seq", "duration", "early_start", "early_finish", "project_duration", F.col("sources").alias("to"), nothing.alias("end"), nothing.alias("next_start"), F.size("targets").cast("long").alias("open"))
    ends = lambda rows: rows.withColumn("late_finish", F.coalesce("end", "project_duration")).withColumn("late_start", F.col("late_finish") - F.col("duration"))
    return _rounds(store, "late", late, [F.col("late_start").alias("offer_end"), F.col("early_start").alias("offer_next_start")], {"end": F.least, "next_start": F.least}, ends)[0]


def loop_schedule(activities: DataFrame, dependencies: DataFrame, tolerance: float = TOLERANCE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The same as fold_schedule() by rounds of joins; as many rounds as the longest chain has vertices, twice.

    Networks are dealt by hash to slices of some slice_rows activities, one after another, so the tables between rounds take the disk
    of one slice; a larger network is in a slice as a whole. Ids must differ within a network."""
    store = Store(activities.sparkSession, "loop")
    acts, edges = activities.select("network_id", "activity_id", "seq", F.col("duration").cast("double")), dependencies.select("network_id", "source", "target")
    slices = max(1, -(-acts.count() // slice_rows))
    done = []
    for k in range(slices):
        part = [t.filter(F.pmod(F.xxhash64("network_id"), F.lit(slices)) == k) if slices > 1 else t for t in (acts, edges)]
        between = len(done)
        done.append(store.save(finished(_loop(store, *part), tolerance), f"done{k}"))
        store.drop(store.names[between:-1])
    return reduce(DataFrame.unionByName, done)


def schedule(activities: DataFrame, dependencies: DataFrame, tolerance: float = TOLERANCE, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Early and late times, floats and criticality of every activity of every acyclic network."""
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    return by_size(activities, dependencies, lambda a, d: fold_schedule(a, d, tolerance), lambda a, d: loop_schedule(a, d, tolerance), fold_limit)


def by_size(activities: DataFrame, dependencies: DataFrame, fold: Callable, loop: Callable, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """fold(activities, dependencies) of networks with at most fold_limit vertices, and loop() of larger ones, which gives the same columns."""
    large = activities.groupBy("network_id").count().filter(F.col("count") > fold_limit).select("network_id")
    if large.isEmpty():
        return fold(activities, dependencies)
    large = cut(large)
    small, rest = ([t.join(large, "network_id", how) for t in (activities, dependencies)] for how in ("left_anti", "left_semi"))
    return fold(*small).unionByName(loop(*rest))


def summary(scheduled: DataFrame) -> DataFrame:
    """network_id, project_duration and counts of critical and other activities."""
    return scheduled.groupBy("network_id").agg(
        F.max("project_duration").alias("project_duration"),
        F.count_if(F.col("is_critical")).alias("critical_count"),
        F.count_if(~F.col("is_critical")).alias("non_critical_count"),
    )


def with_expected_times(activities: DataFrame) -> DataFrame:
    """Activities with the three-point mean as duration and its variance; rows without all estimates keep null."""
    from slackline.functions.numbers import expected_time, variance

    o, m, p = (F.col(c) for c in ("optimistic_time", "most_likely_time", "pessimistic_time"))
    return activities.withColumn("duration", expected_time(o, m, p)).withColumn("variance", variance(o, p))


def critical_walks(activities: DataFrame, dependencies: DataFrame, tolerance: float) -> DataFrame:
    """fold_arrays() rows with the critical vertices, the edges between them (ce) and the number of walks, none of them built."""
    rows = fold_arrays(gathered(activities, dependencies))
    rows = rows.withColumn("es", F.expr(let("transform(sequence(1, size(a)), i -> coalesce(array_max(transform(filter(e, x -> x.t = i), x -> ef[x.s - 1])), 0D))", "a", "e", "ef")))
    rows = rows.withColumn("critical", F.expr(let(f"filter(sequence(1, size(a)), i -> abs(ls[i - 1] - es[i - 1]) < {tolerance!r}D)", "a", "ls", "es")))
    rows = rows.withColumn("ce", F.expr(let("filter(e, x -> array_contains(critical, x.s) and array_contains(critical, x.t))", "critical")))
    count = """aggregate(critical, map_from_arrays(array(0), array(0D)), (m, v) -> map_concat(m, map(v, greatest(1D,
        aggregate(filter(ce, x -> x.t = v), 0D, (n, x) -> n + m[x.s])))))"""
    rows = rows.withColumn("counts", F.expr(let(count, "critical", "ce")))
    return rows.withColumn("walks", F.expr(let(f"aggregate(filter(critical, v -> not exists(ce, x -> x.s = v)), 0D, (n, v) -> n + counts[v])", "counts", "critical", "ce")))


def critical_edges(activities: DataFrame, dependencies: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """network_id, source, target of the edges on full-length critical paths: both ends critical and no slack between them; no path is built."""
    times = schedule(activities, dependencies, tolerance).filter("is_critical")
    ends = [times.select("network_id", F.col("activity_id").alias(end), F.col(time).alias(time)) for end, time in (("source", "early_finish"), ("target", "early_start"))]
    joined = dependencies.select("network_id", "source", "target").distinct().join(ends[0], ["network_id", "source"]).join(ends[1], ["network_id", "target"])
    return joined.filter(F.abs(F.col("early_start") - F.col("early_finish")) < tolerance).select("network_id", "source", "target")


def loop_walks(activities: DataFrame, dependencies: DataFrame, tolerance: float) -> DataFrame:
    """network_id, project_duration, walks, path, path_duration of all critical walks, by rounds that extend every open walk with each edge."""
    vertices = cut(schedule(activities, dependencies, tolerance).filter("is_critical").select("network_id", "activity_id", "duration", "project_duration"))
    known = vertices.select("network_id", "activity_id")
    edges = dependencies.select("network_id", "source", "target").distinct().join(known.withColumnRenamed("activity_id", "source"), ["network_id", "source"], "left_semi")
    edges = cut(edges.join(vertices.select("network_id", F.col("activity_id").alias("target"), F.col("duration").alias("more")), ["network_id", "target"]).select("network_id", F.col("source").alias("at"), "target", "more"))
    later = edges.select("network_id", F.col("target").alias("activity_id"))
    state = vertices.join(later, ["network_id", "activity_id"], "left_anti").select("network_id", "project_duration", F.col("activity_id").alias("at"), F.array("activity_id").alias("path"), (F.lit(0.0) + F.col("duration")).alias("path_duration"))
    found: DataFrame | None = None
    while True:
        state = cut(state)
        done = state.join(edges.select("network_id", "at").distinct(), ["network_id", "at"], "left_anti").select("network_id", "project_duration", "path", "path_duration")
        found = done if found is None else found.unionByName(done)
        state = state.join(edges, ["network_id", "at"]).select("network_id", "project_duration", F.col("target").alias("at"), F.array_append("path", F.col("target")).alias("path"), (F.col("path_duration") + F.col("more")).alias("path_duration"))
        if state.isEmpty():
            return found.join(found.groupBy("network_id").agg(F.count("*").cast("double").alias("walks")), "network_id").select("network_id", "project_duration", "walks", "path", "path_duration")


def critical_paths(activities: DataFrame, dependencies: DataFrame, full_length: bool = True, tolerance: float = TOLERANCE, max_paths: int | None = None, fold_limit: int = FOLD_LIMIT, fold_walks: int = FOLD_WALKS) -> DataFrame:
    """network_id, path_rank, path, path_len, path_duration of all paths of the critical subgraph, from its sources to its sinks.

    full_length keeps those whose durations add up to the project's (an edge between critical vertices may be slack); without
    it all walks stay, as three-point schedules take them. Ranked by length, then ids. Networks of more than fold_limit
    vertices or fold_walks walks go to rounds of joins, in which no network lands in one row. Only where the caller states
    max_paths, networks with more walks are reported by count (path null) instead."""
    large = None
    if max_paths is None:
        large = activities.groupBy("network_id").count().filter(F.col("count") > fold_limit).select("network_id")
        counted = critical_walks(activities.join(large, "network_id", "left_anti"), dependencies, tolerance)
        large = cut(large.unionByName(counted.filter(F.col("walks") > fold_walks).select("network_id")))
        if large.isEmpty():
            large = None
    small = [t if large is None else t.join(large, "network_id", "left_anti") for t in (activities, dependencies)]
    rows = critical_walks(*small, tolerance)
    # walks of each vertex are its predecessors' walks, longer by itself: a fold along the topological order
    walk = f"""aggregate(critical, cast(array() as array<struct<v:int, p:array<int>>>), (all, v) -> concat(all,
        if(exists(ce, x -> x.t = v), flatten(transform(filter(ce, x -> x.t = v), x -> transform(filter(all, w -> w.v = x.s), w -> named_struct('v', v, 'p', array_append(w.p, v))))),
           array(named_struct('v', v, 'p', array(v))))))"""
    rows = rows.withColumn("paths", F.when(F.col("walks") <= (fold_walks if max_paths is None else max_paths), F.expr(let(f"filter({walk}, w -> not exists(ce, x -> x.s = w.v))", "critical", "ce"))))
    flat = rows.select("network_id", "project_duration", "walks", "a", F.explode_outer("paths").alias("w"))
    flat = flat.select(
        "network_id", "project_duration", "walks",
        F.expr("transform(w.p, i -> a[i - 1].activity_id)").alias("path"),
        F.expr("aggregate(w.p, 0D, (n, i) -> n + a[i - 1].duration)").alias("path_duration"),
    )
    if large is not None:
        flat = flat.unionByName(loop_walks(*(t.join(large, "network_id", "left_semi") for t in (activities, dependencies)), tolerance))
    if full_length:
        flat = flat.filter(F.col("path").isNull() | (F.abs(F.col("path_duration") - F.col("project_duration")) < tolerance))
    rank = F.row_number().over(W.partitionBy("network_id").orderBy(F.size("path"), "path"))
    return flat.select("network_id", rank.alias("path_rank"), "path", F.size("path").alias("path_len"), "path_duration", "walks")


def path_variance(paths: DataFrame, activities: DataFrame) -> DataFrame:
    """Project variance and deviation over each network's first critical path, added up in path order."""
    first = paths.filter("path_rank = 1 and path is not null").select("network_id", F.posexplode("path").alias("place", "activity_id"))
    joined = first.join(activities.select("network_id", "activity_id", "variance"), ["network_id", "activity_id"])
    ordered = joined.groupBy("network_id").agg(F.array_sort(F.collect_list(F.struct("place", "variance"))).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda n, x: n + x["variance"])
    return ordered.select("network_id", total.alias("project_variance"), F.sqrt(total).alias("project_deviation"))


def first_walk_totals(activities: DataFrame, dependencies: DataFrame, tolerance: float = TOLERANCE, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """network_id, project_variance, project_deviation, project_duration, critical_count, non_critical_count of networks with a critical vertex.

    The variance is added up along the first critical walk in the order of critical_paths() without full_length (fewest vertices, then ids); no
    other walk is built. Activities have a variance."""
    rows = by_size(activities, dependencies, lambda a, d: batches.first_walk_totals(a, d, tolerance), lambda a, d: loop_first_walk_totals(a, d, tolerance), fold_limit)
    return rows.select("network_id", "project_variance", F.sqrt("project_variance").alias("project_deviation"), "project_duration", "critical_count", "non_critical_count")


def loop_first_walk_totals(activities: DataFrame, dependencies: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The same by rounds of joins: back from the sinks for the shortest walk of each vertex, then along the first walk of each network."""
    times = cut(loop_schedule(activities, dependencies, tolerance).select("network_id", "activity_id", "is_critical", "project_duration"))
    vertices = cut(times.filter("is_critical").join(activities.select("network_id", "activity_id", F.col("variance").cast("double")), ["network_id", "activity_id"]).select("network_id", "activity_id", "variance"))
    known = vertices.select("network_id", "activity_id")
    edges = dependencies.select("network_id", "source", "target").distinct()
    for end in ("source", "target"):
        edges = edges.join(known.withColumnRenamed("activity_id", end), ["network_id", end], "left_semi")
    edges = cut(edges.select("network_id", "source", "target"))
    fresh = cut(known.join(edges.select("network_id", F.col("source").alias("activity_id")), ["network_id", "activity_id"], "left_anti").withColumn("next", F.lit(None).cast(activities.schema["activity_id"].dataType)))
    found, steps = fresh.withColumn("steps", F.lit(1)), 1
    while not fresh.isEmpty():
        # a vertex is met first from the end of its shortest walk; of several ends the least id goes on
        steps += 1
        met = edges.join(fresh.select("network_id", F.col("activity_id").alias("target")), ["network_id", "target"]).groupBy("network_id", F.col("source").alias("activity_id")).agg(F.min("target").alias("next"))
        fresh = cut(met.join(found.select("network_id", "activity_id"), ["network_id", "activity_id"], "left_anti"))
        found = found.unionByName(fresh.withColumn("steps", F.lit(steps)))
    found = cut(found.join(vertices, ["network_id", "activity_id"]))
    heads = found.join(edges.select("network_id", F.col("target").alias("activity_id")), ["network_id", "activity_id"], "left_anti")
    first = heads.groupBy("network_id").agg(F.min(F.struct("steps", "activity_id")).alias("m"))
    state, ended = cut(first.select("network_id", F.col("m.activity_id").alias("at"), F.lit(0.0).alias("project_variance"))), None
    while not state.isEmpty():
        walked = cut(state.join(found.withColumnRenamed("activity_id", "at"), ["network_id", "at"]).select("network_id", (F.col("project_variance") + F.col("variance")).alias("project_variance"), F.col("next").alias("at")))
        done = walked.filter("at is null").select("network_id", "project_variance")
        ended = done if ended is None else ended.unionByName(done)
        state = walked.filter("at is not null")
    totals = summary(times)
    return totals.withColumn("project_variance", F.lit(None).cast("double")).limit(0) if ended is None else ended.join(totals, "network_id")
